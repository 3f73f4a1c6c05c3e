"""Byte files in the shared folder, from executors as well as the driver, through whatever filesystem its URI names."""

from __future__ import annotations

import re

from pyarrow import fs


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    uri = re.sub(r"^file:/*", "/", uri)
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def writer(uri: str):
    system, path = locate(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path)


def reader(uri: str):
    system, path = locate(uri)
    return system.open_input_stream(path)


def random_reader(uri: str):
    system, path = locate(uri)
    return system.open_input_file(path)
