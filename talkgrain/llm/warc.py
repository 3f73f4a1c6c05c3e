"""WARC archives: writing with revisit records, and a sequential reader.

Every record is a gzip member of its own. The reader inflates step by step, frames blocks by Content-Length, never holds
more than one step of a payload, and checks block and payload digests as it goes.

Equal payloads (of at least `min_bytes`) are stored once: the record with the smallest id is a response, the others are
revisits that name it. Defined results: a null payload is empty; a row without an id is a response; rows that repeat id
and payload are all what the first is; an empty table makes no archive and reads as no rows. Archives are written next
to each other without a shuffle of the payloads, unless there are more revisits than may be broadcast. The URL that is read back
is the page's: WARC-Target-URI is percent-encoded where WARC needs that, and X-Page-Url then has the URL itself. Other columns are
ignored, whatever their names; payloads of any length are written whole.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import Any, BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkgrain.llm import files
from talkgrain.llm.common import Scratch, checked, join_groups

#: An archive is closed once it holds so many payload bytes.
ARCHIVE_BYTES = 64_000_000
STEP = 1 << 18
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
RESULT = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}') if page_id is not None else uuid.uuid4()}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member: a response, or a revisit of the record `refers_to` without the payload."""
    http = HTTP % len(payload)
    block = http + (payload if refers_to is None else b"")
    target = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "")
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(page_id),
        "WARC-Date": DATE,
        "WARC-Target-URI": target,
        "WARC-Payload-Digest": f"sha1:{digest32(payload)}",
        "WARC-Block-Digest": f"sha1:{digest32(block)}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
        "X-Payload-Length": len(payload),
    }
    if page_id is not None:
        head["X-Page-Id"] = page_id
    if url is not None and (not url or url != target):
        head["X-Page-Url"] = json.dumps(url)
    if refers_to is not None:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(refers_to), "X-Refers-To-Page-Id": refers_to}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v != "")
    squeeze = zlib.compressobj(5, zlib.DEFLATED, 31)
    return squeeze.compress(b"WARC/1.1\r\n" + lines.encode() + b"\r\n") + squeeze.compress(block) + squeeze.compress(b"\r\n\r\n") + squeeze.flush()


class Member:
    """One gzip member of a stream, inflated as far as it is asked for. rest: bytes read beyond it."""

    def __init__(self, stream: BinaryIO, rest: bytes):
        self.stream, self.rest, self.out = stream, rest, b""
        self.inflate = zlib.decompressobj(31)

    def _more(self) -> bool:
        if self.inflate.eof:
            return False
        data = self.inflate.unconsumed_tail or self.rest or self.stream.read(STEP)
        self.rest = b""
        if not data:
            raise ValueError("the archive ends inside a record")
        self.out += self.inflate.decompress(data, STEP)
        if self.inflate.eof:
            self.rest = self.inflate.unused_data
        return True

    def until(self, mark: bytes) -> bytes:
        while (at := self.out.find(mark)) < 0:
            if not self._more():
                raise ValueError("a record has no end of header")
        found, self.out = self.out[:at], self.out[at + len(mark) :]
        return found

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.out and not self._more():
                raise ValueError("a record is shorter than its Content-Length")
            part, self.out = self.out[:n], self.out[n:]
            n -= len(part)
            yield part

    def end(self) -> bytes:
        while self._more():
            pass
        return self.out


def records(stream: BinaryIO, payload: Callable[[bytes], Any] | None = None) -> Iterator[dict[str, Any]]:
    """The records of an archive in order, verified. payload: gets the parts of each payload as they are inflated."""
    rest = stream.read(STEP)
    while rest:
        m = Member(stream, rest)
        lines = m.until(b"\r\n\r\n").decode().split("\r\n")
        if not lines[0].startswith("WARC/1."):
            raise ValueError("not a WARC record")
        head = dict(x.split(": ", 1) for x in lines[1:])
        left = int(head["Content-Length"])
        whole, body, size, http = hashlib.sha1(), hashlib.sha1(), 0, b""
        for part in m.take(left):
            whole.update(part)
            if http is not None:
                http += part
                if b"\r\n\r\n" not in http:
                    continue
                part, http = http.split(b"\r\n\r\n", 1)[1], None
            body.update(part)
            size += len(part)
            if payload:
                payload(part)
        if m.end() != b"\r\n\r\n":
            raise ValueError("a record goes on beyond its Content-Length")
        shown = {k: head[k].removeprefix("sha1:") for k in ("WARC-Block-Digest", "WARC-Payload-Digest")}
        if base64.b32encode(whole.digest()).decode() != shown["WARC-Block-Digest"]:
            raise ValueError("a block differs from its digest")
        if head["WARC-Type"] == "response" and (base64.b32encode(body.digest()).decode() != shown["WARC-Payload-Digest"] or size != int(head["X-Payload-Length"])):
            raise ValueError("a payload differs from its digest or length")
        number = lambda k: int(head[k]) if k in head else None
        url = json.loads(head["X-Page-Url"]) if "X-Page-Url" in head else head.get("WARC-Target-URI")
        yield {
            "page_id": number("X-Page-Id"), "url": url, "payload_bytes": number("X-Payload-Length"),
            "payload_digest": shown["WARC-Payload-Digest"], "record_type": head["WARC-Type"], "refers_to": number("X-Refers-To-Page-Id"),
        }
        rest = m.rest or stream.read(STEP)


def revisits(pages: DataFrame, scratch: Scratch, min_bytes: int = 0, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """_rid, _rd, refers_to: the rows whose payload an earlier id has too."""
    payload = F.coalesce(payload_col, F.lit(""))
    rows = pages.filter(F.octet_length(payload) >= min_bytes).select(F.col(id_col).alias("_rid"), F.unhex(F.sha1(payload)).alias("_rd"))
    groups = scratch.save(rows.groupBy("_rd").agg(F.min("_rid").alias("refers_to"), F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "payloads")
    total = groups.agg(F.sum("_n")).first()[0] or 0
    found = join_groups(rows, groups, "_rd", "_rid", "_n", total)
    return scratch.save(found.filter(F.col("refers_to") < F.col("_rid")).select("_rid", "_rd", "refers_to").distinct(), "revisits")


def write_archives(pages: DataFrame, scratch: Scratch, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes the archives; one row per archive: path, records."""
    payload = F.coalesce(payload_col, F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).alias("_url"), payload.alias("_payload"))
    again, _ = checked(revisits(pages, scratch, min_bytes, id_col, payload_col))
    rows = rows.join(again, (F.col("_id") == F.col("_rid")) & (F.unhex(F.sha1("_payload")) == F.col("_rd")), "left").select("_id", "_url", "_payload", "refers_to")
    folder = scratch.path("archives")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out, made = TaskContext.get(), None, []
        name = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}"
        for b in batches:
            for i, url, text, ref in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist()):
                if out is None or size >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    made.append([f"{name}-{len(made):04d}.warc.gz", 0])
                    out, size = files.writer(made[-1][0]), 0
                data = text.as_buffer().to_pybytes()
                out.write(record(i, url, data, ref))
                made[-1][1] += 1
                size += len(data)
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], ["path", "records"])

    return scratch.save(rows.mapInArrow(write, "path string, records long"), "manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """Reads every archive of a manifest from start to end; a task per archive."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for b in batches:
            for path, expected in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n, some = 0, []
                with files.reader(path) as stream:
                    for r in records(stream):
                        n += 1
                        some.append(r)
                        if len(some) == 4096:
                            yield pa.RecordBatch.from_pylist(some, schema)
                            some = []
                if n != expected:
                    raise ValueError(f"{path} has {n} records; {expected} were written")
                yield pa.RecordBatch.from_pylist(some, schema)

    n = max(1, min(manifest.count(), 20_000))
    return manifest.repartition(n, "path").mapInArrow(read, RESULT)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    scratch = Scratch(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, scratch, min_bytes))
