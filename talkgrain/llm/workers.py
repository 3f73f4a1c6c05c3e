"""What Python workers keep between tasks. Workers are reused by later stages, so an operator's caches go when another one takes over."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

_clearers: dict[str, Callable[[], None]] = {}
_owner: list[str] = []


def keeps(name: str, clear: Callable[[], None]) -> None:
    """Registers how the caches of `name` are emptied."""
    _clearers[name] = clear


def give_back() -> None:
    """Returns freed memory to the system, as far as the allocators can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def take_over(name: str) -> None:
    """To be called by a task before it uses the caches of `name`: those of all others are emptied, and what this worker's earlier tasks freed goes back."""
    if _owner != [name]:
        for other, clear in _clearers.items():
            if other != name:
                clear()
        give_back()
        _owner[:] = [name]
