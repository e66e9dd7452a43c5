"""What a Python worker keeps from task to task: one object, so that stages that share a worker don't add up."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable
from typing import Any

import pyarrow as pa

_held: list[tuple[Hashable, Any]] = []


def keep(key: Hashable, make: Callable[[], Any]) -> Any:
    """The object kept under ``key``; if another one is kept, that is dropped first."""
    if not _held or _held[0][0] != key:
        drop()
        _held[:] = [(key, make())]
    return _held[0][1]


def drop() -> None:
    """Forgets the kept object, and hands freed memory back to the system."""
    if _held:
        _held.clear()
        gc.collect()
    trim()


def trim() -> None:
    """Hands freed memory back to the system: an interpreter's heap doesn't shrink by itself."""
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if release:
        release(0)
