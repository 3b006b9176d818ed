"""What a Python worker keeps from one task to the next.

Spark gives a worker tasks of all operators in turn.  Tables that one of them
keeps (pieces of a tokenizer are some hundred megabytes) would stay beside the
next one's, so what is kept belongs to one operator at a time.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa

_KEPT: dict[str, dict] = {}


def release() -> None:
    """Give back memory that is free but held for later use."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for ``mapInArrow``; when a task ends, what it leaves free is
    given back, as the worker then waits beside others that are at work."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def kept(owner: str) -> dict:
    """A dictionary of the owner's, which lasts until a task of another one."""
    others = [name for name in _KEPT if name != owner]
    if others:
        for name in others:
            del _KEPT[name]
        gc.collect()
        release()
    return _KEPT.setdefault(owner, {})
