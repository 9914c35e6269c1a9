"""Compact blobs of numpy arrays for shuffles: byte planes under zstd, sorted values as differences."""
from __future__ import annotations

import ctypes
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard

_LEVEL = 1


def pack(x: np.ndarray) -> bytes:
    """Any one-dimensional array of fixed-size numbers."""
    x = np.ascontiguousarray(x)
    planes = x.view(np.uint8).reshape(len(x), x.itemsize).T
    return zstandard.ZstdCompressor(level=_LEVEL).compress(np.ascontiguousarray(planes).tobytes())


def unpack(blob: bytes, kind) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(raw, np.uint8).reshape(size, len(raw) // size)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def pack_sorted(x: np.ndarray) -> bytes:
    """Ascending uint64 values."""
    return pack(np.diff(x, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob, np.uint64), dtype=np.uint64)


def release() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # a C library without it keeps its memory
        trim(0)


def lean(run: Callable) -> Callable:
    """run (of one table or two), after which its memory is released.

    Spark keeps workers that wait for a task for a minute, more of them than there are tasks; without this each
    holds what its last group needed.
    """
    if run.__code__.co_argcount == 1:
        def one(rows):
            try:
                return run(rows)
            finally:
                release()
        return one

    def two(rows, others):
        try:
            return run(rows, others)
        finally:
            release()
    return two
