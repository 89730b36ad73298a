"""Memory of Python workers, which Spark keeps for later tasks."""

from __future__ import annotations

import ctypes
import ctypes.util
import gc

import pyarrow as pa


def give_back() -> None:
    """Return what a finished task has freed to the system: the pools of Arrow and of the C library would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(ctypes.util.find_library("c")), "malloc_trim", None)
    if trim is not None:
        trim(0)
