"""Memory of Python workers, which serve one stage after another and would keep what the largest took."""

from __future__ import annotations

import ctypes

import pyarrow as pa

try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # not every C library can give memory back
    _trim = None


def give_back() -> None:
    """Returns what is free to the system."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)
