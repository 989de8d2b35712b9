"""What a Python worker keeps between tasks.

Workers are used again by later tasks and later queries, so what one operator
remembers (token ids or margins of words) would stay beside the next one's.  A
worker therefore keeps one such object, and operators that need none drop it.
What is dropped goes back to the system, as the allocators would keep it.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

_HELD: dict = {}


def held(mark: str, make: Callable):
    """The object of one query, made if the worker has another one or none."""
    if mark not in _HELD:
        free()
        _HELD[mark] = make()
    return _HELD[mark]


def free() -> None:
    if _HELD:
        _HELD.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim is not None:
            trim(0)
