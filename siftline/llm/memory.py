"""Memory of the Python workers of tasks, which live on from task to task."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa


#: What operators keep in a worker from task to task, and how to drop it.
_kept: dict[str, Callable[[], None]] = {}


def keeps(owner: str, drop: Callable[[], None]) -> None:
    """Says that tasks of ``owner`` leave something in the worker, which ``drop`` frees."""
    _kept[owner] = drop


def begin(owner: str = "") -> None:
    """At the start of a task: what other operators left in this worker goes."""
    for name in [n for n in _kept if n != owner]:
        _kept.pop(name)()
    give_back()


def give_back() -> None:
    """What a batch of whole texts took and left goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
