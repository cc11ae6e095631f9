"""What Python workers hold: groups of bounded size, and memory given back. (The
training-data operators, an optional part, have their own ``lean``.)"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa

#: Fixed value: a group of rows is handed on when its texts have so many characters.
GROUP_CHARS = 1 << 20


def groups(rows: Iterable[Any], most: int, length: Callable[[Any], int]) -> Iterator[list]:
    """``rows`` in lists of up to ``most``, fewer where their lengths come to GROUP_CHARS."""
    group, chars = [], 0
    for row in rows:
        group.append(row)
        chars += length(row)
        if len(group) >= most or chars >= GROUP_CHARS:
            yield group
            group, chars = [], 0
    if group:
        yield group


def free_memory() -> None:
    """Give memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not glibc
        pass


def lean(run):
    """``run``, a generator function for mapInArrow, that frees memory when it's done:
    Spark keeps workers for later tasks, and what they hold adds to what those need."""

    @functools.wraps(run)
    def stream(batches):
        try:
            yield from run(batches)
        finally:
            free_memory()

    return stream
