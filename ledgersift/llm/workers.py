"""What Python workers keep between tasks: as little as they can."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa


def release() -> None:
    """Give freed memory back to the system: an idle worker stays alive beside the next stage's JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(work: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """The same function over batches, with `release` when its task ends."""

    def run(batches: Iterator) -> Iterator:
        yield from work(batches)
        release()

    return run
