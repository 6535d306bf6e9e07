"""Helpers for functions that work on Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import pyarrow as pa
from pyspark.sql import SparkSession

BATCH_BYTES = 8 << 20
BATCH_ROWS = 4000


def bounded_batches(spark: SparkSession) -> None:
    """Limit what one Arrow batch holds, so that a worker's memory doesn't depend on the texts' lengths.

    Only lowers the session's settings, never raises them.
    """
    for key, most in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", BATCH_ROWS)):
        name = f"spark.sql.execution.arrow.{key}"
        now = int(spark.conf.get(name).rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(name, str(most))


def in_batches(work: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator], Iterator]:
    """Function for mapInArrow that applies the work to each batch that has rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield work(batch)

    return handed_back(run)


def handed_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The function for mapInArrow, with what its batches took given back to the system when they are through.

    A worker goes on to other tasks, of other stages too, and allocators keep what was freed.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU library
                trim(0)

    return whole


_FORGET: dict[str, list[Callable[[], None]]] = {}


def once_per_worker(make: Callable) -> Callable:
    """The function, its latest result kept by the process until such a function of another module is called.

    So a worker that goes from stage to stage holds the tables of one of them.
    """
    kept = lru_cache(maxsize=1)(make)
    _FORGET.setdefault(make.__module__, []).append(kept.cache_clear)

    @wraps(make)
    def get(*args):
        for module, forgets in _FORGET.items():
            if module != make.__module__:
                for forget in forgets:
                    forget()
        return kept(*args)

    return get
