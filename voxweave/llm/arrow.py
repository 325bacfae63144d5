"""Python stages over Arrow batches, with memory bounded by bytes.

Spark cuts batches by rows and by bytes; its own bound of bytes is meant for one batch at a time, not for
the text, numbers and lists that a stage makes of it. So a session that has left Spark's bound alone gets
``BATCH_BYTES`` instead (a longer row is a batch of its own). A cache lives on in a worker from task to task,
until the worker begins a task of a stage that does not use it; freed memory is handed back after each task.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

from pyspark.sql import DataFrame

BATCH_BYTES = 4 << 20
BOUND, DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"

#: What empties the caches of this worker, by their name.
_kept: dict[str, list[Callable[[], None]]] = {}


def keep(name: str, forget: Callable[[], None]) -> None:
    """Notes a cache of this worker, and what empties it."""
    if forget not in (known := _kept.setdefault(name, [])):
        known.append(forget)


def forget_others(name: str) -> None:
    """Empties all caches but those of a name."""
    for other, forgets in _kept.items():
        if other != name:
            for forget in forgets:
                forget()


def release() -> None:
    """Gives unused memory back to the system."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mapped(df: DataFrame, function: Callable, schema: str, keeps: str = "") -> DataFrame:
    """df.mapInArrow(function, schema) over batches of about BATCH_BYTES; keeps: the name of the cache that function uses."""
    conf = df.sparkSession.conf
    if conf.get(BOUND, DEFAULT) == DEFAULT:
        conf.set(BOUND, str(BATCH_BYTES))

    def rows(batches):
        forget_others(keeps)
        try:
            yield from function(batches)
        finally:
            release()

    return df.mapInArrow(rows, schema)
