"""Work in units as a stream over files: one micro-batch a unit, with Spark's own record of what is done.

The rows to be worked on are written once, a file per unit; ``run`` reads them as a stream, one file a micro-batch, until none
is left. A halt that was asked for is granted between units; a second signal stops the stream, and with it the jobs of its
unit alone, other work of the session goes on.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxweave.operators.halt import Halt, Halted
from voxweave.shared import scratch


def run(rows: DataFrame, each: Callable[[DataFrame, int], None], stop: Halt, folder: str | None = None, progress: Callable[[], str] = lambda: "some") -> None:
    """Calls each(rows of a unit, number) for the units of rows (numbered from 0 in ``unit``).

    folder: where the units and the stream's checkpoint are; a folder that has them is gone on with, rows are then not looked at.
    So a unit that ended is not done again, one that was broken off is. Halted is raised when a halt is granted.
    """
    spark = rows.sparkSession
    folder = folder or scratch(spark, "units")
    there = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/todo/_SUCCESS")
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        n = (rows.agg(F.max("unit")).first()[0] or 0) + 1
        rows.repartitionById(n, F.col("unit").cast("int")).drop("unit").write.mode("overwrite").parquet(f"{folder}/todo")
    halted: list[Halted] = []

    def unit(batch: DataFrame, number: int) -> None:
        try:
            stop.check(progress())
        except Halted as e:
            halted.append(e)
            raise
        if not batch.isEmpty():
            each(batch, number)

    stream = spark.readStream.schema(rows.drop("unit").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/todo")
    query = stream.writeStream.foreachBatch(unit).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    before, stop.at_once = stop.at_once, lambda: _aside(query.stop)
    try:
        query.awaitTermination()
    except StreamingQueryException:
        if halted:
            raise halted[0] from None
        raise
    finally:
        stop.at_once = before
        if query.isActive:
            query.stop()


def _aside(call: Callable[[], None], seconds: float = 60) -> None:
    """The call from a thread of its own, since the caller's may be waiting for Spark."""
    t = threading.Thread(target=call, daemon=True)
    t.start()
    t.join(seconds)
