"""Reading the tables, and laying documents out by ranges of doc_id."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxweave.shared import discard, saved, scratch, shared_dir

__all__ = ["discard", "id_ranges", "saved", "scratch", "shared_dir", "small", "table"]

#: Bytes up to which a table is broadcast; beyond it, it is joined by a shuffle.
BROADCAST_BYTES = 32 << 20

#: Rows and bytes of text that a range of doc_id should hold.
RANGE_ROWS, RANGE_BYTES = 20_000, 16 << 20
#: Ranges at most: a shuffle has as many partitions as ranges, times those it reads from; beyond that, ranges are larger.
MOST_RANGES = 20_000
#: Column names of a row's place in the order: whether it has a doc_id, that, a hash of its text, and its number.
KEY = ("_has", "_id", "_tie", "_row")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, row_bytes: int | Column) -> DataFrame:
    """df, marked for broadcast if it holds BROADCAST_BYTES at most; row_bytes: of each row, as a bound or a column."""
    if isinstance(row_bytes, int):
        rows = BROADCAST_BYTES // row_bytes
        return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
    return F.broadcast(df) if (df.agg(F.sum(row_bytes)).first()[0] or 0) <= BROADCAST_BYTES else df


def ordered(docs: DataFrame) -> DataFrame:
    """docs with KEY: an order by doc_id (those without one first), in which repeated doc_ids go by text and by row."""
    has = F.col("doc_id").isNotNull()
    return docs.select("*", has.cast("int").alias("_has"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"), F.xxhash64("text").alias("_tie"), F.monotonically_increasing_id().alias("_row"))


def _last_reached(bounds: Column, key: Column, most: int) -> Column:
    """How many of the bounds, which are ascending and ``most`` at most, are not above the key: a binary search."""
    steps = F.array(*[F.lit(1 << k) for k in range(most.bit_length() - 1, -1, -1)])
    reached = lambda at: F.coalesce(F.get(bounds, at - 1) <= key, F.lit(False))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(reached(at + step), at + step).otherwise(at))


def id_ranges(docs: DataFrame) -> tuple[DataFrame, int]:
    """docs with KEY and ``range``, which numbers ranges of that order of about RANGE_ROWS rows and RANGE_BYTES, or MOST_RANGES alike, and their number.

    The ranges are found once, from the keys alone, by Spark's range partitioning; their lower bounds are a small table,
    and rows find their range by two binary searches: among the square root of the ranges, which the driver puts
    into the plan, and among as many ranges again. So a range is as large as any other, whatever the ids are.
    """
    keyed = ordered(docs)
    rows, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    n = min(MOST_RANGES, max(1, -(-rows // RANGE_ROWS), -(-(size or 0) // RANGE_BYTES)))
    width = math.isqrt(n - 1) + 1
    dealt = keyed.select(*KEY).repartitionByRange(n, *KEY).groupBy(F.spark_partition_id().alias("range")).agg(F.min(F.struct(*KEY)).alias("low"))
    dealt = saved(dealt)
    cells = dealt.groupBy((F.col("range") / width).cast("int").alias("_cell")).agg(F.sort_array(F.collect_list(F.struct("low", "range"))).alias("_in"))
    firsts = sorted((r.low, r["_cell"]) for r in cells.select(F.get("_in", 0).low.alias("low"), "_cell").collect())
    if not firsts:
        return keyed.withColumn("range", F.lit(0)), 1
    key = F.struct(*KEY)
    bounds = F.expr("array(" + ", ".join(f"named_struct('_has', {low[0]}, '_id', bigint({_long(low[1])}), '_tie', bigint({_long(low[2])}), '_row', {low[3]}L)" for low, _ in firsts) + ")")
    numbers = F.expr("array(" + ", ".join(str(cell) for _, cell in firsts) + ")")
    at = keyed.withColumn("_cell", F.get(numbers, F.greatest(F.lit(1), _last_reached(bounds, key, len(firsts))) - 1))
    within = cells.select("_cell", F.transform("_in", lambda x: x.low).alias("_lows"), F.transform("_in", lambda x: x["range"]).alias("_ranges"))
    most = cells.agg(F.max(F.size("_in"))).first()[0]
    found = at.join(small(within, F.size("_lows") * 64), "_cell")
    place = F.get(F.col("_ranges"), F.greatest(F.lit(1), _last_reached(F.col("_lows"), key, most)) - 1)
    return found.withColumn("range", place).drop("_cell", "_lows", "_ranges"), n


def _long(x: int) -> str:
    """A literal of a long, which the least one is not by itself."""
    return f"'{x}'"
