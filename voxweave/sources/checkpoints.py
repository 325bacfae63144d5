"""Completed work as a table, and as JSON documents.

The table holds one row per completed piece and its segments, in a fixed number of buckets by source; a unit of work is
appended as files that appear only when whole, so a lost executor or driver leaves nothing half done. Of several rows of a
piece the latest counts. The JSON form is for exchange; unreadable or outdated documents count as absent.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxweave.operators.resume import VERSION

SEGMENT = "struct<start: double, end: double, text: string, confidence: double, speaker: string>"
RESULT = f"struct<language: string, duration: double, segments: array<{SEGMENT}>>"
DOCUMENT = f"struct<version: int, source: string, source_size_bytes: bigint, total_chunks: int, completed_chunks: array<int>, created_at: string, updated_at: string, chunk_results: map<string, {RESULT}>>"
TABLE = f"source_id string, source_size_bytes bigint, total_chunks int, version int, idx int, result {RESULT}"
#: Finished transcripts that wait for their speakers.
STAGE = "source_id string, source_size_bytes bigint, version int, segments array<struct<seq: bigint, start_ms: bigint, end_ms: bigint, text: string, confidence: double>>"


def append_stage(transcripts: DataFrame, path: str) -> None:
    """Adds finished transcripts (source_id, source_size_bytes, segments) to the stage checkpoint at path."""
    transcripts.withColumn("version", F.lit(VERSION)).select("source_id", "source_size_bytes", "version", "segments").write.mode("append").parquet(path)


def load_stage(spark: SparkSession, path: str, now: DataFrame) -> DataFrame:
    """The transcripts at path whose sources still have their size (now: source_id, source_size_bytes)."""
    return waiting(spark.read.schema(STAGE).parquet(path), now)


def waiting(stage: DataFrame, now: DataFrame) -> DataFrame:
    """Rows of a stage checkpoint that still fit: of this version, and their sources of the same size; one per source."""
    rows = stage.filter(F.col("version") == VERSION)
    return rows.join(now.select("source_id", "source_size_bytes"), ["source_id", "source_size_bytes"], "left_semi").dropDuplicates(["source_id"])


#: Folders that sources are dealt to, however many there are.
BUCKETS = 64
#: What a row of the table on disk has besides: when it was added.
ADDED = "added bigint"


def _generations(spark: SparkSession, path: str) -> list[int]:
    """The generations of the table that were written to their end, ascending."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [d.getPath().getName() for d in fs.listStatus(at)] if fs.exists(at) else []
    numbers = sorted(int(n.removeprefix("generation-")) for n in names if n.startswith("generation-"))
    return [n for n in numbers if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/generation-{n}/_SUCCESS"))]


def _write(rows: DataFrame, path: str, generation: int, mode: str) -> None:
    bucket = F.pmod(F.xxhash64("source_id"), F.lit(BUCKETS)).cast("int")
    rows.withColumn("bucket", bucket).write.mode(mode).partitionBy("bucket").parquet(f"{path}/generation-{generation}")


def append(results: DataFrame, path: str) -> None:
    """Adds completed pieces (source_id, source_size_bytes, total_chunks, idx, result) to the table at path."""
    spark = results.sparkSession
    now = F.lit(time.time_ns())
    rows = results.withColumn("version", F.lit(VERSION)).select("source_id", "source_size_bytes", "total_chunks", "version", "idx", "result", now.alias("added"))
    _write(rows, path, max(_generations(spark, path), default=0), "append")


def load(spark: SparkSession, path: str) -> DataFrame:
    """The table at path, one row per piece: the latest of those that were added."""
    found = [f"{path}/generation-{n}" for n in _generations(spark, path)]
    if not found:
        return spark.createDataFrame([], TABLE)
    return latest(spark.read.schema(f"{TABLE}, {ADDED}").parquet(*found))


def latest(rows: DataFrame) -> DataFrame:
    """Rows of the table on disk, the one of each piece that was added last."""
    names = [f.name for f in rows.schema.fields if f.name not in ("source_id", "idx", "added")]
    last = rows.groupBy("source_id", "idx").agg(F.max_by(F.struct(*names), "added").alias("r"))
    return last.select("source_id", "r.source_size_bytes", "r.total_chunks", "r.version", "idx", "r.result")


def compact(spark: SparkSession, path: str) -> None:
    """Rewrites the table's many small files as one file a bucket, without rows that later ones replaced.

    The new generation counts once it is written to its end; only then are those before it removed. Reading takes the latest row
    of all generations, so a break between the two changes nothing.
    """
    old = _generations(spark, path)
    if not old:
        return
    rows = load(spark, path).withColumn("added", F.lit(time.time_ns()))
    bucket = F.pmod(F.xxhash64("source_id"), F.lit(BUCKETS))
    _write(rows.repartition(BUCKETS, bucket), path, old[-1] + 1, "overwrite")
    for n in old:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/generation-{n}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def from_documents(texts: DataFrame) -> DataFrame:
    """JSON documents (source_id, body) as rows of the table; those that can't be read, or of another version, are left out."""
    rows = texts.select("source_id", F.from_json("body", DOCUMENT).alias("d")).filter(F.col("d.version") == VERSION)
    each = rows.select("source_id", "d.source_size_bytes", "d.total_chunks", "d.version", "d.completed_chunks", F.explode("d.chunk_results").alias("k", "result"))
    each = each.withColumn("idx", F.expr("try_cast(k as int)")).filter(F.array_contains("completed_chunks", F.col("idx")))
    return each.select("source_id", "source_size_bytes", "total_chunks", "version", "idx", with_defaults("result").alias("result"))


def with_defaults(column: str):
    """A result with language es, duration 0 and no segments where they are missing."""
    r = F.col(column)
    return F.struct(F.coalesce(r.language, F.lit("es")).alias("language"), F.coalesce(r.duration, F.lit(0.0)).alias("duration"), F.coalesce(r.segments, F.array().cast(f"array<{SEGMENT}>")).alias("segments"))


def to_documents(rows: DataFrame, now: str) -> DataFrame:
    """Rows of the table as JSON documents (source_id, body); now is the ISO time to write in them."""
    each = rows.groupBy("source_id", "source_size_bytes", "total_chunks").agg(F.array_sort(F.collect_list(F.struct("idx", "result"))).alias("r"))
    body = F.struct(
        F.lit(VERSION).alias("version"),
        F.col("source_id").alias("source"),
        "source_size_bytes",
        "total_chunks",
        F.transform("r", lambda x: x.idx).alias("completed_chunks"),
        F.lit(now).alias("created_at"),
        F.lit(now).alias("updated_at"),
        F.map_from_entries(F.transform("r", lambda x: F.struct(x.idx.cast("string"), x.result))).alias("chunk_results"),
    )
    return each.select("source_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("body"))
