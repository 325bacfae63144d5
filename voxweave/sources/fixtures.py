"""Transcript relations derived from the star-schema test tables, for queries and benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxweave.functions.text import confidence

CHUNK_MS = 20_000
EDGE_MS = 2_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, seq, turn, role, text, words, start_ms, end_ms, avg_logprob, confidence: a segment per line of a conversation."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    rows = rows.withColumn("words", F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).cast("long"))
    order = Window.partitionBy("conv_id").orderBy("turn", "line")
    rows = rows.withColumn("seq", (F.row_number().over(order) - 1).cast("long")).withColumn("dur_ms", F.greatest(F.lit(1), "words") * 400)
    rows = rows.withColumn("end_ms", F.sum("dur_ms").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("avg_logprob", -((F.col("conv_id") * 31 + F.col("seq") * 17) % 100) / F.lit(100.0))
    return rows.select(F.col("conv_id").alias("source_id"), "seq", "turn", "role", "text", "words", (F.col("end_ms") - F.col("dur_ms")).alias("start_ms"), "end_ms", "avg_logprob", confidence(F.col("avg_logprob")).alias("confidence"))


def diarization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, dseq, speaker, start_ms, end_ms: the turns with shifted edges, some of them left out."""
    turn = segments(spark, sf_dir).groupBy("source_id", "turn", "role").agg(F.min("start_ms").alias("a"), F.max("end_ms").alias("b"))
    start = F.col("a") + ((F.col("turn") * 37 + F.col("source_id")) % 7 - 3) * 200
    end = F.col("b") + ((F.col("turn") * 53 + F.col("source_id")) % 5 - 2) * 300
    return turn.filter((F.col("source_id") + F.col("turn")) % 7 != 0).select("source_id", F.col("turn").alias("dseq"), F.col("role").alias("speaker"), start.alias("start_ms"), end.alias("end_ms"))


def offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id (a user), at_ms since the user's first event, value, event_id."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    first = F.min("us").over(Window.partitionBy("user_id"))
    return rows.select(F.col("user_id").alias("source_id"), "event_id", "value", F.expr("us").alias("us"), first.alias("us0")).selectExpr("source_id", "event_id", "value", "(us - us0) div 1000 as at_ms")


def silences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, start_ms, end_ms of gaps of six hours and more, and total_ms of the source."""
    order = Window.partitionBy("source_id").orderBy("at_ms", "event_id")
    rows = offsets(spark, sf_dir).select("source_id", F.lag("at_ms").over(order).alias("start_ms"), F.col("at_ms").alias("end_ms"), F.max("at_ms").over(Window.partitionBy("source_id")).alias("total_ms"))
    return rows.filter(F.col("end_ms") - F.col("start_ms") >= 6 * 3_600_000)


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offsets(spark, sf_dir).groupBy("source_id").agg(F.max("at_ms").alias("total_ms"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, idx, start_ms, end_ms, overlap_start_ms: pieces of CHUNK_MS of a conversation that also hear EDGE_MS of the one before."""
    end = segments(spark, sf_dir).groupBy("source_id").agg(F.max("end_ms").alias("total_ms"))
    rows = end.select("source_id", "total_ms", F.explode(F.expr(f"sequence(0L, (total_ms - 1) div {CHUNK_MS}L)")).alias("idx"))
    start = F.col("idx") * CHUNK_MS
    return rows.select("source_id", "idx", start.alias("start_ms"), F.least(start + CHUNK_MS, "total_ms").alias("end_ms"), F.when(F.col("idx") > 0, EDGE_MS).otherwise(0).cast("long").alias("overlap_start_ms"))


def chunk_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, idx, seq, start_ms, end_ms (from the chunk's start), text, confidence; segments near an edge occur in both chunks."""
    seg = segments(spark, sf_dir).select("source_id", "seq", F.col("start_ms").alias("s"), F.col("end_ms").alias("e"), "text", "confidence")
    parts = chunks(spark, sf_dir).withColumnRenamed("source_id", "sid")
    hears = (F.col("s") >= F.col("start_ms") - F.col("overlap_start_ms")) & (F.col("s") < F.col("end_ms"))
    rows = seg.join(parts, (F.col("source_id") == F.col("sid")) & hears)
    return rows.select("source_id", "idx", "seq", (F.col("s") - F.col("start_ms")).alias("start_ms"), (F.col("e") - F.col("start_ms")).alias("end_ms"), "text", "confidence")
