"""Resuming interrupted work and skipping what is done."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxweave.functions.text import name_key

VERSION = 1


def pending(units: DataFrame, done: DataFrame) -> DataFrame:
    """Units (source_id, idx) without a completed row."""
    return units.join(done.select("source_id", "idx").distinct(), ["source_id", "idx"], "left_anti")


def usable(saved: DataFrame, now: DataFrame) -> DataFrame:
    """Checkpoints (source_id, version, source_size_bytes, total_chunks) that still fit: same version, size and chunk count."""
    live = now.select("source_id", F.col("source_size_bytes").alias("_size"), F.col("total_chunks").alias("_chunks"))
    return saved.join(live, "source_id").filter((F.col("version") == VERSION) & (F.col("source_size_bytes") == F.col("_size")) & (F.col("total_chunks") == F.col("_chunks"))).drop("_size", "_chunks")


def unfinished(stems: DataFrame, outputs: DataFrame, formats: list[str]) -> DataFrame:
    """Stems for which some wanted format has no output."""
    wanted = outputs.filter(F.col("ext").isin(formats)).groupBy("stem").agg(F.countDistinct("ext").alias("n")).filter(F.col("n") == len(formats))
    return stems.join(wanted, "stem", "left_anti")


def ordered_results(units: DataFrame, results: DataFrame) -> DataFrame:
    """Each unit's result in order; a unit without one is an error."""
    rows = units.join(results.withColumn("_has", F.lit(True)), ["source_id", "idx"], "left")
    return rows.filter(F.when(F.col("_has").isNull(), F.raise_error(F.lit("a unit has no result")).cast("boolean")).otherwise(F.lit(True))).drop("_has")


def progress(units: DataFrame, done: DataFrame) -> DataFrame:
    """source_id, n_done, n_total, label as in 4/10 (40%)."""
    total = units.groupBy("source_id").agg(F.countDistinct("idx").alias("n_total"))
    made = done.groupBy("source_id").agg(F.countDistinct("idx").alias("n_done"))
    rows = total.join(made, "source_id", "left").select("source_id", F.coalesce("n_done", F.lit(0)).cast("long").alias("n_done"), "n_total")
    return rows.withColumn("label", F.format_string("%d/%d (%d%%)", "n_done", "n_total", F.expr("n_done * 100 div greatest(n_total, 1)")))


def before_halt(rows: DataFrame, order: str, status: str = "status") -> DataFrame:
    """Rows of a batch before the first HALT; failed ones are left out."""
    first = F.min(F.when(F.col(status) == "HALT", F.col(order))).over(Window.partitionBy("batch"))
    return rows.withColumn("_first", first).filter((F.col("_first").isNull() | (F.col(order) < F.col("_first"))) & (F.col(status) != "FAILED")).drop("_first")


def look_up(asked: DataFrame, names: DataFrame) -> DataFrame:
    """asked and name of the one name that equals it up to case and punctuation; none if several do."""
    keyed = names.select("name", name_key(F.col("name")).alias("_key"))
    single = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.min("name").alias("name")).filter("_n = 1 and _key <> ''")
    return asked.withColumn("_key", name_key(F.col("asked"))).join(single, "_key").select("asked", "name")


def completed(done: DataFrame) -> DataFrame:
    """source_id, idxs: the numbers of the completed units, each once, ascending."""
    return done.groupBy("source_id").agg(F.sort_array(F.collect_set("idx")).alias("idxs"))


def real_time_factor(audio_s, elapsed_s):
    """Seconds of audio for each second of work, 0 for no work; of columns."""
    return F.when(elapsed_s > 0, audio_s / elapsed_s).otherwise(F.lit(0.0))
