"""Cutting long sources at silences, and the pieces that result."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChunkPlan:
    """Lengths in milliseconds. A hard cut never lies before the target."""

    target_ms: int = 600_000
    max_ms: int = 720_000
    window_ms: int = 60_000
    overlap_ms: int = 200

    @property
    def hard_ms(self) -> int:
        return max(self.max_ms, self.target_ms)


def quiet_spans(rows: DataFrame, at: str, quiet: Column, tie: str, least: int) -> DataFrame:
    """Runs of at least ``least`` rows in a row that are quiet: source_id, start_ms, end_ms, n_rows."""
    order = Window.partitionBy("source_id").orderBy(at, tie)
    marked = rows.select("source_id", at, tie, quiet.alias("quiet"), F.sum(F.when(quiet, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("island"))
    spans = marked.filter("quiet").groupBy("source_id", "island").agg(F.min(at).alias("start_ms"), F.max(at).alias("end_ms"), F.count(F.lit(1)).alias("n_rows"))
    return spans.filter(F.col("n_rows") >= least).drop("island")


def cuts_of(total_ms: int, gaps: list[tuple[int, int]], plan: ChunkPlan) -> list[int]:
    """The cuts of one source from its silences in order of their starts.

    A silence is near a target if it reaches into the window around it. Those that begin before the window's end
    are found by their starts, those that end after its start by the largest end up to each, so that a step looks at
    little more than what lies in its window.
    """
    starts = [a for a, _ in gaps]
    reach = list(accumulate((b for _, b in gaps), max))
    cursor, cuts = 0, []
    while cursor + plan.target_ms < total_ms:
        near = cursor + plan.target_ms
        begin, stop = bisect_right(reach, near - plan.window_ms), bisect_left(starts, near + plan.window_ms)
        best = max(((b - a, -k) for k, (a, b) in enumerate(gaps[begin:stop], begin) if b > near - plan.window_ms), default=None)
        middle = sum(gaps[-best[1]]) // 2 if best else -1
        cursor = middle if middle > cursor else cursor + plan.hard_ms
        if cursor < total_ms:
            cuts.append(cursor)
    return cuts


def cut_points(totals: DataFrame, silences: DataFrame, plan: ChunkPlan) -> DataFrame:
    """source_id, total_ms, cuts: at the middle of the longest silence near each target, or hard at the maximum.

    Cuts follow one from another, so a source's silences are taken in order, sources side by side. A silence whose
    middle does not lie beyond the last cut counts as none, and a cut at or past the end is dropped.
    """
    lists = silences.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("start_ms", "end_ms"))).alias("_gaps"))
    rows = totals.select("source_id", "total_ms").join(lists, "source_id", "left")

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            found = [cuts_of(total or 0, [(g["start_ms"], g["end_ms"]) for g in gaps or ()], plan) for total, gaps in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], names=["source_id", "total_ms", "cuts"])

    kind = rows.schema["source_id"].dataType.simpleString()
    return rows.withColumn("total_ms", F.col("total_ms").cast("long")).mapInArrow(cut, f"source_id {kind}, total_ms long, cuts array<long>")


def boundaries(cuts: DataFrame, plan: ChunkPlan) -> DataFrame:
    """source_id, idx, start_ms, end_ms, overlap_start_ms, overlap_end_ms: pieces between cuts, padded within the source."""
    edges = F.concat(F.array(F.lit(0).cast("long")), "cuts", F.array("total_ms"))
    rows = cuts.select("source_id", "total_ms", F.posexplode(edges).alias("idx", "start_ms"))
    rows = rows.withColumn("end_ms", F.lead("start_ms").over(Window.partitionBy("source_id").orderBy("idx"))).filter("end_ms is not null")
    padded_start, padded_end = F.greatest(F.lit(0), F.col("start_ms") - plan.overlap_ms), F.least("total_ms", F.col("end_ms") + plan.overlap_ms)
    return rows.select("source_id", F.col("idx").cast("long").alias("idx"), "start_ms", "end_ms", (F.col("start_ms") - padded_start).cast("long").alias("overlap_start_ms"), (padded_end - F.col("end_ms")).cast("long").alias("overlap_end_ms"))


def chunk_name(source: Column, idx: Column) -> Column:
    """The file name of a piece: its source's stem and its number, of three digits at least."""
    stem = F.regexp_replace(F.regexp_extract(source, r"([^/]+)$", 1), r"\.[^.]*$", "")
    number = F.when(idx < 1000, F.lpad(idx.cast("string"), 3, "0")).otherwise(idx.cast("string"))
    return F.concat(stem, F.lit("_chunk"), number, F.lit(".wav"))
