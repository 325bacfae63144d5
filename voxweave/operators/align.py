"""Who speaks when: overlap of segments with speaker intervals, turns, and figures about speakers.

segments: source_id, seq, start_ms, end_ms, text, ...; diarization: source_id, dseq, speaker, start_ms, end_ms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxweave.functions.text import UNKNOWN, joined, seconds, stripped, word_count
from voxweave.operators import scan

INTERVIEWER, INTERVIEWEE = "INTERVIEWER", "INTERVIEWEE"


#: Stretches of time by which segments and intervals are dealt beside their source.
BUCKET_MS = 300_000


def overlaps(segments: DataFrame, diarization: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """One row per segment and interval of a source that overlap: source_id, seq, dseq, speaker, overlap_ms.

    Both sides are dealt by source and stretch of time, so that a long source is spread over tasks and a segment
    meets only the intervals of its stretches; a pair is kept only in the stretch where its overlap begins.
    """
    left = segments.select("source_id", "seq", F.col("start_ms").alias("s0"), F.col("end_ms").alias("e0"))
    right = diarization.select("source_id", "dseq", "speaker", F.col("start_ms").alias("s1"), F.col("end_ms").alias("e1"))
    begins = F.greatest("s0", "s1")
    spread = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bucket_ms), F.floor(F.greatest(F.col(a), F.col(b)) / bucket_ms)))
    met = left.withColumn("bucket", spread("s0", "e0")).join(right.withColumn("bucket", spread("s1", "e1")), ["source_id", "bucket"])
    met = met.filter((F.col("s0") < F.col("e1")) & (F.col("e0") > F.col("s1")) & (F.col("bucket") == F.floor(begins / bucket_ms)))
    return met.select("source_id", "seq", "dseq", "speaker", (F.least("e0", "e1") - begins).alias("overlap_ms")).filter("overlap_ms > 0")


def overlap_by_speaker(segments: DataFrame, diarization: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    met = overlaps(segments, diarization, bucket_ms)
    return met.groupBy("source_id", "seq", "speaker").agg(F.sum("overlap_ms").alias("overlap_ms"), F.min("dseq").alias("first_dseq"))


def dominant(segments: DataFrame, diarization: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Segments with the speaker of the largest overlap, the one met first on a tie; null without any."""
    best = overlap_by_speaker(segments, diarization, bucket_ms).groupBy("source_id", "seq").agg(F.max(F.struct("overlap_ms", (-F.col("first_dseq")).alias("d"), "speaker")).alias("m"))
    return segments.join(best.select("source_id", "seq", F.col("m.speaker").alias("speaker")), ["source_id", "seq"], "left")


def carried(labelled: DataFrame, stretch: int = scan.STRETCH) -> DataFrame:
    """Missing and empty speakers taken from the segment before, UNKNOWN before the first."""
    found = scan.numbered(labelled, F.nullif("speaker", F.lit("")), F.lit(UNKNOWN), stretch)
    return found.withColumn("speaker", F.col("_label")).select(*labelled.columns)


def turns(labelled: DataFrame, carry: bool = False, stretch: int = scan.STRETCH) -> DataFrame:
    """Runs of segments of one speaker: source_id, turn_index, speaker, start_ms, end_ms (of the last segment), text, n_segments, segments.

    carry: missing and empty speakers are first taken from the segment before; else they are a speaker of their own.
    """
    if carry:
        rows = scan.numbered(labelled, F.nullif("speaker", F.lit("")), F.lit(UNKNOWN), stretch).withColumn("speaker", F.col("_label"))
    else:
        rows = scan.numbered(labelled, F.struct("speaker"), F.struct(F.lit(None).cast("string").alias("speaker")), stretch)
    rows = rows.withColumnRenamed("_run", "turn_index")
    pieces = F.collect_list(F.struct("seq", stripped(F.col("text")).alias("text")))
    nested = F.array_sort(F.collect_list(F.struct("seq", "start_ms", "end_ms", "text", "confidence"))) if "confidence" in labelled.columns else F.array_sort(F.collect_list(F.struct("seq", "start_ms", "end_ms", "text")))
    return rows.groupBy("source_id", "turn_index").agg(
        F.coalesce(F.first("speaker"), F.lit(UNKNOWN)).alias("speaker"),
        F.min_by("start_ms", "seq").alias("start_ms"),
        F.max_by("end_ms", "seq").alias("end_ms"),
        joined(pieces, " ").alias("text"),
        F.count(F.lit(1)).alias("n_segments"),
        nested.alias("segments"),
    )


def align(segments: DataFrame, diarization: DataFrame, roles: DataFrame | None = None) -> DataFrame:
    """Turns of segments, labelled by roles (source_id, speaker, role) where they are given."""
    if roles is not None:
        diarization = with_roles(diarization, roles)
    return turns(dominant(segments, diarization), carry=True)


def speech_totals(diarization: DataFrame) -> DataFrame:
    return diarization.groupBy("source_id", "speaker").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("total_ms"), F.min("dseq").alias("first_dseq"))


def role_map(diarization: DataFrame, flip: bool = False) -> DataFrame:
    """source_id, speaker, role: who speaks least asks, who speaks next least answers, others are numbered."""
    rank = F.row_number().over(Window.partitionBy("source_id").orderBy("total_ms", "first_dseq")) - 1
    two = (INTERVIEWEE, INTERVIEWER) if flip else (INTERVIEWER, INTERVIEWEE)
    role = F.when(rank == 0, two[0]).when(rank == 1, two[1]).otherwise(F.concat(F.lit("SPEAKER_"), rank.cast("string")))
    return speech_totals(diarization).select("source_id", "speaker", role.alias("role"))


def with_roles(diarization: DataFrame, roles: DataFrame) -> DataFrame:
    """Intervals under their speakers' roles; a speaker without one keeps its label."""
    both = diarization.join(roles.select("source_id", "speaker", "role"), ["source_id", "speaker"], "left")
    return both.withColumn("speaker", F.coalesce("role", "speaker")).drop("role")


def speaker_stats(turned: DataFrame) -> DataFrame:
    """source_id, speaker, total_speech_s, turn_count, word_count, place: speakers in the order in which they first speak."""
    each = turned.groupBy("source_id", "speaker").agg(
        F.sum(F.col("end_ms") - F.col("start_ms")).alias("total_ms"), F.count(F.lit(1)).alias("turn_count"), F.sum(word_count(F.col("text"))).alias("word_count"), F.min("turn_index").alias("first_turn")
    )
    place = F.row_number().over(Window.partitionBy("source_id").orderBy("first_turn"))
    return each.select("source_id", "speaker", seconds(F.col("total_ms")).alias("total_speech_s"), "turn_count", "word_count", (place - 1).cast("long").alias("place"), "total_ms")


def speech_share(turned: DataFrame) -> DataFrame:
    """Each speaker's percentage of the speech of its source."""
    rows = speaker_stats(turned)
    whole = F.sum("total_ms").over(Window.partitionBy("source_id"))
    return rows.select("source_id", "speaker", (F.col("total_ms") * 100.0 / F.when(whole == 0, 1000).otherwise(whole)).alias("share_pct"))


def full_text(rows: DataFrame, order: str, text: Column, by: str = " ") -> DataFrame:
    return rows.groupBy("source_id").agg(joined(F.collect_list(F.struct(F.col(order), text.alias("text"))), by).alias("body"))
