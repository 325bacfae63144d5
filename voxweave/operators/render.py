"""Transcripts as text, subtitles and JSON: each renderer gives source_id and body, one row per source.

segments: source_id, seq, start_ms, end_ms, text, confidence; results: source_id, language, duration_ms, source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxweave.functions.text import clock, joined, minute_clock, seconds, srt_time, stripped, word_count
from voxweave.operators.align import full_text, speaker_stats
from voxweave.shared import discard, saved

RULE = "═" * 56
#: Confidences (of four decimals) are averaged as decimals: a mean doesn't depend on the order of rows, and half a unit is rounded up.
EXACT = "decimal(18,12)"


def plain(segments: DataFrame) -> DataFrame:
    return full_text(segments, "seq", stripped(F.col("text")))


def average_confidence(segments: DataFrame, results: DataFrame) -> DataFrame:
    """source_id, avg_confidence; 0 for a source without segments."""
    mean = segments.groupBy("source_id").agg(F.avg(F.col("confidence").cast(EXACT)).cast("double").alias("m"))
    return results.select("source_id").join(mean, "source_id", "left").select("source_id", F.coalesce("m", F.lit(0.0)).alias("avg_confidence"))


def raw_json(segments: DataFrame, results: DataFrame) -> DataFrame:
    item = F.struct(F.round(seconds(F.col("start_ms")), 3).alias("start"), F.round(seconds(F.col("end_ms")), 3).alias("end"), stripped(F.col("text")).alias("text"), "confidence")
    lists = segments.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("seq", item.alias("item")))).alias("items"), F.round(F.avg(F.col("confidence").cast(EXACT)), 4).cast("double").alias("average_confidence"))
    rows = results.join(lists, "source_id", "left")
    body = F.struct(
        "language",
        F.round(seconds(F.col("duration_ms")), 3).alias("duration"),
        F.coalesce("average_confidence", F.lit(0.0)).alias("average_confidence"),
        "source",
        F.coalesce(F.transform("items", lambda x: x["item"]), F.array().cast("array<struct<start:double,end:double,text:string,confidence:double>>")).alias("segments"),
    )
    return rows.select("source_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("body"))


def srt(segments: DataFrame) -> DataFrame:
    number = F.row_number().over(Window.partitionBy("source_id").orderBy("seq"))
    block = F.concat_ws("\n", number.cast("string"), F.concat(srt_time(seconds(F.col("start_ms"))), F.lit(" --> "), srt_time(seconds(F.col("end_ms")))), stripped(F.col("text")), F.lit(""))
    rows = segments.select("source_id", "seq", block.alias("block"))
    return full_text(rows, "seq", F.col("block"), "\n")


def turn_json(turned: DataFrame, results: DataFrame) -> DataFrame:
    segment = lambda s: F.struct(F.round(seconds(s.start_ms), 3).alias("start"), F.round(seconds(s.end_ms), 3).alias("end"), stripped(s.text).alias("text"), s.confidence.alias("confidence"))
    turn = F.struct(
        "turn_index",
        "speaker",
        F.round(seconds(F.col("start_ms")), 3).alias("start"),
        F.round(seconds(F.col("end_ms")), 3).alias("end"),
        F.round(seconds(F.col("end_ms") - F.col("start_ms")), 3).alias("duration"),
        word_count(F.col("text")).alias("word_count"),
        stripped(F.col("text")).alias("text"),
        F.transform("segments", segment).alias("segments"),
    )
    total = F.aggregate("segments", F.lit(0).cast("decimal(28,12)"), lambda a, s: (a + s.confidence.cast(EXACT)).cast("decimal(28,12)"))
    mean = F.sum(total).cast("decimal(28,12)") / F.sum(F.size("segments"))
    lists = turned.groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn_index", turn.alias("t")))), lambda x: x["t"]).alias("turns"), F.round(mean, 4).cast("double").alias("avg_confidence"))
    stats = speaker_stats(turned).groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("place", "speaker", F.struct(F.round("total_speech_s", 2).alias("total_speech_s"), "turn_count", "word_count").alias("s")))).alias("st"))
    rows = results.join(lists, "source_id").join(stats, "source_id")
    body = F.struct(
        F.lit("1.0").alias("schema_version"),
        F.struct("source", F.round(seconds(F.col("duration_ms")), 3).alias("duration_s"), "language", "avg_confidence").alias("metadata"),
        F.map_from_entries(F.transform("st", lambda x: F.struct(x.speaker, x.s))).alias("speakers"),
        "turns",
    )
    return rows.select("source_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("body"))


def turn_text(turned: DataFrame, results: DataFrame) -> DataFrame:
    stats = speaker_stats(turned).groupBy("source_id").agg(joined(F.collect_list(F.struct("place", F.format_string("%s (%d turns, ~%d words)", "speaker", "turn_count", "word_count").alias("text"))), " · ").alias("who"))
    block = F.concat(F.lit("["), F.col("speaker"), F.lit("] "), clock(seconds(F.col("start_ms"))), F.lit("\n"), stripped(F.col("text")), F.lit("\n"))
    blocks = full_text(turned.select("source_id", "turn_index", block.alias("block")), "turn_index", F.col("block"), "\n")
    rows = results.join(stats, "source_id").join(blocks, "source_id")
    name = F.when(F.col("source").isNotNull(), F.concat(F.lit("Source   : "), F.element_at(F.split("source", "/"), -1)))
    head = F.concat_ws("\n", F.lit(RULE), F.lit("Interview transcript"), F.format_string("Duration : %.1f min  |  Language: %s", F.col("duration_ms") / 60000.0, "language"), F.concat(F.lit("Speakers : "), "who"), name, F.lit(RULE), F.lit(""))
    return rows.select("source_id", F.concat_ws("\n", head, F.col("body")).alias("body"))


def preview(turned: DataFrame, most: int = 5, length: int = 120) -> DataFrame:
    """The first turns of each source, cut to a length, and how many more there are."""
    of = Window.partitionBy("source_id")
    rows = turned.select("source_id", "turn_index", "speaker", "start_ms", "text", F.count(F.lit(1)).over(of).alias("n")).filter(F.col("turn_index") < most)
    cut = F.when(F.char_length("text") > length, F.concat(F.substring("text", 1, length), F.lit("…"))).otherwise(F.col("text"))
    line = F.concat(F.lit("["), "speaker", F.lit("] "), minute_clock(seconds(F.col("start_ms"))), F.lit(" "), cut)
    return rows.select("source_id", "turn_index", line.alias("line"), F.greatest(F.lit(0), F.col("n") - most).cast("long").alias("more_turns"))


def segment_lines(segments: DataFrame) -> DataFrame:
    """source_id, seq, line: a segment with its speaker (if it has one), times, confidence and text."""
    speaker = F.when(F.length("speaker") > 0, F.concat(F.lit("["), "speaker", F.lit("] "))).otherwise(F.lit("")) if "speaker" in segments.columns else F.lit("")
    times = F.format_string("[%.1fs → %.1fs] (%.0f%%) ", F.col("start_ms") / 1000.0, F.col("end_ms") / 1000.0, F.col("confidence") * 100)
    return segments.select("source_id", "seq", F.concat(speaker, times, stripped(F.col("text"))).alias("line"))


def turn_lines(turned: DataFrame, length: int = 80) -> DataFrame:
    """source_id, turn_index, line: a turn with its speaker and times, its text cut to a length."""
    times = F.format_string("%.1fs–%.1fs: ", F.col("start_ms") / 1000.0, F.col("end_ms") / 1000.0)
    return turned.select("source_id", "turn_index", F.concat(F.lit("["), "speaker", F.lit("] "), times, F.substring("text", 1, length)).alias("line"))


def summaries(segments: DataFrame, results: DataFrame) -> DataFrame:
    """source_id, line: language, duration, number of segments and mean confidence of each source."""
    n = segments.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), (F.avg(F.col("confidence").cast(EXACT)) * 100).cast("double").alias("m"))
    rows = results.join(n, "source_id", "left")
    line = F.format_string("language=%s, duration=%.1fs, segments=%d, avg_confidence=%.0f%%", "language", F.col("duration_ms") / 1000.0, F.coalesce("n", F.lit(0)), F.coalesce("m", F.lit(0.0)))
    return rows.select("source_id", line.alias("line"))


#: Of turns and results, where the others are of segments.
OF_TURNS = ("transcript.json", "transcript.txt")
#: Suffixes by format name, without regard to case.
FORMATS = {".txt": plain, ".json": raw_json, ".srt": srt, "transcript.json": turn_json, "transcript.txt": turn_text}


def renderer(name: str):
    try:
        return FORMATS[name.lower()]
    except KeyError:
        raise ValueError(f"unknown format {name!r}; known are {', '.join(FORMATS)}") from None


def write(rendered: DataFrame, folder: str, ext: str) -> int:
    """Writes each body (text or bytes) to folder/source_id + ext, on the executors, all or none (see sources.sink); JSON is indented. The number of files.

    The folder must be one that all executors reach by its path.
    """
    from voxweave.sources.sink import Files

    spark = rendered.sparkSession
    spark.dataSource.register(Files)
    rows = saved(rendered.select(F.col("source_id").cast("string").alias("source_id"), "body"))
    rows.write.format(Files.name()).mode("append").option("ext", ext).save(folder)
    n = rows.count()
    discard(rows)
    return n
