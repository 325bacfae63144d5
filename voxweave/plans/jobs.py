"""Long-running work over recordings: in units, resumed from what is done, stopped between units, failures noted.

A unit is a micro-batch of pieces that Spark transcribes side by side (streaming.units); its results are appended to a
table in the shared folder before the next unit begins. So a lost executor costs a task, a lost driver a unit.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxweave.operators import align, chunks, halt, models, reassemble, resume
from voxweave.plans import pipeline
from voxweave.shared import saved
from voxweave.sources import audio, checkpoints, recordings
from voxweave.streaming import units as work

#: Recordings as a table of path and content, or as a folder that is read by ranges.
Recordings = DataFrame | pipeline.Contents | recordings.Folder

logger = logging.getLogger(__name__)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def units(pieces: DataFrame, size: int, by: tuple[str, ...] = ("source_id", "idx")) -> DataFrame:
    """pieces with ``unit``, a number below their count / size, drawn by a hash; so units hold about ``size`` of them, without a sort."""
    n = max(1, -(-pieces.count() // size))
    return pieces.withColumn("unit", F.pmod(F.xxhash64(*by), F.lit(n)))


def _live(files: Recordings, pieces: DataFrame) -> DataFrame:
    """source_id, source_size_bytes, total_chunks as they are now."""
    sizes = pipeline.sound(files).sizes()
    return pieces.groupBy("source_id").agg(F.count(F.lit(1)).cast("int").alias("total_chunks")).join(sizes, "source_id")


def transcribe_in_pieces(
    files: Recordings, plan: chunks.ChunkPlan, table: str, transcriber: Callable[[], models.Transcriber] = models.LoudnessTranscriber, unit: int = 64, stop: halt.Halt | None = None, least_ms: int = 800, keep: bool = False, language: str = "es"
) -> tuple[DataFrame, DataFrame]:
    """Segments and headers of long recordings by way of their pieces; table: path of the checkpoint.

    files: a folder read by ranges, of which each piece reads its own bytes, or a table of contents, whose units are of
    whole sources, so that each is decoded in one unit.

    Pieces that the table has, of a source of the same size and number of pieces, are not made again. After each
    unit a halt that was asked for is granted (halt.Halted), and the next call goes on from there. A piece that fails
    raises when all others are done, so that they are kept. The table is removed at the end unless it is to be kept.
    """
    held = pipeline.sound(files)
    spark = held.spark if isinstance(held, recordings.Folder) else held.files.sparkSession
    by = ("source_id", "idx") if isinstance(held, recordings.Folder) else ("source_id",)
    stop = stop or halt.Halt()
    pieces = saved(pipeline.plan_chunks(files, plan, least_ms))
    live = saved(_live(files, pieces))
    have = _usable(spark, table, live)
    todo = saved(units(pieces.join(resume.pending(pieces, have), ["source_id", "idx"], "left_semi"), unit, by))
    total = pieces.count()
    finished = total - todo.count()
    if finished:
        logger.info("resuming: %d of %d pieces are done", finished, total)
    failed = 0

    def made_of(mine: DataFrame, number: int) -> None:
        nonlocal failed, finished
        began = time.perf_counter()
        made = saved(_pieces_made(held, mine, transcriber))
        done = made.filter("status = 'DONE'").select("source_id", "idx", F.struct(F.lit(language).alias("language"), (F.aggregate("segments", F.lit(0).cast("long"), lambda a, s: F.greatest(a, s.end_ms)) / 1000.0).alias("duration"), _as_results("segments").alias("segments")).alias("result"))
        checkpoints.append(done.join(live, "source_id"), table)
        failed += made.filter("status = 'FAILED'").count()
        finished += done.count()
        audio_s = (mine.agg(F.sum(F.col("end_ms") - F.col("start_ms"))).first()[0] or 0) / 1000
        elapsed = time.perf_counter() - began
        logger.info("%d/%d (%d%%): %.0f s of sound in %.0f s, %.1f times real time", finished, total, 100 * finished // max(1, total), audio_s, elapsed, audio_s / elapsed if elapsed > 0 else 0)

    with stop:
        if not todo.isEmpty():
            work.run(todo, made_of, stop, progress=lambda: f"{finished} of {total} pieces")
    if failed:
        raise RuntimeError(f"{failed} of {total} pieces failed; the others are kept in {table}")
    results = saved(_usable(spark, table, live))
    whole = reassemble.matched(results, pieces)
    each = results.select("source_id", "idx", F.posexplode("result.segments").alias("seq", "s"))
    rows = each.select("source_id", "idx", F.col("seq").cast("long").alias("seq"), F.round(F.col("s.start") * 1000).cast("long").alias("start_ms"), F.round(F.col("s.end") * 1000).cast("long").alias("end_ms"), F.col("s.text").alias("text"), F.col("s.confidence").alias("confidence"))
    segments = saved(reassemble.reassembled(rows, whole).select("source_id", "seq", "start_ms", "end_ms", "text", "confidence"))
    heads = saved(reassemble.headers(pieces, results.select("source_id", "idx", F.col("result.language").alias("language"))))
    if not keep:
        remove(spark, table)
    return segments, heads


def _usable(spark: SparkSession, table: str, live: DataFrame) -> DataFrame:
    if not exists(spark, table):
        return spark.createDataFrame([], checkpoints.TABLE)
    return resume.usable(checkpoints.load(spark, table), live)


def _pieces_made(held: pipeline.Contents | recordings.Folder, pieces: DataFrame, transcriber: Callable[[], models.Transcriber]) -> DataFrame:
    """ATTEMPTS of pieces, with idx."""
    named = held.cut(pieces).select(F.concat_ws("\t", "path", F.col("idx").cast("string")).alias("path"), "content")
    parts = F.split("source_id", "\t")
    rows = models.attempted(named, transcriber)
    return rows.select(parts[0].alias("source_id"), parts[1].cast("int").alias("idx"), "status", "error", "segments")


def _as_results(column: str):
    return F.transform(column, lambda s: F.struct((s.start_ms / 1000.0).alias("start"), (s.end_ms / 1000.0).alias("end"), s.text.alias("text"), s.confidence.alias("confidence"), F.lit(None).cast("string").alias("speaker")))


def transcribe_batch(files: DataFrame, transcriber: Callable[[], models.Transcriber] = models.LoudnessTranscriber) -> tuple[DataFrame, DataFrame]:
    """Segments of the files that could be transcribed, and for each file its status, error, seconds of sound and work, and real-time factor."""
    attempts = saved(models.attempted(files, transcriber))
    sound = audio.decoded(files).select(F.col("path").alias("source_id"), "duration_s")
    status = attempts.select("source_id", "status", "error", "elapsed_s").join(sound, "source_id", "left").withColumn("real_time_factor", resume.real_time_factor(F.coalesce("duration_s", F.lit(0.0)), F.col("elapsed_s")))
    return models.segments_of(attempts), saved(status)


def summary(status: DataFrame, elapsed_s: float) -> str:
    """One line on a batch: how many files succeeded, how long their sound and the work were."""
    r = status.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("status") == "DONE").cast("int")).alias("done"), F.sum("duration_s").alias("sound")).first()
    sound = r.sound or 0.0
    return f"{r.done or 0}/{r.n} succeeded, {sound:.0f} s of sound in {elapsed_s:.0f} s, {sound / elapsed_s if elapsed_s > 0 else 0:.1f} times real time"


def transcribe_and_diarize(
    files: DataFrame,
    stage: str,
    transcriber: Callable[[], models.Transcriber] = models.LoudnessTranscriber,
    diarizer: Callable[[], models.Diarizer] = models.AlternatingDiarizer,
    num_speakers: int | None = None,
    flip: bool = False,
    whole: Callable[[], tuple[DataFrame, DataFrame]] | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Turns under interview roles, the segments, and source_id, status and error of each file; stage: path of the stage checkpoint.

    The diarizer is asked for its access before anything costly is done. The finished transcript of each source is kept in the
    stage until its speakers are found, and is used again by a later call if the source still has its size. whole gives segments and
    headers in place of the transcriber, as transcribe_in_pieces does.
    """
    models.check_access(diarizer)
    spark = files.sparkSession
    sizes = files.select(F.col("path").alias("source_id"), F.octet_length("content").cast("long").alias("source_size_bytes"))
    have = spark.createDataFrame([], checkpoints.STAGE)
    if exists(spark, stage):
        have = checkpoints.load_stage(spark, stage, sizes)
    todo = files.join(have.select(F.col("source_id").alias("path")), "path", "left_anti")
    if whole is None:
        attempts = saved(models.attempted(todo, transcriber))
    elif todo.isEmpty():
        attempts = spark.createDataFrame([], models.ATTEMPTS)
    else:
        attempts = saved(_as_attempts(files, *whole()).join(todo.select(F.col("path").alias("source_id")), "source_id", "left_semi"))
    checkpoints.append_stage(attempts.filter("status = 'DONE'").join(sizes, "source_id"), stage)
    transcripts = saved(checkpoints.load_stage(spark, stage, sizes))
    segments = models.segments_of(transcripts.withColumn("status", F.lit("DONE")))
    intervals = models.diarized(files, diarizer, num_speakers)
    turned = saved(align.align(segments, intervals, align.role_map(intervals, flip)))
    failed = attempts.filter("status = 'FAILED'").select("source_id", "status", "error")
    status = saved(transcripts.select("source_id", F.lit("DONE").alias("status"), F.lit(None).cast("string").alias("error")).unionByName(failed))
    remove(spark, stage)
    return turned, segments, status


def _as_attempts(files: DataFrame, segments: DataFrame, heads: DataFrame) -> DataFrame:
    """ATTEMPTS of files whose segments are known; a file without a header failed."""
    said = segments.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("seq", "start_ms", "end_ms", "text", "confidence"))).alias("segments"))
    rows = audio.readable(files).withColumnRenamed("path", "source_id").join(heads.select("source_id", F.lit(True).alias("_has")), "source_id", "left").join(said, "source_id", "left")
    done = F.col("_has").isNotNull()
    none = F.array().cast("array<struct<seq: bigint, start_ms: bigint, end_ms: bigint, text: string, confidence: double>>")
    return rows.select("source_id", F.when(done, "DONE").otherwise("FAILED").alias("status"), F.when(~done, F.coalesce("error", F.lit("no pieces"))).alias("error"), F.lit(0.0).alias("elapsed_s"), F.coalesce("segments", none).alias("segments"))
