"""From recordings to transcripts: the operators of this package put together. Sources are handled side by side."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxweave.functions.text import stripped
from voxweave.operators import align, chunks, models, reassemble, render, resume
from voxweave.shared import saved
from voxweave.sources import audio, recordings


def read(spark: SparkSession, folder: str, batch: bool = True) -> DataFrame:
    """path, content of the WAV files under a folder (batch), or of one file. Other audio needs a decoder that this package does not have."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(batch).lower()).load(folder)
    return files.filter(F.lower("path").endswith(".wav")).select("path", "content")


def transcribe(files: DataFrame, transcriber: Callable[[], models.Transcriber] = models.LoudnessTranscriber) -> DataFrame:
    return models.transcribed(files, transcriber)


@dataclass(frozen=True)
class Contents:
    """Recordings as a table of path and content: what a job over long recordings needs of them. For small ones; a folder is better read by ranges (recordings.Folder)."""

    files: DataFrame

    def totals(self) -> DataFrame:
        """source_id, total_ms."""
        return audio.decoded(self.files).select(F.col("path").alias("source_id"), F.floor(F.col("duration_s") * 1000).alias("total_ms"))

    def silences(self, least_ms: int, dbfs: float) -> DataFrame:
        return audio.silences(self.files, least_ms, dbfs)

    def sizes(self) -> DataFrame:
        """source_id, source_size_bytes."""
        return self.files.select(F.col("path").alias("source_id"), F.octet_length("content").cast("long").alias("source_size_bytes"))

    def cut(self, pieces: DataFrame) -> DataFrame:
        return cut(self.files, pieces)


def sound(files: DataFrame | Contents | recordings.Folder) -> Contents | recordings.Folder:
    return Contents(files) if isinstance(files, DataFrame) else files


def plan_chunks(files: DataFrame | Contents | recordings.Folder, plan: chunks.ChunkPlan, least_ms: int = 800, dbfs: float = -40.0) -> DataFrame:
    """The pieces to which the silences of each recording lead: source_id, idx, start_ms, end_ms and overlaps."""
    held = sound(files)
    gaps = held.silences(least_ms, dbfs).withColumnRenamed("path", "source_id")
    return chunks.boundaries(chunks.cut_points(held.totals(), gaps, plan), plan)


def cut(files: DataFrame, pieces: DataFrame) -> DataFrame:
    """path, idx and content of each piece with its padding, as WAV at audio.RATE. A file is decoded once for all its pieces."""

    def rows(batches):
        import pyarrow as pa

        schema = pa.schema([("path", pa.string()), ("idx", pa.int64()), ("content", pa.binary())])
        for batch in batches:
            for path, content, found in zip(*batch.columns, strict=True):
                x = audio.samples(content.as_py())
                for p in found.as_py():
                    some = audio.encoded(x[max(0, p["a"]) * audio.RATE // 1000 : p["b"] * audio.RATE // 1000])
                    yield pa.RecordBatch.from_pylist([{"path": path.as_py(), "idx": p["idx"], "content": some}], schema)

    span = F.struct("idx", (F.col("start_ms") - F.col("overlap_start_ms")).alias("a"), (F.col("end_ms") + F.col("overlap_end_ms")).alias("b"))
    lists = pieces.groupBy(F.col("source_id").alias("path")).agg(F.sort_array(F.collect_list(span)).alias("pieces"))
    return files.select("path", "content").join(lists, "path").select("path", "content", "pieces").mapInArrow(rows, "path string, idx long, content binary")


def keep_chunks(files: DataFrame | Contents | recordings.Folder, pieces: DataFrame, folder: str) -> int:
    """Writes each piece as a WAV file into a folder that all executors reach; the number of files."""
    named = sound(files).cut(pieces).select(chunks.chunk_name(F.col("path"), F.col("idx")).alias("source_id"), F.col("content").alias("body"))
    return render.write(named, folder, "")


def transcribe_chunked(files: DataFrame, plan: chunks.ChunkPlan, transcriber: Callable[[], models.Transcriber] = models.LoudnessTranscriber, done: DataFrame | None = None, least_ms: int = 800) -> DataFrame:
    """Segments of long recordings by way of their pieces; done (source_id, idx, seq, start_ms, end_ms, text, confidence) holds results of an earlier run, which are not made again."""
    pieces = plan_chunks(files, plan, least_ms)
    todo = pieces if done is None else pieces.join(resume.pending(pieces, done), ["source_id", "idx"], "left_semi")
    named = cut(files, todo).select(F.concat_ws("\t", "path", F.col("idx").cast("string")).alias("path"), "content")
    parts = F.split("source_id", "\t")
    made = models.transcribed(named, transcriber).select(parts[0].alias("source_id"), parts[1].cast("long").alias("idx"), "seq", "start_ms", "end_ms", "text", "confidence")
    merged = reassemble.reassembled(made if done is None else made.unionByName(done), pieces)
    return merged.select("source_id", "seq", "start_ms", "end_ms", "text", "confidence")


def transcribe_and_diarize(files: DataFrame, transcriber=models.LoudnessTranscriber, diarizer=models.AlternatingDiarizer, num_speakers: int | None = None, flip: bool = False) -> DataFrame:
    """Turns of each recording under interview roles."""
    intervals = models.diarized(files, diarizer, num_speakers)
    return align.align(transcribe(files, transcriber), intervals, align.role_map(intervals, flip))


def to_text(segments: DataFrame) -> DataFrame:
    return align.full_text(segments, "seq", stripped(F.col("text")))


def results(segments: DataFrame, language: str = "es") -> DataFrame:
    """The header of each source: source_id, language, duration_ms, source."""
    return segments.groupBy("source_id").agg(F.max("end_ms").alias("duration_ms")).select("source_id", F.lit(language).alias("language"), "duration_ms", F.col("source_id").alias("source"))


STEM = lambda c: F.regexp_replace(F.regexp_extract(c, r"([^/]+)$", 1), r"\.[^.]*$", "")


def export(segments: DataFrame, folder: str, formats: list[str], stem: Callable = STEM, turned: DataFrame | None = None, head: DataFrame | None = None) -> dict[str, int]:
    """Writes formats of each source under its file's name; files by format.

    Raw formats are of segments, those of render.OF_TURNS of turned, which they need. The tables are written to the shared
    folder first, so that models run once, however many formats there are.
    """
    segments = saved(segments)
    head = saved(results(segments) if head is None else head)
    turned = saved(turned) if turned is not None else None
    out = {}
    for name in formats:
        make = render.renderer(name)
        if name.lower() in render.OF_TURNS:
            if turned is None:
                raise ValueError(f"{name} needs turns")
            rendered = make(turned, head)
        else:
            rendered = make(segments, head) if make is render.raw_json else make(segments)
        out[name] = render.write(rendered.withColumn("source_id", stem(F.col("source_id"))), folder, name if name.startswith(".") else f".{name}")
    return out
