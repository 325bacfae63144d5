"""PCM WAV recordings read by ranges, so that a long one is read by several tasks and a piece costs its own bytes.

``WavRanges`` is a data source (format ``wav``): a listing by sizes alone, and rows of at most ``rangeBytes`` of a file's
frames each, which begin at whole seconds. A file's contents are never one row, so files may be of any size; small ones share a
task. With ``headers`` it gives one row per file, from its first bytes.

Paths are those of pyarrow's file systems (local ones, file:, s3:, gs:, hdfs:). A file that is no PCM WAV is a row with its error.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from voxweave.sources import audio

ROWS = "path string, size long, rate int, channels int, width int, frames long, first long, pcm binary, error string"
RANGE_BYTES = 8 << 20
#: Format tags of PCM and of the extensible form of a header.
PCM, EXTENSIBLE = 1, 0xFFFE


def opened(path: str):
    """The file system of a path, and the path in it. A scheme with one slash, as Hadoop writes it, is understood."""
    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), path
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    host, _, below = rest.lstrip("/").partition("/")
    system, base = fs.FileSystem.from_uri(f"{scheme}://{host}/")
    return system, f"{base.rstrip('/')}/{below}".lstrip("/") if base else below


@dataclass(frozen=True)
class Header:
    rate: int
    channels: int
    width: int
    frames: int
    #: Where the first frame begins.
    at: int

    @property
    def step(self) -> int:
        return self.channels * self.width

    def frame(self, ms: int) -> int:
        return min(self.frames, max(0, ms) * self.rate // 1000)


def header(file, size: int) -> Header:
    """The header of an open file of a size; chunks before the sound are passed over, not read. ValueError if it is no PCM WAV."""
    if file.read(4) not in (b"RIFF", b"RF64") or len(file.read(4)) < 4 or file.read(4) != b"WAVE":
        raise ValueError("no WAV file")
    at, found, long_data = 12, None, None
    while len(head := file.read(8)) == 8:
        name, length = struct.unpack("<4sI", head)
        at += 8
        if name == b"ds64":
            long_data = struct.unpack("<QQ", file.read(16))[1]
        elif name == b"fmt ":
            body = file.read(min(length, 40))
            tag, channels, rate, _, step, _ = struct.unpack("<HHIIHH", body[:16])
            if tag == EXTENSIBLE and len(body) >= 26:
                tag = struct.unpack("<H", body[24:26])[0]
            if tag != PCM or not channels or not rate or step % channels or step // channels not in (1, 2, 3, 4):
                raise ValueError(f"format {tag} with {channels} channels is no PCM that can be read")
            found = (rate, channels, step // channels)
        elif name == b"data":
            if found is None:
                raise ValueError("no format before the sound")
            length = long_data if length == 0xFFFFFFFF and long_data is not None else length
            # a writer that could not know the length leaves 0 or all ones
            length = min(length, size - at) if 0 < length < 0xFFFFFFFF or long_data is not None else size - at
            return Header(*found, max(0, length) // (found[1] * found[2]), at)
        at += length + length % 2
        file.seek(at)
    raise ValueError("no sound in it")


def pcm(file, found: Header, first: int, last: int) -> bytes:
    """The bytes of the frames from first to last."""
    file.seek(found.at + first * found.step)
    return file.read(max(0, last - first) * found.step)


@dataclass
class Ranges(InputPartition):
    """Ranges of files: path, size and the range's number."""

    of: list[tuple[str, int, int]]


class WavReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.bytes, self.headers = options["path"], int(options.get("rangebytes", RANGE_BYTES)), options.get("headers", "false").lower() == "true"

    def partitions(self) -> list[Ranges]:
        from pyarrow import fs

        system, at = opened(self.path)
        whole = system.get_file_info(at)
        files = [whole] if whole.is_file else system.get_file_info(fs.FileSelector(at, recursive=True))
        prefix = self.path[: len(self.path) - len(at)] if self.path.endswith(at) else ""
        out: list[Ranges] = [Ranges([])]
        filled = 0
        for f in sorted((f for f in files if f.is_file and f.path.lower().endswith(".wav")), key=lambda f: f.path):
            for k in range(1 if self.headers else max(1, -(-f.size // self.bytes))):
                if filled >= self.bytes:
                    out.append(Ranges([]))
                    filled = 0
                out[-1].of.append((prefix + f.path, f.size, k))
                filled += 4096 if self.headers else min(f.size, self.bytes)
        return out

    def read(self, partition: Ranges) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("path", pa.string()), ("size", pa.int64()), ("rate", pa.int32()), ("channels", pa.int32()), ("width", pa.int32()), ("frames", pa.int64()), ("first", pa.int64()), ("pcm", pa.binary()), ("error", pa.string())])
        for path, size, k in partition.of:
            row = dict.fromkeys(schema.names) | {"path": path, "size": size}
            system, at = opened(path)
            try:
                with system.open_input_file(at) as file:
                    found = header(file, size)
                    row |= {"rate": found.rate, "channels": found.channels, "width": found.width, "frames": found.frames}
                    if not self.headers:
                        # the first whole second that begins in the range, up to that of the next
                        each = found.rate * found.step
                        first, last = (min(found.frames, -(-n * self.bytes // each) * found.rate) for n in (k, k + 1))
                        if first == last and (k or found.frames):
                            continue
                        row |= {"first": first, "pcm": pcm(file, found, first, last)}
            except (ValueError, OSError, struct.error) as e:
                if k:
                    continue
                row["error"] = f"{type(e).__name__}: {e}"
            yield pa.RecordBatch.from_pylist([row], schema)


class WavRanges(DataSource):
    """Options: path (a file or a folder), rangeBytes, headers."""

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> WavReader:
        return WavReader(self.options)


def ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """ROWS of the recordings at a path, by ranges."""
    spark.dataSource.register(WavRanges)
    return spark.read.format("wav").option("rangeBytes", str(range_bytes)).load(path)


def headers(spark: SparkSession, path: str) -> DataFrame:
    """path, size, rate, channels, width, frames, error of each recording; sound is not read."""
    spark.dataSource.register(WavRanges)
    return spark.read.format("wav").option("headers", "true").load(path).drop("first", "pcm")


def quiet_runs(sums: np.ndarray, counts: np.ndarray, first_ms: int, least_ms: int, dbfs: float) -> list[tuple[int, int]]:
    """The first and last starts of windows of least_ms whose mean square is below dbfs, starts no more than least_ms apart taken together; sums, counts: of each millisecond."""
    if len(sums) < least_ms:
        return []
    total, n = np.concatenate([[0.0], np.cumsum(sums)]), np.concatenate([[0], np.cumsum(counts)])
    power = (total[least_ms:] - total[:-least_ms]) / np.maximum(1, n[least_ms:] - n[:-least_ms])
    quiet = np.flatnonzero(power < 10 ** (dbfs / 10))
    if not len(quiet):
        return []
    breaks = np.flatnonzero(np.diff(quiet) > least_ms)
    firsts, lasts = np.concatenate([[quiet[0]], quiet[breaks + 1]]), np.concatenate([quiet[breaks], [quiet[-1]]])
    return [(int(a) + first_ms, int(b) + first_ms) for a, b in zip(firsts, lasts)]


RUNS = "array<struct<a: bigint, b: bigint>>"


def silences(sound: DataFrame, least_ms: int = 800, dbfs: float = -40.0) -> DataFrame:
    """sound: ROWS by ranges of at least least_ms -> path, start_ms, end_ms of the silences, as of the whole recordings.

    Each range finds the windows within it. Those across an edge follow from the last milliseconds of a range and the first of
    the next, of which only the sums of squares travel.
    """
    edge = max(0, least_ms - 1)

    def measured(batches):
        import pyarrow as pa

        each = pa.list_(pa.float64())
        schema = pa.schema([("path", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("head", each), ("tail", each), ("head_n", each), ("tail_n", each), ("runs", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))])
        for batch in batches:
            for path, rate, channels, width, first, data in zip(*(batch.column(k) for k in range(6)), strict=True):
                rate, begin = rate.as_py(), first.as_py() * 1000 // rate.as_py()
                x = audio.mono(data.as_py(), width.as_py(), channels.as_py())
                n = len(x) * 1000 // rate
                at = np.arange(n + 1) * rate // 1000
                squares = np.concatenate([[0.0], np.cumsum(x**2)])
                sums, counts = np.diff(squares[at]), np.diff(at).astype("f8")
                found = [{"a": a, "b": b} for a, b in quiet_runs(sums, counts, begin, least_ms, dbfs)]
                low = max(0, n - edge)
                yield pa.RecordBatch.from_pylist([{"path": path.as_py(), "begin": begin, "end": begin + n, "head": sums[:edge], "tail": sums[low:], "head_n": counts[:edge], "tail_n": counts[low:], "runs": found}], schema)

    def joined(batches):
        import pyarrow as pa

        schema = pa.schema([("path", pa.string()), ("a", pa.int64()), ("b", pa.int64())])
        for batch in batches:
            for r in batch.to_pylist():
                found = quiet_runs(np.array(r["tail"] + r["head"]), np.array(r["tail_n"] + r["head_n"]), r["end"] - len(r["tail"]), least_ms, dbfs)
                yield pa.RecordBatch.from_pylist([{"path": r["path"], "a": a, "b": b} for a, b in found], schema)

    good = sound.filter("error is null and pcm is not null").select("path", "rate", "channels", "width", "first", "pcm")
    doubles = "array<double>"
    edges = good.mapInArrow(measured, f"path string, begin long, end long, head {doubles}, tail {doubles}, head_n {doubles}, tail_n {doubles}, runs {RUNS}")
    after = edges.select(F.col("path").alias("_path"), F.col("begin").alias("_begin"), "head", "head_n")
    across = edges.select("path", "end", "tail", "tail_n").join(after, (F.col("path") == F.col("_path")) & (F.col("end") == F.col("_begin")))
    across = across.select("path", "end", "tail", "tail_n", "head", "head_n").mapInArrow(joined, "path string, a long, b long")
    runs = edges.select("path", F.inline("runs")).unionByName(across)
    # a recording's runs, of which there are few
    order = Window.partitionBy("path").orderBy("a", "b")
    last = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = runs.withColumn("begins", F.coalesce(F.col("a") - last > least_ms, F.lit(True)).cast("int"))
    spans = marked.withColumn("span", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return spans.groupBy("path", "span").agg(F.min("a").alias("start_ms"), (F.max("b") + least_ms).alias("end_ms")).drop("span")


def cut(pieces: DataFrame, rate: int = audio.RATE) -> DataFrame:
    """path, idx and content of pieces (source_id, idx, start_ms, end_ms, overlaps) with their padding, as WAV at a rate; each reads its own frames only."""

    def rows(batches):
        import pyarrow as pa

        schema = pa.schema([("path", pa.string()), ("idx", pa.int64()), ("content", pa.binary())])
        for batch in batches:
            for path, idx, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, at = opened(path)
                with system.open_input_file(at) as file:
                    found = header(file, file.size())
                    data = pcm(file, found, found.frame(a), found.frame(b))
                x = audio.resampled(audio.mono(data, found.width, found.channels), found.rate, rate)
                yield pa.RecordBatch.from_pylist([{"path": path, "idx": idx, "content": audio.encoded(x, rate)}], schema)

    span = [(F.col("start_ms") - F.col("overlap_start_ms")).alias("a"), (F.col("end_ms") + F.col("overlap_end_ms")).alias("b")]
    return pieces.select(F.col("source_id").alias("path"), F.col("idx").cast("long").alias("idx"), *span).repartition("path", "idx").mapInArrow(rows, "path string, idx long, content binary")


@dataclass(frozen=True)
class Folder:
    """Recordings at a path, read by ranges: what a job over long recordings needs of them."""

    spark: SparkSession
    path: str
    range_bytes: int = RANGE_BYTES

    def readable(self) -> DataFrame:
        return headers(self.spark, self.path)

    def totals(self) -> DataFrame:
        """source_id, total_ms."""
        good = self.readable().filter("error is null")
        return good.select(F.col("path").alias("source_id"), F.expr("frames * 1000 div rate").alias("total_ms"))

    def silences(self, least_ms: int, dbfs: float) -> DataFrame:
        return silences(ranges(self.spark, self.path, self.range_bytes), least_ms, dbfs)

    def sizes(self) -> DataFrame:
        """source_id, source_size_bytes."""
        return self.readable().select(F.col("path").alias("source_id"), F.col("size").alias("source_size_bytes"))

    def cut(self, pieces: DataFrame) -> DataFrame:
        return cut(pieces)
