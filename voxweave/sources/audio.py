"""PCM WAV files as rows, and their silent spans. Other codecs need a decoder that is not part of this package."""

from __future__ import annotations

import io
import wave

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxweave.functions.text import suffix

#: Suffixes that are taken for audio.
SUFFIXES = (".mp3", ".wav", ".m4a", ".flac", ".ogg", ".opus", ".aac", ".wma")
#: Those that a batch takes.
BATCH_SUFFIXES = tuple(x for x in SUFFIXES if x != ".wma")
RATE = 16_000


def scan(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """path, length of the audio files under a folder, by path; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.filter(suffix(F.col("path")).isin(*suffixes)).select("path", "length").orderBy("path")


#: Taps of the low-pass filter on each side of a sample, for each sample of the lower rate.
TAPS = 16


def mono(raw: bytes, width: int, channels: int) -> np.ndarray:
    """Frames of PCM as samples from -1 to 1, channels averaged."""
    raw = raw[: len(raw) // (width * channels) * width * channels]
    if width == 3:  # put above an empty byte, so that the sign is in its place
        wide = np.zeros((len(raw) // 3, 4), "u1")
        wide[:, 1:] = np.frombuffer(raw, "u1").reshape(-1, 3)
        x = wide.view("<i4").ravel() / float(1 << 31)
    else:
        x = np.frombuffer(raw, {1: "u1", 2: "<i2", 4: "<i4"}[width]).astype("f8")
        x = (x - 128) / 128 if width == 1 else x / float(1 << (8 * width - 1))
    return x if channels == 1 else x.reshape(-1, channels).mean(axis=1)


def resampled(x: np.ndarray, had: int, rate: int) -> np.ndarray:
    """x at another rate by linear interpolation; on the way down what the lower rate can't hold is taken out by a windowed sinc first."""
    if had == rate or not len(x):
        return x
    if had > rate:
        half = min(len(x) - 1, TAPS * had // rate)
        at = np.arange(-half, half + 1)
        kernel = np.sinc(at * rate * 0.9 / had) * np.hamming(2 * half + 1)
        x = np.convolve(x, kernel / kernel.sum())[half : half + len(x)]
    times = rate // had
    if times * had == rate and times & (times - 1) == 0:  # places between two samples are exact fractions: as np.interp has them, without a search
        out, slope = np.empty((len(x), times)), np.diff(x, append=x[-1:])
        for k in range(times):
            np.add(slope * (k / times), x, out=out[:, k])
        return out.ravel()
    return np.interp(np.arange(int(len(x) * rate / had)) * had / rate, np.arange(len(x)), x)


def samples(content: bytes, rate: int = RATE) -> np.ndarray:
    """Mono samples from -1 to 1 at the given rate."""
    with wave.open(io.BytesIO(content)) as f:
        width, channels, had, raw = f.getsampwidth(), f.getnchannels(), f.getframerate(), f.readframes(f.getnframes())
    return resampled(mono(raw, width, channels), had, rate)


def silent_spans(x: np.ndarray, rate: int = RATE, least_ms: int = 800, dbfs: float = -40.0) -> list[tuple[int, int]]:
    """Spans of at least least_ms, in ms, in which every window of that length is quieter than dbfs."""
    per = rate // 1000
    n = len(x) // per
    if n < least_ms:
        return []
    sums = np.concatenate([[0.0], np.cumsum((x[: n * per] ** 2).reshape(n, per).sum(axis=1))])
    power = (sums[least_ms:] - sums[:-least_ms]) / (least_ms * per)
    quiet = np.flatnonzero(power < 10 ** (dbfs / 10))
    if not len(quiet):
        return []
    breaks = np.flatnonzero(np.diff(quiet) > least_ms)
    firsts, lasts = np.concatenate([[quiet[0]], quiet[breaks + 1]]), np.concatenate([quiet[breaks], [quiet[-1]]])
    return [(int(a), int(b) + least_ms) for a, b in zip(firsts, lasts)]


def encoded(x: np.ndarray, rate: int = RATE) -> bytes:
    """Samples as a WAV file of 16 bits."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate)
        w.writeframes((np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def prepared(content: bytes, rate: int = RATE) -> bytes:
    """What engines are given: the file itself if it is mono of the rate and 16 bits, else its samples as such a file."""
    with wave.open(io.BytesIO(content)) as f:
        if (f.getsampwidth(), f.getnchannels(), f.getframerate()) == (2, 1, rate):
            return content
    return encoded(samples(content, rate), rate)


def readable(files: DataFrame) -> DataFrame:
    """path and error (null if the content can be decoded) of each file."""

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            errors = pa.array([_error(c.as_py()) for c in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), errors], names=["path", "error"])

    return files.select("path", "content").mapInArrow(rows, "path string, error string")


def _error(content: bytes) -> str | None:
    try:
        samples(content, RATE)
    except Exception as e:  # whatever a damaged file leads to
        return f"{type(e).__name__}: {e}"
    return None


def _each(batch, rate: int):
    """path and samples of each file of a batch that can be decoded, one at a time; each is decoded once."""
    for path, content in zip(batch.column(0), batch.column(1), strict=True):
        try:
            x = samples(content.as_py(), rate)
        except Exception:  # whatever a damaged file leads to
            continue
        yield path.as_py(), x


def decoded(files: DataFrame, rate: int = RATE) -> DataFrame:
    """files: path, content -> path, n_samples, duration_s, rms; files that can't be decoded are left out (see readable)."""

    def rows(batches):
        import pyarrow as pa

        schema = pa.schema([("path", pa.string()), ("n_samples", pa.int64()), ("duration_s", pa.float64()), ("rms", pa.float64())])
        for batch in batches:
            found = [{"path": path, "n_samples": len(x), "duration_s": len(x) / rate, "rms": float(np.sqrt(np.mean(x**2))) if len(x) else 0.0} for path, x in _each(batch, rate)]
            yield pa.RecordBatch.from_pylist(found, schema)

    return files.select("path", "content").mapInArrow(rows, "path string, n_samples long, duration_s double, rms double")


def silences(files: DataFrame, least_ms: int = 800, dbfs: float = -40.0) -> DataFrame:
    """files: path, content -> path, start_ms, end_ms."""

    def rows(batches):
        import pyarrow as pa

        schema = pa.schema([("path", pa.string()), ("start_ms", pa.int64()), ("end_ms", pa.int64())])
        for path, x in (found for batch in batches for found in _each(batch, RATE)):
            yield pa.RecordBatch.from_pylist([{"path": path, "start_ms": a, "end_ms": b} for a, b in silent_spans(x, RATE, least_ms, dbfs)], schema)

    return files.select("path", "content").mapInArrow(rows, "path string, start_ms long, end_ms long")
