"""Speech and speaker models as table functions.

A transcriber maps (path, content) to segments, a diarizer to speaker intervals. Models are made once per
Python worker by a factory that is sent in their place. The stubs stand in for neural models, which are not
part of this package: they cut the signal by loudness alone, always in the same way, and say nothing of quality.
"""

from __future__ import annotations

import hashlib
import inspect
import math
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, fields
from functools import partial
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One row per file; segments as in SEGMENTS, without the source.
ATTEMPTS = "source_id string, status string, error string, elapsed_s double, segments array<struct<seq: bigint, start_ms: bigint, end_ms: bigint, text: string, confidence: double>>"
SEGMENTS = "source_id string, seq long, start_ms long, end_ms long, text string, confidence double"
INTERVALS = "source_id string, dseq long, speaker string, start_ms long, end_ms long"
_made: dict[object, object] = {}


@dataclass(frozen=True)
class Spoken:
    start_ms: int
    end_ms: int
    text: str
    avg_logprob: float


@runtime_checkable
class Transcriber(Protocol):
    def transcribe(self, path: str, content: bytes) -> Iterable[Spoken]: ...


@runtime_checkable
class Diarizer(Protocol):
    def diarize(self, path: str, content: bytes, num_speakers: int | None = None) -> Iterable[tuple[str, int, int]]: ...


def _loud(content: bytes, least_ms: int) -> list[tuple[int, int]]:
    from voxweave.sources.audio import RATE, samples, silent_spans

    x = samples(content)
    end, at, out = len(x) * 1000 // RATE, 0, []
    for a, b in silent_spans(x, RATE, least_ms):
        if a > at:
            out.append((at, a))
        at = b
    return out + ([(at, end)] if end > at else [])


class LoudnessTranscriber:
    """One segment per loud stretch; its text says how long it is. With vad_filter, stretches below vad_min_speech_duration_ms are left out."""

    def __init__(self, least_ms: int = 300, vad_filter: bool = False, vad_min_speech_duration_ms: int = 250):
        self.least_ms, self.shortest_ms = least_ms, vad_min_speech_duration_ms if vad_filter else 0

    def transcribe(self, path: str, content: bytes) -> Iterable[Spoken]:
        for a, b in _loud(content, self.least_ms):
            if b - a < self.shortest_ms:
                continue
            yield Spoken(a, b, f"{b - a} ms of sound", -0.1)


class AlternatingDiarizer:
    """Loud stretches in turn for each of num_speakers (two if none is given); they never overlap."""

    def __init__(self, least_ms: int = 300):
        self.least_ms = least_ms

    def diarize(self, path: str, content: bytes, num_speakers: int | None = None) -> Iterable[tuple[str, int, int]]:
        for k, (a, b) in enumerate(_loud(content, self.least_ms)):
            yield f"SPEAKER_{k % (num_speakers or 2):02d}", a, b


#: Engines by name.
ENGINES: dict[str, Callable[[], Transcriber]] = {"loudness": LoudnessTranscriber}
DIARIZERS: dict[str, Callable[[], Diarizer]] = {"alternating": AlternatingDiarizer}


def configured(engine: Callable[..., object], options: object) -> Callable[[], object]:
    """A factory of the engine with those options (a dataclass) that its parameters name."""
    wanted = inspect.signature(engine).parameters
    return partial(engine, **{f.name: getattr(options, f.name) for f in fields(options) if f.name in wanted})


def check_access(factory: Callable[[], object]) -> None:
    """Asks an engine that has check_access for it, which raises where its model can't be had."""
    ask = getattr(factory(), "check_access", None)
    if ask is not None:
        ask()


def _key(factory: Callable[[], object]) -> str:
    """What tells a factory from others: its code and all that it holds, not only its name."""
    from pyspark import cloudpickle

    return hashlib.sha256(cloudpickle.dumps(factory)).hexdigest()


def _model(factory: Callable[[], object], key: str) -> object:
    if key not in _made:
        _made[key] = factory()
    return _made[key]


def attempted(files: DataFrame, factory: Callable[[], Transcriber] = LoudnessTranscriber) -> DataFrame:
    """files: path, content -> ATTEMPTS: status DONE, or FAILED with the error; a file that fails leaves the others alone. Halted ends the job."""
    key = _key(factory)

    def rows(batches):
        import pyarrow as pa

        from voxweave.operators.halt import Halted
        from voxweave.sources.audio import prepared

        segment = pa.struct([("seq", pa.int64()), ("start_ms", pa.int64()), ("end_ms", pa.int64()), ("text", pa.string()), ("confidence", pa.float64())])
        schema = pa.schema([("source_id", pa.string()), ("status", pa.string()), ("error", pa.string()), ("elapsed_s", pa.float64()), ("segments", pa.list_(segment))])
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                began, error, segments = time.perf_counter(), None, []
                path = path.as_py()
                try:
                    for seq, s in enumerate(_model(factory, key).transcribe(path, prepared(content.as_py()))):
                        segments.append({"seq": seq, "start_ms": s.start_ms, "end_ms": s.end_ms, "text": s.text, "confidence": round(min(1.0, max(0.0, math.exp(s.avg_logprob))), 4)})
                except Halted:
                    raise
                except Exception as e:  # whatever a file or an engine leads to
                    error, segments = f"{type(e).__name__}: {e}", []
                row = {"source_id": path, "status": "FAILED" if error else "DONE", "error": error, "elapsed_s": time.perf_counter() - began, "segments": segments}
                yield pa.RecordBatch.from_pylist([row], schema)

    return files.select("path", "content").mapInArrow(rows, ATTEMPTS)


def segments_of(attempts: DataFrame) -> DataFrame:
    """SEGMENTS of the attempts that are DONE."""
    rows = attempts.filter("status = 'DONE'").select("source_id", F.explode("segments").alias("s"))
    return rows.select("source_id", "s.seq", "s.start_ms", "s.end_ms", "s.text", "s.confidence")


def transcribed(files: DataFrame, factory: Callable[[], Transcriber] = LoudnessTranscriber) -> DataFrame:
    """files: path, content -> the segments of each, source_id being the path; files that fail have none (see attempted)."""
    return segments_of(attempted(files, factory))


def diarized(files: DataFrame, factory: Callable[[], Diarizer] = AlternatingDiarizer, num_speakers: int | None = None) -> DataFrame:
    """files: path, content -> the speaker intervals of each in order of their start; files that can't be decoded have none."""
    key = _key(factory)

    def rows(batches):
        import pyarrow as pa

        from voxweave.sources.audio import _error, prepared

        schema = pa.schema([("source_id", pa.string()), ("dseq", pa.int64()), ("speaker", pa.string()), ("start_ms", pa.int64()), ("end_ms", pa.int64())])
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                data = content.as_py()
                if _error(data) is None:
                    found = sorted(_model(factory, key).diarize(path.as_py(), prepared(data), num_speakers), key=lambda x: x[1])
                    yield pa.RecordBatch.from_pylist([{"source_id": path.as_py(), "dseq": k, "speaker": speaker, "start_ms": a, "end_ms": b} for k, (speaker, a, b) in enumerate(found)], schema)

    return files.select(F.col("path"), F.col("content")).mapInArrow(rows, INTERVALS)
