"""Engines and turns as table functions of SQL, with their options as arguments.

``register`` makes them known by name: ``SELECT * FROM transcribe(TABLE(SELECT path, content FROM files), engine => 'loudness')``,
``diarize(TABLE(...), engine => ..., num_speakers => 2)`` and ``speaker_turns(TABLE(SELECT source_id, seq, speaker, start_ms, end_ms,
text FROM labelled))``. What a call can't mean (an unknown engine, missing columns) is an error of analysis, before any row is read.
An engine is made once per partition; a file that fails is a row with its error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from voxweave.config import Options
from voxweave.functions.text import UNKNOWN
from voxweave.operators import models



def _schema(*fields: str) -> StructType:
    """A schema from words "name type", which a worker has no parser for."""
    kinds = {"string": StringType(), "long": LongType(), "double": DoubleType()}
    return StructType([StructField(*(kinds.get(x, x) for x in f.split())) for f in fields])


SAID = _schema("source_id string", "status string", "error string", "seq long", "start_ms long", "end_ms long", "text string", "confidence double")
SPOKE = _schema("source_id string", "status string", "error string", "dseq long", "speaker string", "start_ms long", "end_ms long")
TURN = _schema("turn_index long", "speaker string", "start_ms long", "end_ms long", "text string", "n_segments long")
FILES = ("path", "content")
LABELLED = ("source_id", "seq", "speaker", "start_ms", "end_ms", "text")


def _columns(rows: AnalyzeArgument, wanted: tuple[str, ...]) -> None:
    if not rows.isTable:
        raise ValueError("the first argument is a table: TABLE(...)")
    missing = [c for c in wanted if c not in rows.dataType.fieldNames()]
    if missing:
        raise ValueError(f"the table has no {', '.join(missing)}")


def _options(known: dict, engine: str, given: dict[str, object]) -> tuple[object, Options]:
    """The engine's class and the options, checked; given: those that are not null."""
    if engine not in known:
        raise ValueError(f"unknown engine {engine!r}; known are {', '.join(known)}")
    return known[engine], Options(**{k: v for k, v in given.items() if v is not None})


def _value(argument: AnalyzeArgument | None) -> object:
    if argument is not None and argument.isConstantExpression is False:
        raise ValueError("options are constants")
    return None if argument is None else argument.value


@udtf
class Transcribe:
    """Segments of each file; options are those of config.Options."""

    @staticmethod
    def analyze(files: AnalyzeArgument, engine: AnalyzeArgument | None = None, language: AnalyzeArgument | None = None, model_size: AnalyzeArgument | None = None, beam_size: AnalyzeArgument | None = None, vad_filter: AnalyzeArgument | None = None) -> AnalyzeResult:
        _columns(files, FILES)
        _options(models.ENGINES, _value(engine) or "loudness", {"language": _value(language), "model_size": _value(model_size), "beam_size": _value(beam_size), "vad_filter": _value(vad_filter)})
        return AnalyzeResult(schema=SAID)

    def __init__(self) -> None:
        self.model = None

    def eval(self, files: Row, engine: str = "loudness", language: str | None = None, model_size: str | None = None, beam_size: int | None = None, vad_filter: bool | None = None) -> Iterator[tuple]:
        from voxweave.sources.audio import prepared

        if self.model is None:
            kind, options = _options(models.ENGINES, engine or "loudness", {"language": language, "model_size": model_size, "beam_size": beam_size, "vad_filter": vad_filter})
            if vad_filter is None:
                options = Options(**{**vars(options), "vad_filter": False})
            self.model = models.configured(kind, options)()
        try:
            said = list(self.model.transcribe(files["path"], prepared(bytes(files["content"]))))
        except Exception as e:  # whatever a file or an engine leads to
            yield files["path"], "FAILED", f"{type(e).__name__}: {e}", None, None, None, None, None
            return
        for seq, s in enumerate(said):
            yield files["path"], "DONE", None, seq, s.start_ms, s.end_ms, s.text, round(min(1.0, max(0.0, math.exp(s.avg_logprob))), 4)


@udtf
class Diarize:
    """Speaker intervals of each file, in order of their starts."""

    @staticmethod
    def analyze(files: AnalyzeArgument, engine: AnalyzeArgument | None = None, num_speakers: AnalyzeArgument | None = None) -> AnalyzeResult:
        _columns(files, FILES)
        kind, _ = _options(models.DIARIZERS, _value(engine) or "alternating", {})
        models.check_access(kind)
        count = _value(num_speakers)
        if count is not None and count < 1:
            raise ValueError("num_speakers is one at least")
        return AnalyzeResult(schema=SPOKE)

    def __init__(self) -> None:
        self.model = None

    def eval(self, files: Row, engine: str = "alternating", num_speakers: int | None = None) -> Iterator[tuple]:
        from voxweave.sources.audio import prepared

        self.model = self.model or models.DIARIZERS[engine or "alternating"]()
        try:
            found = sorted(self.model.diarize(files["path"], prepared(bytes(files["content"])), num_speakers), key=lambda x: x[1])
        except Exception as e:  # as above
            yield files["path"], "FAILED", f"{type(e).__name__}: {e}", None, None, None, None
            return
        for k, (speaker, a, b) in enumerate(found):
            yield files["path"], "DONE", None, k, speaker, a, b


@udtf
class SpeakerTurns:
    """Turns of each source, whose rows come to one instance in order; missing speakers are taken from the row before.

    For sources that a task can hold one turn at a time of; align.turns deals longer ones to several tasks.
    """

    @staticmethod
    def analyze(segments: AnalyzeArgument) -> AnalyzeResult:
        _columns(segments, LABELLED)
        source = next(f.dataType for f in segments.dataType.fields if f.name == "source_id")
        return AnalyzeResult(schema=StructType([StructField("source_id", source), *TURN.fields]), partitionBy=[PartitioningColumn("source_id")], orderBy=[OrderingColumn("seq")])

    def __init__(self) -> None:
        self.open: list | None = None
        self.texts: list[str] = []

    def eval(self, segments: Row) -> Iterator[tuple]:
        speaker = segments["speaker"] or (self.open[2] if self.open else UNKNOWN)
        if self.open is not None and self.open[2] == speaker:
            self.open[4] = segments["end_ms"]
        else:
            yield from self.terminate()
            self.open, self.texts = [segments["source_id"], self.open[1] + 1 if self.open else 0, speaker, segments["start_ms"], segments["end_ms"]], []
        self.texts.append((segments["text"] or "").strip())

    def terminate(self) -> Iterator[tuple]:
        if self.open is not None:
            yield (*self.open, " ".join(self.texts), len(self.texts))


NAMES = {"transcribe": Transcribe, "diarize": Diarize, "speaker_turns": SpeakerTurns}


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL, by NAMES."""
    for name, function in NAMES.items():
        spark.udtf.register(name, function)
