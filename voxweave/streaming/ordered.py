"""Labels and turns over streams whose rows come in any order within a bound of lateness.

Rows are held in a list state until the watermark has passed their event time, and are then taken in order of seq, so shuffled
micro-batches give what the batch operators give, as long as event times rise with seq. A source that has been still for
``idle`` of event time, be it between two rows, is finished: its open turn is given, and its state dropped; rows that come later begin it anew. Rows
later than the watermark are dropped by Spark. Needs the RocksDB state store (``use_rocksdb``).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from voxweave.functions.text import UNKNOWN

#: Fixed value: the state store that list states and timers need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROW = ("at_ms", "seq", "speaker", "start_ms", "end_ms", "text")
HELD = "at_ms long, seq long, speaker string, start_ms long, end_ms long, text string"
LABEL = "source_id long, seq long, speaker string"
TURN = "source_id long, turn_index long, speaker string, start_ms long, end_ms long, text string"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class _InOrder(StatefulProcessor):
    """Holds rows until the watermark has passed them. taken turns those of a source, in order, into output rows."""

    state_schema = "last string"

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", HELD)
        self.last = handle.getValueState("last", self.state_schema)
        self.seen = handle.getValueState("seen", "at_ms long")  # of the rows taken

    def handleInputRows(self, key: tuple, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        latest = 0
        for pdf in rows:
            self.held.appendList([tuple(None if pd.isna(x) else (int(x) if k in (0, 1, 3, 4) else x) for k, x in enumerate(r)) for r in pdf[list(ROW)].itertuples(index=False)])
            latest = max(latest, int(pdf.at_ms.max()))
        self.handle.registerTimer(latest)
        self.handle.registerTimer(latest + self.idle_ms)
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        now = timerValues.getCurrentWatermarkInMs()
        rows = list(self.held.get())
        ready, rest = sorted((r for r in rows if r[0] <= now), key=lambda r: r[1]), [r for r in rows if r[0] > now]
        at = self.seen.get()[0] if self.seen.exists() else None
        out: list[tuple] = []
        together: list[tuple] = []
        for r in ready:
            if at is not None and r[0] - at >= self.idle_ms:
                out += self._finish(key[0], together)
                together = []
            together.append(r)
            at = r[0] if at is None else max(at, r[0])
        if at is not None and now >= at + self.idle_ms and all(r[0] >= at + self.idle_ms for r in rest):
            out += self._finish(key[0], together)
            self.seen.clear()
        elif together:
            out += self.taken(key[0], together)
            self.seen.update((at,))
        if ready and rest:
            self.held.put(rest)
        elif ready:
            self.held.clear()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in self.output.split(", ")])

    def _finish(self, source, rows: list[tuple]) -> list[tuple]:
        out = (self.taken(source, rows) if rows else []) + self.finished(source)
        self.last.clear()
        return out

    def close(self) -> None:
        pass


class Labels(_InOrder):
    """Each row with its speaker, or the last one before it."""

    output = LABEL

    def taken(self, source, rows: list[tuple]) -> list[tuple]:
        last = self.last.get()[0] if self.last.exists() else UNKNOWN
        out = []
        for r in rows:
            last = r[2] or last
            out.append((source, r[1], last))
        self.last.update((last,))
        return out

    def finished(self, source) -> list[tuple]:
        return []


class Turns(_InOrder):
    """A turn when the speaker changes, and when its source is finished; missing speakers are carried forward."""

    state_schema = "turn_index long, speaker string, start_ms long, end_ms long, text string"
    output = TURN

    def taken(self, source, rows: list[tuple]) -> list[tuple]:
        held = self.last.get() if self.last.exists() else None
        out = []
        for _, _, speaker, start, end, text in rows:
            speaker, text = speaker or (held[1] if held else UNKNOWN), (text or "").strip()
            if held and held[1] == speaker:
                held = (*held[:3], end, f"{held[4]} {text}")
            else:
                if held:
                    out.append((source, *held))
                held = (held[0] + 1 if held else 0, speaker, start, end, text)
        self.last.update(held)
        return out

    def finished(self, source) -> list[tuple]:
        return [(source, *self.last.get())] if self.last.exists() else []


def _streamed(segments: DataFrame, processor: _InOrder, late: str) -> DataFrame:
    rows = segments.withWatermark("ts", late).select("source_id", F.unix_millis("ts").alias("at_ms"), "ts", *ROW[1:])
    return rows.groupBy("source_id").transformWithStateInPandas(processor, processor.output, "Append", "EventTime")


def labelled(segments: DataFrame, late: str = "10 minutes", idle_ms: int = 3_600_000) -> DataFrame:
    """source_id (long), seq, speaker (may be null or empty), ts (event time), start_ms, end_ms, text -> source_id, seq, speaker, in any order of arrival."""
    return _streamed(segments, Labels(idle_ms), late)


def turns(segments: DataFrame, late: str = "10 minutes", idle_ms: int = 3_600_000) -> DataFrame:
    """Rows as in labelled -> TURN of each turn that has ended."""
    return _streamed(segments, Turns(idle_ms), late)
