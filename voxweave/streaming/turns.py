"""Extensions over streams; the batch operators' rules hold, rows arriving in order within a source.

``labelled_stream`` carries the last speaker forward over micro-batches, with one small state per source.
``closed_turns`` gives each turn when the next speaker begins, or when its source has been still for a while.
``sessions`` groups events by gaps.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from voxweave.functions.text import UNKNOWN


def labelled_stream(segments: DataFrame) -> DataFrame:
    """source_id, seq, speaker (may be null or empty) -> the same with missing speakers carried forward."""

    def step(key: tuple, batches: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        last = state.get[0] if state.exists else UNKNOWN
        pdf = pd.concat(list(batches)).sort_values("seq")
        out = []
        for speaker in pdf.speaker:
            last = speaker or last
            out.append(last)
        state.update((last,))
        yield pdf.assign(speaker=out)[["source_id", "seq", "speaker"]]

    rows = segments.select("source_id", "seq", "speaker")
    return rows.groupBy("source_id").applyInPandasWithState(step, "source_id long, seq long, speaker string", "last string", "append", GroupStateTimeout.NoTimeout)


def closed_turns(segments: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """source_id, seq, speaker, start_ms, end_ms, text (labelled) -> a turn whenever the speaker changes; the last one when no row has come for idle_ms, else it stays open."""

    def step(key: tuple, batches: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        held = state.get if state.exists else None  # turn_index, speaker, start, end, text
        out = []
        if state.hasTimedOut:
            # the next turn's number is kept, with a speaker that none has
            out.append((key[0], *held))
            state.update((held[0], None, held[2], held[3], ""))
        else:
            for r in pd.concat(list(batches)).sort_values("seq").itertuples():
                if held and held[1] == r.speaker:
                    held = (*held[:3], r.end_ms, f"{held[4]} {r.text.strip()}")
                else:
                    if held and held[1] is not None:
                        out.append((key[0], *held))
                    held = (held[0] + 1 if held else 0, r.speaker, r.start_ms, r.end_ms, r.text.strip())
            state.update(held)
            if idle_ms:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["source_id", "turn_index", "speaker", "start_ms", "end_ms", "text"])

    rows = segments.select("source_id", "seq", "speaker", "start_ms", "end_ms", "text")
    shape = "turn_index long, speaker string, start_ms long, end_ms long, text string"
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return rows.groupBy("source_id").applyInPandasWithState(step, f"source_id long, {shape}", shape, "append", timeout)


def sessions(events: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """user_id, ts -> events and value of each session, once the watermark has passed it (or at once over a batch)."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    each = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return each.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")
