"""The queries of the transcript engine by name: functions of (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxweave.functions.text import UNKNOWN, clock, seconds, srt_time, stripped
from voxweave.operators import align, chunks, reassemble, render, resume, table_functions
from voxweave.plans.sql import SQL
from voxweave.shared import saved
from voxweave.sources import audio, checkpoints, fixtures

__all__ = ["QUERIES", "SQL"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: The plan over users' event times: two days, two and a half at most, a quarter of an hour about the target.
PLAN = chunks.ChunkPlan(target_ms=172_800_000, max_ms=216_000_000, window_ms=900_000)


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def _dominant(spark, d):
    return align.dominant(fixtures.segments(spark, d), fixtures.diarization(spark, d))


def _turns(spark, d):
    return align.turns(_dominant(spark, d), carry=True)


def _results(spark, d):
    ends = fixtures.segments(spark, d).groupBy("source_id").agg(F.max("end_ms").alias("duration_ms"))
    return ends.select("source_id", F.lit("es").alias("language"), "duration_ms", F.when(F.col("source_id") % 3 != 0, F.concat(F.lit("/audio/"), F.col("source_id").cast("string"), F.lit(".wav"))).alias("source"))


def _done(spark, d):
    return fixtures.chunk_results(spark, d).filter((F.col("source_id") + F.col("idx")) % 3 != 0).select("source_id", "idx").distinct()


def _timed(turned):
    return turned.select("source_id", "turn_index", "speaker", seconds(F.col("start_ms")).alias("start_s"), seconds(F.col("end_ms")).alias("end_s"), "text", "n_segments")


@query
def segment_duration(spark, d):
    return fixtures.segments(spark, d).select("source_id", "seq", seconds(F.col("end_ms") - F.col("start_ms")).alias("duration_s"))


@query
def logprob_confidence(spark, d):
    return fixtures.segments(spark, d).select("source_id", "seq", "confidence")


@query
def srt_times(spark, d):
    return fixtures.segments(spark, d).select("source_id", "seq", srt_time(seconds(F.col("start_ms"))).alias("begins"), srt_time(seconds(F.col("end_ms"))).alias("ends"))


@query
def hms_time(spark, d):
    return fixtures.segments(spark, d).select("source_id", "seq", clock(seconds(F.col("start_ms"))).alias("begins"))


@query
def overlap_by_speaker(spark, d):
    return align.overlap_by_speaker(fixtures.segments(spark, d), fixtures.diarization(spark, d)).select("source_id", "seq", "speaker", "overlap_ms")


@query
def interval_align(spark, d):
    return _dominant(spark, d).select("source_id", "seq", "speaker")


@query
def carry_forward(spark, d):
    return align.carried(_dominant(spark, d)).select("source_id", "seq", "speaker")


@query
def align_unknown(spark, d):
    nobody = fixtures.diarization(spark, d).limit(0)
    return align.carried(align.dominant(fixtures.segments(spark, d), nobody)).select("source_id", "seq", "speaker")


@query
def turns(spark, d):
    return _timed(_turns(spark, d))


@query
def speaker_stats(spark, d):
    return align.speaker_stats(_turns(spark, d)).drop("total_ms")


@query
def speech_share(spark, d):
    return align.speech_share(_turns(spark, d))


@query
def speech_totals(spark, d):
    return align.speech_totals(fixtures.diarization(spark, d)).select("source_id", "speaker", seconds(F.col("total_ms")).alias("total_s"))


@query
def speakers_found(spark, d):
    return fixtures.diarization(spark, d).groupBy("source_id").agg(F.array_join(F.sort_array(F.collect_set("speaker")), ",").alias("speakers"))


@query
def diar_sorted(spark, d):
    place = F.row_number().over(Window.partitionBy("source_id").orderBy("start_ms", "dseq")) - 1
    return fixtures.diarization(spark, d).select("source_id", place.cast("long").alias("place"), "speaker", "start_ms", "end_ms")


@query
def role_map(spark, d):
    return align.role_map(fixtures.diarization(spark, d))


@query
def role_map_flipped(spark, d):
    return align.role_map(fixtures.diarization(spark, d), flip=True)


def _of_role(spark, d, role):
    roles = align.role_map(fixtures.diarization(spark, d)).filter(F.col("role") == role)
    return _turns(spark, d).join(roles, ["source_id", "speaker"]).select("source_id", "turn_index", "speaker", "role")


@query
def role_filter(spark, d):
    return _of_role(spark, d, align.INTERVIEWEE)


@query
def role_filter_interviewer(spark, d):
    return _of_role(spark, d, align.INTERVIEWER)


@query
def align_full(spark, d):
    diarization = fixtures.diarization(spark, d)
    return _timed(align.align(fixtures.segments(spark, d), diarization, align.role_map(diarization)))


@query
def avg_confidence(spark, d):
    out = render.average_confidence(fixtures.segments(spark, d), _results(spark, d))
    return out.select("source_id", F.round("avg_confidence", 4).alias("avg_confidence"))


@query
def full_text(spark, d):
    return align.full_text(fixtures.segments(spark, d), "seq", stripped(F.col("text")))


@query
def labelled_text(spark, d):
    return align.full_text(_turns(spark, d), "turn_index", F.concat(F.lit("["), F.col("speaker"), F.lit("] "), F.col("text")), "\n\n")


@query
def preview_turns(spark, d):
    return render.preview(_turns(spark, d))


@query
def render_txt(spark, d):
    return render.plain(fixtures.segments(spark, d))


@query
def render_srt(spark, d):
    return render.srt(fixtures.segments(spark, d))


@query
def render_json(spark, d):
    return render.raw_json(fixtures.segments(spark, d), _results(spark, d))


@query
def render_turn_txt(spark, d):
    return render.turn_text(_turns(spark, d), _results(spark, d))


@query
def render_turn_json(spark, d):
    rows = render.turn_json(_turns(spark, d), _results(spark, d))
    part = lambda path: F.get_json_object("body", path)
    who = F.from_json(part("$.speakers"), "map<string,struct<total_speech_s:double,turn_count:bigint,word_count:bigint>>")
    named = F.transform(F.map_entries(who), lambda e: F.concat_ws(":", e.key, e.value.turn_count.cast("string"), e.value.word_count.cast("string")))
    return rows.select("source_id", F.json_array_length(part("$.turns")).cast("long").alias("n_turns"), part("$.turns").alias("turns"), F.array_join(named, ",").alias("speakers"), part("$.metadata.duration_s").cast("double").alias("duration_s"), part("$.metadata.avg_confidence").cast("double").alias("avg_confidence"))


@query
def json_roundtrip(spark, d):
    item = "struct<seq:bigint,start_ms:bigint,end_ms:bigint,text:string,confidence:double>"
    packed = fixtures.segments(spark, d).groupBy("source_id").agg(F.to_json(F.collect_list(F.struct("seq", "start_ms", "end_ms", "text", "confidence"))).alias("doc"))
    return packed.select("source_id", F.inline_outer(F.from_json("doc", f"array<{item}>")))


@query
def silence_rows(spark, d):
    return chunks.quiet_spans(fixtures.offsets(spark, d), "at_ms", F.col("value") < 20, "event_id", 3)


@query
def cut_points(spark, d):
    cuts = chunks.cut_points(fixtures.totals(spark, d), fixtures.silences(spark, d), PLAN)
    return cuts.select("source_id", F.posexplode("cuts").alias("cut_index", "cut_ms")).withColumn("cut_index", F.col("cut_index").cast("long"))


@query
def chunk_boundaries(spark, d):
    return chunks.boundaries(chunks.cut_points(fixtures.totals(spark, d), fixtures.silences(spark, d), PLAN), PLAN)


@query
def shift_timestamps(spark, d):
    return reassemble.shifted(fixtures.chunk_results(spark, d), fixtures.chunks(spark, d)).select("source_id", "idx", "seq", "start_ms", "end_ms")


@query
def overlap_drop(spark, d):
    moved = reassemble.shifted(fixtures.chunk_results(spark, d), fixtures.chunks(spark, d))
    return reassemble.without_start_overlap(moved).select("source_id", "idx", "seq", "start_ms", "end_ms")


@query
def reassemble_rows(spark, d):
    return reassemble.concatenated(fixtures.chunk_results(spark, d), fixtures.chunks(spark, d))


@query
def boundary_dedup(spark, d):
    return reassemble.reassembled(fixtures.chunk_results(spark, d), fixtures.chunks(spark, d))


@query
def tail_head_words(spark, d):
    return reassemble.edge_words(fixtures.chunk_results(spark, d))


@query
def accumulated_tails(spark, d):
    return reassemble.accumulated_tails(reassemble.without_start_overlap(reassemble.shifted(fixtures.chunk_results(spark, d), fixtures.chunks(spark, d))))


@query
def similarity(spark, d):
    """Likeness of each chunk's first words to the last ones of the chunk before."""
    order = Window.partitionBy("source_id").orderBy("idx")
    pairs = reassemble.edge_words(fixtures.chunk_results(spark, d)).select("source_id", "idx", F.lag("tail").over(order).alias("tail"), "head").filter("tail is not null")

    def compared(batches):
        for pdf in batches:
            yield pdf.assign(ratio=[reassemble.likeness(a, b) for a, b in zip(pdf["tail"], pdf["head"])])[["source_id", "idx", "ratio"]]

    return pairs.mapInPandas(compared, "source_id long, idx long, ratio double")


@query
def resume_pending(spark, d):
    return resume.pending(fixtures.chunks(spark, d).select("source_id", "idx"), _done(spark, d))


@query
def resume_guard(spark, d):
    now = fixtures.chunks(spark, d).groupBy("source_id").agg(F.count(F.lit(1)).alias("total_chunks")).withColumn("source_size_bytes", F.col("source_id") * 1000)
    spoilt = lambda k: (F.col("source_id") % k == 0).cast("long")
    saved = now.select("source_id", (1 + spoilt(5)).alias("version"), (F.col("source_size_bytes") + spoilt(7)).alias("source_size_bytes"), (F.col("total_chunks") + spoilt(11)).alias("total_chunks"))
    return resume.usable(saved, now).select("source_id", "total_chunks")


def _pieces_heard(spark, d):
    """Completed pieces as the checkpoint table has them; some without a language or a duration."""
    segment = F.struct("seq", seconds(F.col("start_ms")).alias("start"), seconds(F.col("end_ms")).alias("end"), "text", "confidence")
    heard = fixtures.chunk_results(spark, d).groupBy("source_id", "idx").agg(F.array_sort(F.collect_list(segment)).alias("s"))
    segments = F.transform("s", lambda x: F.struct(x.start.alias("start"), x.end.alias("end"), x.text.alias("text"), x.confidence.alias("confidence"), F.lit(None).cast("string").alias("speaker")))
    result = F.struct(F.when(F.col("idx") % 4 != 1, "en").alias("language"), F.when(F.col("idx") % 4 != 2, 20.0).alias("duration"), segments.alias("segments"))
    return heard.select("source_id", (F.col("source_id") * 1000).alias("source_size_bytes"), F.lit(9).alias("total_chunks"), F.col("idx").cast("int").alias("idx"), result.alias("result"))


@query
def checkpoint_documents(spark, d):
    documents = checkpoints.to_documents(_pieces_heard(spark, d), "2024-01-01T00:00:00")
    spoilt = F.when(F.col("source_id") % 5 == 0, F.replace("body", F.lit('"version":1'), F.lit('"version":2'))).when(F.col("source_id") % 7 == 0, F.substring("body", 1, 90)).otherwise(F.col("body"))
    rows = checkpoints.from_documents(documents.select("source_id", spoilt.alias("body"))).withColumn("s", F.col("result.segments"))
    starts = F.aggregate("s", F.lit(0).cast("long"), lambda n, x: n + F.round(x.start * 1000).cast("long"))
    text = F.array_join(F.transform("s", lambda x: x.text), "\n")
    return rows.select("source_id", F.col("idx").cast("long").alias("idx"), "result.language", "result.duration", F.size("s").cast("long").alias("n_segments"), starts.alias("starts_ms"), text.alias("text"))


@query
def latest_checkpoints(spark, d):
    """Pieces of which some were made two or three times."""
    rows = _pieces_heard(spark, d).withColumn("version", F.lit(resume.VERSION))
    times = F.filter(F.array(*[F.lit(k) for k in (1, 2, 3)]).cast("array<bigint>"), lambda k: (F.col("source_id") + F.col("idx")) % k == 0)
    rows = rows.select("*", F.explode(times).alias("added")).withColumn("source_size_bytes", F.col("source_size_bytes") + F.col("added"))
    return checkpoints.latest(rows).select("source_id", F.col("idx").cast("long").alias("idx"), "source_size_bytes", F.size("result.segments").cast("long").alias("n_segments"))


@query
def stage_guard(spark, d):
    """Finished transcripts that may go on to their speakers; others are of another version or size, and some were added twice."""
    segment = F.struct("seq", "start_ms", "end_ms", "text", "confidence")
    heard = fixtures.segments(spark, d).groupBy("source_id").agg(F.array_sort(F.collect_list(segment)).alias("segments"))
    now = heard.select("source_id", (F.col("source_id") * 1000).alias("source_size_bytes"))
    spoilt = lambda k: (F.col("source_id") % k == 0).cast("int")
    stage = heard.select("source_id", (F.col("source_id") * 1000 + spoilt(7)).alias("source_size_bytes"), (spoilt(5) + resume.VERSION).alias("version"), "segments")
    rows = checkpoints.waiting(stage.unionByName(stage.filter("source_id % 3 = 0")), now)
    return rows.select("source_id", F.size("segments").cast("long").alias("n_segments"), F.array_join(F.transform("segments", lambda x: x.text), "\n").alias("text"))


@query
def ordered_results(spark, d):
    heard = fixtures.chunk_results(spark, d).groupBy("source_id", "idx").agg(F.count(F.lit(1)).alias("n_segments"))
    units = fixtures.chunks(spark, d).select("source_id", "idx").join(heard.select("source_id", "idx"), ["source_id", "idx"], "left_semi")
    return resume.ordered_results(units, heard)


@query
def progress(spark, d):
    return resume.progress(fixtures.chunks(spark, d), _done(spark, d))


@query
def skip_existing(spark, d):
    stems = fixtures.table(spark, d, "conversations").select(F.col("conv_id").alias("stem")).distinct()
    kinds = [[".txt", ".json", ".srt"], [".txt"], [".txt", ".srt"], [".json"]]
    have = F.array(*[F.array(*[F.lit(x) for x in k]) for k in kinds])
    outputs = stems.select("stem", F.explode(F.get(have, (F.col("stem") % 4).cast("int"))).alias("ext"))
    return resume.unfinished(stems, outputs, [".txt", ".srt"])


def _batch(spark, d):
    status = F.when(F.col("event_id") % 37 == 0, "HALT").when(F.col("event_id") % 5 == 0, "FAILED").otherwise("OK")
    return fixtures.table(spark, d, "events").select(F.col("user_id").alias("batch"), "event_id", status.alias("status"))


@query
def batch_prefix(spark, d):
    return resume.before_halt(_batch(spark, d), "event_id").select("batch", "event_id")


@query
def batch_summary(spark, d):
    count = lambda s: F.count_if(F.col("status") == s)
    return _batch(spark, d).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), count("OK").alias("n_ok"), count("FAILED").alias("n_failed"))


def _numbered(rows: DataFrame, column: str, alias: str) -> DataFrame:
    """Rows numbered from 1 in the order of a column: counted by range partitions first, so that no task sees all rows."""
    dealt = rows.repartitionByRange(column).sortWithinPartitions(column).withColumn("_id", F.monotonically_increasing_id())
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    dealt = saved(dealt.select("*", part.alias("_part"), place.alias("_place")))  # ranges are sampled: they must be dealt once
    sizes = dealt.groupBy("_part").agg((F.max("_place") + 1).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    base = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_base"))
    return dealt.join(base, "_part").withColumn(alias, F.col("_base") + F.col("_place") + 1).drop("_id", "_part", "_place", "_base")


@query
def scan_paths(spark, d):
    pages = fixtures.table(spark, d, "pages").select(F.col("url").alias("path")).filter(F.lower("path").endswith(".html"))
    return _numbered(pages, "path", "place")


@query
def rename_plan(spark, d):
    pages = fixtures.table(spark, d, "pages").select(F.col("url").alias("old_name")).filter(F.col("old_name").endswith(".html"))
    return _numbered(pages, "old_name", "n").select("old_name", F.concat(F.lit("song_n_"), F.col("n").cast("string"), F.lit(".html")).alias("new_name"))


@query
def fuzzy_name_lookup(spark, d):
    pages = fixtures.table(spark, d, "pages").select("page_id", "url")
    names = pages.select(F.col("url").alias("name")).unionByName(pages.filter("page_id % 10 = 0").select(F.upper("url").alias("name")))
    return resume.look_up(pages.select(F.replace("url", F.lit("/"), F.lit("_")).alias("asked")), names)


def _recordings(spark, d):
    """path and WAV content per conversation, a tenth as long: a tone on the odd segments, silence on the even ones."""

    def made(batches):
        import io
        import wave

        import numpy as np
        import pyarrow as pa

        # 11 waves of 440 Hz are 200 samples, after which all come again
        tone = (np.sin(np.arange(200) * (2 * np.pi * 440 / 8000)) * 0.5 * 32767).astype("<i2")
        schema = pa.schema([("path", pa.string()), ("content", pa.binary())])
        for batch in batches:
            for source, end, begins, ends in zip(*(c.to_pylist() for c in batch.columns)):
                n = end // 10 * 8
                if len(tone) < n:
                    tone = np.tile(tone, -(-n // len(tone)))
                x = np.zeros(n, "<i2")
                for a, b in zip(begins, ends):
                    part = slice(a // 10 * 8, b // 10 * 8)
                    x[part] = tone[:n][part]
                out = io.BytesIO()
                with wave.open(out, "wb") as f:
                    f.setnchannels(1), f.setsampwidth(2), f.setframerate(8000)
                    f.writeframes(x.tobytes())
                yield pa.RecordBatch.from_pylist([{"path": f"{source}.wav", "content": out.getvalue()}], schema)

    odd = lambda c: F.collect_list(F.when(F.col("seq") % 2 == 1, F.struct("start_ms", "end_ms")))[c]
    spans = fixtures.segments(spark, d).groupBy("source_id").agg(F.max("end_ms").alias("end"), odd("start_ms").alias("begins"), odd("end_ms").alias("ends"))
    return spans.mapInArrow(made, "path string, content binary")


@query
def wav_decode(spark, d):
    return audio.decoded(_recordings(spark, d)).select("path", "n_samples", "duration_s", F.round("rms", 6).alias("rms"))


@query
def wav_silence(spark, d):
    return audio.silences(_recordings(spark, d), least_ms=100)


QUERIES["srt_time"] = QUERIES.pop("srt_times")
QUERIES["reassemble"] = QUERIES.pop("reassemble_rows")


@query
def chunk_edges(spark, d):
    pieces = fixtures.chunks(spark, d)
    kept = reassemble.without_start_overlap(reassemble.shifted(fixtures.chunk_results(spark, d), pieces)).withColumn("overlap_end_ms", F.col("chunk_start_ms") + F.col("overlap_start_ms"))
    text = [F.array_join(c, " ").alias(c) for c in ("head", "whole", "cut")]
    return reassemble.chunk_edges(kept).select("source_id", "idx", F.col("rows").alias("n_rows"), F.col("left").alias("n_left"), *text, "cuts")


@query
def orphaned_results(spark, d):
    some = fixtures.chunks(spark, d).filter((F.col("source_id") + F.col("idx")) % 5 != 0)
    return reassemble.orphans(fixtures.chunk_results(spark, d), some)


@query
def turns_by_table_function(spark, d):
    table_functions.register(spark)
    return spark.sql("SELECT * FROM speaker_turns(TABLE(SELECT source_id, seq, speaker, start_ms, end_ms, text FROM {labelled}))", labelled=_dominant(spark, d))


@query
def transcribed_in_sql(spark, d):
    table_functions.register(spark)
    return spark.sql("SELECT source_id, status, error, seq, start_ms, end_ms, text, confidence FROM transcribe(TABLE(SELECT path, content FROM {files}), engine => 'loudness', vad_filter => true)", files=_recordings(spark, d))


@query
def turn_lines(spark, d):
    return render.turn_lines(_turns(spark, d))


@query
def chunk_names(spark, d):
    path = F.concat(F.lit("/audio/"), F.col("source_id").cast("string"), F.lit(".mp3"))
    return fixtures.chunks(spark, d).select("source_id", "idx", chunks.chunk_name(path, F.col("idx")).alias("name"))


@query
def completed_ids(spark, d):
    return resume.completed(_done(spark, d)).select("source_id", F.array_join(F.col("idxs").cast("array<string>"), ",").alias("idxs"))


@query
def chunk_headers(spark, d):
    languages = _done(spark, d).withColumn("language", F.when(F.col("idx") % 2 == 0, "en").otherwise("fr"))
    return reassemble.headers(fixtures.chunks(spark, d), languages)


@query
def real_time_factor(spark, d):
    rows = fixtures.chunks(spark, d).withColumn("elapsed_s", (F.col("idx") % 4).cast("double"))
    return rows.select("source_id", "idx", resume.real_time_factor(seconds(F.col("end_ms") - F.col("start_ms")), F.col("elapsed_s")).alias("factor"))
