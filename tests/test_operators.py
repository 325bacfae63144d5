"""Small cases with values worked out by hand, and invariants over the test tables."""

import io
import math
import struct
import wave

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxweave.config import Options
from voxweave.functions import text
from voxweave.operators import align, chunks, models, reassemble, render, resume
from voxweave.plans import pipeline
from voxweave.sources import audio, checkpoints, fixtures, paths
from voxweave.streaming import turns as streams

SF = "/root/testdata/sf0.001"
SEG = "source_id long, seq long, start_ms long, end_ms long, text string, confidence double"
DIAR = "source_id long, dseq long, speaker string, start_ms long, end_ms long"


def wav(parts, rate=16_000):
    """parts: (ms, loud)"""
    out, f = io.BytesIO(), None
    samples = []
    for ms, loud in parts:
        samples += [int(16000 * math.sin(2 * math.pi * 440 * k / rate)) if loud else 0 for k in range(ms * rate // 1000)]
    with wave.open(out, "wb") as f:
        f.setnchannels(1), f.setsampwidth(2), f.setframerate(rate)
        f.writeframes(struct.pack(f"<{len(samples)}h", *samples))
    return out.getvalue()


def column(spark, expr, value, kind):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("s, want", [(83.456, "00:01:23,456"), (3661.0, "01:01:01,000"), (0.001, "00:00:00,001"), (0.0, "00:00:00,000")])
def test_srt_time(spark, s, want):
    assert column(spark, text.srt_time, s, "double") == want


@pytest.mark.parametrize("x, want", [(0.0, 1.0), (5.0, 1.0), (-100.0, 0.0), (-0.1, 0.9048)])
def test_confidence(spark, x, want):
    assert column(spark, text.confidence, x, "double") == want


def test_words_and_blanks(spark):
    assert column(spark, text.word_count, " a  b c ", "string") == 3
    assert column(spark, text.word_count, "", "string") == 0
    assert column(spark, text.stripped, "\n a \t ", "string") == "a"


def label(spark, segs, diar):
    segs = spark.createDataFrame([(1, k, a, b, t, 0.9) for k, (a, b, t) in enumerate(segs)], SEG)
    diar = spark.createDataFrame([(1, k, w, a, b) for k, (w, a, b) in enumerate(diar)], DIAR)
    return align.carried(align.dominant(segs, diar))


def speakers(df):
    return [r.speaker for r in df.orderBy("seq").collect()]


def test_dominant_speaker(spark):
    assert speakers(label(spark, [(500, 5000, "x")], [("A", 0, 1000), ("B", 1000, 10_000)])) == ["B"]
    assert speakers(label(spark, [(1000, 5000, "x")], [("A", 0, 3000), ("B", 3000, 10_000)])) == ["A"]  # a tie
    assert speakers(label(spark, [(0, 5000, "x"), (10_000, 15_000, "y")], [("A", 0, 5000)])) == ["A", "A"]
    assert speakers(label(spark, [(0, 1000, "x"), (2000, 3000, "y")], [("A", 2500, 5000)])) == ["UNKNOWN", "A"]
    assert speakers(label(spark, [(0, 1000, "x")], [("A", 1000, 2000)])) == ["UNKNOWN"]  # they only touch


def test_turns_end_with_their_last_segment(spark):
    got = align.turns(label(spark, [(0, 9000, " one "), (1000, 2000, "two"), (9000, 9500, "three")], [("A", 0, 8000), ("B", 9000, 10_000)])).orderBy("turn_index").collect()
    assert [(r.speaker, r.start_ms, r.end_ms, r.text, r.n_segments) for r in got] == [("A", 0, 2000, "one two", 2), ("B", 9000, 9500, "three", 1)]


def test_roles(spark):
    diar = spark.createDataFrame([(1, 0, "A", 0, 10_000), (1, 1, "B", 10_000, 50_000), (1, 2, "C", 50_000, 200_000), (2, 0, "Z", 0, 5)], DIAR)
    role = lambda flip: {(r.source_id, r.speaker): r.role for r in align.role_map(diar, flip).collect()}
    assert role(False) == {(1, "A"): "INTERVIEWER", (1, "B"): "INTERVIEWEE", (1, "C"): "SPEAKER_2", (2, "Z"): "INTERVIEWER"}
    assert role(True)[1, "A"] == "INTERVIEWEE" and role(True)[1, "C"] == "SPEAKER_2"


def test_buckets_change_nothing(spark):
    segs, diar = fixtures.segments(spark, SF), fixtures.diarization(spark, SF)
    want = sorted(tuple(r) for r in align.overlap_by_speaker(segs, diar).collect())
    for size in (700, 5000, 10**7):
        assert sorted(tuple(r) for r in align.overlap_by_speaker(segs, diar, size).collect()) == want


def test_turn_invariants(spark):
    segs = fixtures.segments(spark, SF)
    turned = align.align(segs, fixtures.diarization(spark, SF)).repartition(3)
    assert turned.agg(F.sum("n_segments")).first()[0] == segs.count()
    rows = turned.orderBy("source_id", "turn_index").collect()
    for a, b in zip(rows, rows[1:]):
        if a.source_id == b.source_id:
            assert b.turn_index == a.turn_index + 1 and a.speaker != b.speaker
    stats = align.speaker_stats(turned)
    assert stats.agg(F.sum("turn_count")).first()[0] == len(rows)


PLANS = [
    (300_000, (600, 720, 60), [], []),
    (600_000, (300, 360, 60), [(290_000, 310_000)], [300_000]),
    (700_000, (300, 360, 60), [], [360_000]),  # a cut past the end is dropped
    (120_000, (30, 36, 60), [(0, 2000)], [1000, 37_000, 73_000, 109_000]),  # a silence behind the cursor counts as none
    (900_000, (300, 360, 60), [(280_000, 281_000), (295_000, 305_000), (590_000, 610_000)], [300_000, 600_000]),
    (1_300_000, (600, 300, 1), [], [600_000, 1_200_000]),  # never before the target
]


@pytest.mark.parametrize("total, sizes, gaps, want", PLANS)
def test_cut_plans(spark, total, sizes, gaps, want):
    plan = chunks.ChunkPlan(*[1000 * x for x in sizes])
    totals = spark.createDataFrame([(1, total)], "source_id long, total_ms long")
    silences = spark.createDataFrame([(1, a, b) for a, b in gaps], "source_id long, start_ms long, end_ms long")
    cuts = chunks.cut_points(totals, silences, plan)
    assert cuts.first().cuts == want
    pieces = chunks.boundaries(cuts, plan).orderBy("idx").collect()
    edges = [0, *want, total]
    assert [(p.start_ms, p.end_ms) for p in pieces] == list(zip(edges, edges[1:]))
    assert pieces[0].overlap_start_ms == 0 and pieces[-1].overlap_end_ms == 0
    assert all(p.overlap_start_ms == 200 for p in pieces[1:])


def merged(spark, results, autojunk=True):
    pieces = spark.createDataFrame([(1, 0, 0, 60_000, 0), (1, 1, 60_000, 120_000, 1000)], "source_id long, idx long, start_ms long, end_ms long, overlap_start_ms long")
    rows = spark.createDataFrame([(1, i, k, a, b, t, 0.9) for i, k, a, b, t in results], "source_id long, idx long, seq long, start_ms long, end_ms long, text string, confidence double")
    return [(r.start_ms, r.text) for r in reassemble.reassembled(rows, pieces, autojunk).orderBy("seq").collect()]


def test_merge(spark):
    assert merged(spark, [(0, 0, 0, 5000, "first"), (1, 0, 0, 900, "in the overlap"), (1, 1, 2000, 4000, "second")]) == [(0, "first"), (62_000, "second")]
    same = "the very same words are said at the edge of both"
    assert merged(spark, [(0, 0, 50_000, 60_000, same), (1, 0, 500, 5000, same), (1, 1, 5000, 6000, "and")]) == [(50_000, same), (65_000, "and")]
    assert merged(spark, [(0, 0, 50_000, 60_000, same), (1, 0, 500, 5000, same)]) == [(50_000, same), (60_500, same)]  # never left with nothing
    with pytest.raises(Exception, match="no chunk"):
        merged(spark, [(7, 0, 0, 1, "x")])


def test_resuming(spark):
    units = spark.createDataFrame([(1, k) for k in range(10)], "source_id long, idx long")
    done = units.filter("idx < 4")
    assert resume.pending(units, done).count() == 6
    assert resume.progress(units, done).first().label == "4/10 (40%)"
    with pytest.raises(Exception, match="no result"):
        resume.ordered_results(units, done).collect()
    names = spark.createDataFrame([("Entrevista_Natalia _peliroja_.m4a",), ("a-b.mp3",), ("A_B.mp3",)], "name string")
    asked = spark.createDataFrame([("Entrevista_Natalia_peliroja_.m4a",), ("ab.mp3",)], "asked string")
    assert [(r.asked, r.name) for r in resume.look_up(asked, names).collect()] == [("Entrevista_Natalia_peliroja_.m4a", "Entrevista_Natalia _peliroja_.m4a")]


def test_checkpoints(spark, tmp_path):
    result = (("es"), 1.5, [(0.0, 1.0, "x", 0.9, None)])
    rows = spark.createDataFrame([("a", 10, 2, k, result) for k in range(2)], f"source_id string, source_size_bytes long, total_chunks int, idx int, result {checkpoints.RESULT}")
    path = str(tmp_path / "table")
    checkpoints.append(rows, path)
    checkpoints.append(rows.filter("idx = 1"), path)
    back = checkpoints.load(spark, path).cache()
    assert back.count() == 2
    checkpoints.append(rows.filter("idx = 1").withColumn("total_chunks", F.lit(7)), path)
    checkpoints.compact(spark, path)
    checkpoints.append(rows.filter("idx = 0").withColumn("total_chunks", F.lit(8)), path)
    assert {r.idx: r.total_chunks for r in checkpoints.load(spark, path).collect()} == {0: 8, 1: 7}
    # a compaction that broke off leaves what was there
    (tmp_path / "table" / "generation-2").mkdir()
    assert checkpoints.load(spark, path).count() == 2
    checkpoints.compact(spark, path)
    many = spark.range(100_000).select(F.col("id").cast("string").alias("source_id"), F.lit(1).cast("long").alias("source_size_bytes"), F.lit(1).alias("total_chunks"), F.lit(0).alias("idx"), F.lit(None).cast(checkpoints.RESULT).alias("result"))
    checkpoints.append(many.coalesce(1), path)
    assert checkpoints.load(spark, path).count() == 100_002
    checkpoints.compact(spark, path)
    assert [p.name for p in (tmp_path / "table").iterdir()] == ["generation-3"] and len(list((tmp_path / "table" / "generation-3").glob("bucket=*"))) == checkpoints.BUCKETS
    documents = checkpoints.to_documents(back, "2024-01-01T00:00:00+00:00")
    again = checkpoints.from_documents(documents.union(spark.createDataFrame([("b", "NOT JSON"), ("c", '{"version": 2}')], "source_id string, body string")))
    assert sorted((r.source_id, r.idx, r.result.language) for r in again.collect()) == [("a", 0, "es"), ("a", 1, "es")]


def test_wav_and_stubs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "talk.WAV").write_bytes(wav([(2000, True), (1500, False), (2000, True), (1000, False), (1000, True)]))
    (tmp_path / "in" / "note.txt").write_text("no audio")
    where = str(tmp_path / "in")
    assert audio.scan(spark, where).count() == 1
    files = pipeline.read(spark, where).cache()
    assert audio.decoded(files).first().n_samples == 7500 * 16
    gaps = [(r.start_ms, r.end_ms) for r in audio.silences(files).orderBy("start_ms").collect()]
    assert len(gaps) == 2 and all(abs(a - x) < 20 and abs(b - y) < 20 for (a, b), (x, y) in zip(gaps, [(2000, 3500), (5500, 6500)]))
    segments = pipeline.transcribe(files)
    assert segments.count() == 3
    turned = pipeline.transcribe_and_diarize(files).orderBy("turn_index").collect()
    assert [r.speaker for r in turned] == ["INTERVIEWEE", "INTERVIEWER", "INTERVIEWEE"]
    plan = chunks.ChunkPlan(target_ms=3000, max_ms=4000, window_ms=1000)
    assert pipeline.plan_chunks(files, plan).count() == 3
    assert pipeline.transcribe_chunked(files, plan).count() >= 3
    out = str(tmp_path / "out")
    assert pipeline.export(segments, out, [".txt", ".json", ".srt"]) == {".txt": 1, ".json": 1, ".srt": 1}
    assert (tmp_path / "out" / "talk.srt").read_text().startswith("1\n00:00:00,000 --> ")
    assert isinstance(models.LoudnessTranscriber(), models.Transcriber)


def test_options_paths_and_formats(monkeypatch, tmp_path):
    monkeypatch.setenv("VOXWEAVE_BEAM_SIZE", "3")
    monkeypatch.setenv("VOXWEAVE_VAD_FILTER", "false")
    assert (Options.read(language="EN").language, Options.read().beam_size, Options.read().vad_filter) == ("en", 3, False)
    for bad in ({"beam_size": 11}, {"device": "tpu"}, {"language": "e"}, {"vad_min_speech_duration_ms": -1}):
        with pytest.raises(ValueError):
            Options(**bad)
    (tmp_path / "My file .wav").write_bytes(b"")
    assert paths.resolve(str(tmp_path / "my_file.wav")).endswith("My file .wav")
    assert paths.resolve(str(tmp_path / "other.wav")) is None
    assert render.renderer(".SRT") is render.srt
    with pytest.raises(ValueError, match="unknown"):
        render.renderer(".doc")


def test_streams(spark, tmp_path):
    rows = align.dominant(fixtures.segments(spark, SF), fixtures.diarization(spark, SF)).select("source_id", "seq", "speaker", "start_ms", "end_ms", "text")
    rows.orderBy("source_id", "seq").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = streams.labelled_stream(stream).writeStream.format("memory").queryName("labelled").option("checkpointLocation", str(tmp_path / "c1")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = sorted((r.source_id, r.seq, r.speaker) for r in align.carried(rows).collect())
    assert sorted(tuple(r) for r in spark.table("labelled").collect()) == want
    events = fixtures.table(spark, SF, "events")
    assert streams.sessions(events).agg(F.sum("n")).first()[0] == events.count()


def test_chunked_recordings_compare_words_at_boundaries(spark, tmp_path):
    (tmp_path / "talk.wav").write_bytes(wav([(2000, True), (1500, False), (2000, True), (1000, False), (1000, True)]))
    files = pipeline.read(spark, str(tmp_path))
    plan = chunks.ChunkPlan(target_ms=3000, max_ms=4000, window_ms=1000)
    pieces = pipeline.plan_chunks(files, plan).orderBy("idx").collect()
    assert len(pieces) == 3 and pieces[1].overlap_start_ms > 0
    said = " ".join(f"word{k}" for k in range(30))
    over = pieces[1].overlap_start_ms
    rows = [(0, 0, 0, 2000, said), (1, 0, 0, over + 300, said), (1, 1, over + 300, over + 900, "then more"), (2, 0, 0, over + 700, "and the end")]
    done = spark.createDataFrame([(pieces[0].source_id, i, k, a, b, t, 0.9) for i, k, a, b, t in rows], "source_id string, idx long, seq long, start_ms long, end_ms long, text string, confidence double")
    out = pipeline.transcribe_chunked(files, plan, done=done).orderBy("seq").collect()
    assert [(r.source_id, r.seq, r.text) for r in out] == [(pieces[0].source_id, k, t) for k, t in enumerate([said, "then more", "and the end"])]


@pytest.mark.parametrize("stretch", [1, 3, 7, 50_000])
def test_labels_and_turns_in_stretches(spark, stretch):
    """Sources of many stretches, gaps in seq, stretches without a label, sources without one: as one pass over each source."""
    rng = random.Random(stretch)
    rows = []
    for source in range(12):
        rare = rng.choice([0.05, 0.5, 0.9])
        at = 0
        for _ in range(rng.choice([1, 5, 40])):
            at += rng.choice([1, 1, 1, 9])
            speaker = rng.choice("AB") if rng.random() < rare else rng.choice([None, ""])
            rows.append((source, at, speaker if source else None, at * 10, at * 10 + 5, f"w{at}"))
    df = spark.createDataFrame(rows, "source_id long, seq long, speaker string, start_ms long, end_ms long, text string").repartition(3)
    want, last, whole = [], {}, []
    for source, seq, speaker, start, end, text in rows:
        now = speaker or last.get(source, "UNKNOWN")
        if last.get(source) == now:
            whole[-1][3:] = [end, f"{whole[-1][4]} {text}"]
        else:
            whole.append([source, whole[-1][1] + 1 if whole and whole[-1][0] == source else 0, now, end, text])
        last[source] = now
        want.append((source, seq, now))
    assert sorted((r.source_id, r.seq, r.speaker) for r in align.carried(df, stretch).collect()) == sorted(want)
    shown = lambda df: sorted([r.source_id, r.turn_index, r.speaker, r.end_ms, r.text] for r in df.collect())
    assert shown(align.turns(df, carry=True, stretch=stretch)) == sorted(whole)
    assert shown(align.turns(align.carried(df), stretch=stretch)) == sorted(whole)
    # without carrying, a missing speaker is one of its own
    plain = align.turns(df.filter("source_id = 3"), stretch=stretch).count()
    said = [r[2] for r in rows if r[0] == 3]
    assert plain == sum(k == 0 or said[k] != said[k - 1] for k in range(len(said)))


def test_mean_confidence_on_a_tie(spark):
    """Four confidences with the mean 0.75555, which a sum of binary fractions misses by a little: half a unit goes up, in any order."""
    import json

    results = spark.createDataFrame([(1, "en", 4, None)], "source_id long, language string, duration_ms long, source string")
    heard = [0.99, 0.7483, 0.3791, 0.9048]
    for confidences in (heard, heard[::-1], sorted(heard)):
        segments = spark.createDataFrame([(1, i, i, i + 1, "a", c) for i, c in enumerate(confidences)], SEG)
        turned = align.turns(segments.withColumn("speaker", F.when(F.col("seq") < 3, "A").otherwise("B")), carry=True)
        assert render.average_confidence(segments, results).select(F.round("avg_confidence", 4)).first()[0] == 0.7556
        assert json.loads(render.raw_json(segments, results).first().body)["average_confidence"] == 0.7556
        assert json.loads(render.turn_json(turned, results).first().body)["metadata"]["avg_confidence"] == 0.7556


class Here:
    """A table of files whose batches are mapped in this process."""

    def __init__(self, *contents):
        import pyarrow as pa

        self.batch = pa.RecordBatch.from_pydict({"path": [str(k) for k in range(len(contents))], "content": list(contents)})

    def select(self, *columns):
        return self

    def mapInArrow(self, function, schema):
        return [row for out in function(iter([self.batch])) for row in out.to_pylist()]


@pytest.fixture
def opened(monkeypatch):
    """Which files were opened for decoding."""
    seen, real = [], wave.open
    monkeypatch.setattr(audio.wave, "open", lambda f, *mode: (seen.append(f), real(f, *mode))[1])
    return seen


def test_decoded_reads_each_file_once(opened):
    files = Here(wav([(300, True)]), b"no recording", wav([(200, False)]))
    opened.clear()
    assert [(r["path"], r["n_samples"]) for r in audio.decoded(files)] == [("0", 4800), ("2", 3200)]
    assert len(opened) == 3


def test_silences_reads_each_file_once(opened):
    files = Here(wav([(300, True), (900, False)]), b"no recording", wav([(1000, False)]))
    opened.clear()
    assert [(r["path"], r["start_ms"], r["end_ms"]) for r in audio.silences(files)] == [("0", 300, 1200), ("2", 0, 1000)]
    assert len(opened) == 3


def test_engines_are_given_telephone_recordings_without_a_search(monkeypatch):
    content = wav([(400, True), (600, False), (300, True)], rate=8000)
    monkeypatch.setattr(audio.np, "interp", None)
    said = list(models.LoudnessTranscriber().transcribe("a", audio.prepared(content)))
    assert [(s.start_ms, s.end_ms) for s in said] == [(0, 400), (1000, 1300)]


@pytest.mark.parametrize("had", [8000, 4000, 16_000, 2000])
def test_resampling_by_a_power_of_two_needs_no_search(monkeypatch, had):
    x = np.random.default_rng(had).uniform(-1, 1, 1001)
    for part in (x, x[:1], x[:2], x[:0]):
        want = np.interp(np.arange(len(part) * 16_000 // had) * had / 16_000, np.arange(len(part)), part) if len(part) else part
        with monkeypatch.context() as m:
            m.setattr(audio.np, "interp", None)
            assert np.array_equal(audio.resampled(part, had, 16_000), want)


def test_recordings_are_tones_on_odd_segments(spark):
    """A content against the sines that it is made of, sample by sample."""
    from voxweave.plans import catalog

    one = catalog._recordings(spark, SF).orderBy(F.length("content").desc()).first()
    spans = fixtures.segments(spark, SF).filter(F.col("source_id") == int(one.path[:-4])).collect()
    x = np.zeros(max(s.end_ms for s in spans) // 10 * 8)
    for s in spans:
        if s.seq % 2:
            x[s.start_ms // 10 * 8 : s.end_ms // 10 * 8] = 0.5
    x *= np.sin(np.arange(len(x)) * (2 * np.pi * 440 / 8000))
    with wave.open(io.BytesIO(bytes(one.content))) as f:
        assert (f.getframerate(), f.getnchannels(), f.getsampwidth()) == (8000, 1, 2)
        assert f.readframes(f.getnframes()) == (x * 32767).astype("<i2").tobytes()
