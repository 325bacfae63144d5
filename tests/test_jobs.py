"""Jobs over recordings: failures, resuming, halting, outputs and the command line; and plain versions of what SQL can't say."""

import difflib
import io
import json
import logging
import random
import signal
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.test_operators import wav
from voxweave import __main__, log
from voxweave.config import Options
from voxweave.operators import align, chunks, halt, models, reassemble, render, resume
from voxweave.plans import catalog, jobs, pipeline
from voxweave.sources import audio, fixtures
from voxweave.streaming import turns as streams

PLAN = chunks.ChunkPlan(target_ms=3000, max_ms=4000, window_ms=1000)
TALK = [(2000, True), (1500, False), (2000, True), (1000, False), (1000, True)]


@pytest.fixture
def recordings(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "one.wav").write_bytes(wav(TALK))
    (folder / "two.wav").write_bytes(wav(TALK[::-1]))
    (folder / "damaged.wav").write_bytes(b"RIFF, but no more")
    return pipeline.read(spark, str(folder)).repartition(2)


def test_a_damaged_file_leaves_the_others(recordings):
    segments, status = jobs.transcribe_batch(recordings)
    found = {r.source_id.rsplit("/", 1)[1]: r for r in status.collect()}
    assert {k: r.status for k, r in found.items()} == {"one.wav": "DONE", "two.wav": "DONE", "damaged.wav": "FAILED"}
    assert "Error" in found["damaged.wav"].error and found["damaged.wav"].real_time_factor == 0 and found["one.wav"].real_time_factor > 0
    assert segments.select("source_id").distinct().count() == 2
    assert jobs.summary(status, 5.0).startswith("2/3 succeeded, 15 s of sound in 5 s, 3.0 times")
    errors = {r.path.rsplit("/", 1)[1]: r.error for r in audio.readable(recordings).collect()}
    assert errors["one.wav"] is None and errors["damaged.wav"]
    assert pipeline.plan_chunks(recordings, PLAN).select("source_id").distinct().count() == 2


class Counting:
    """Notes each piece that it is given, in a file of its own."""

    def __init__(self, folder, fails=()):
        self.folder, self.fails = folder, fails

    def transcribe(self, path, content):
        import os
        import uuid

        open(os.path.join(self.folder, uuid.uuid4().hex), "w").close()
        if any(path.endswith(x) for x in self.fails):
            raise ValueError("not this one")
        yield models.Spoken(0, 900, f"words of {path[-9:]}", -0.1)


def test_pieces_are_resumed_after_a_halt(spark, recordings, tmp_path):
    made = tmp_path / "made"
    made.mkdir()
    folder, table = str(made), str(tmp_path / "table")
    good = recordings.filter("path not like '%damaged%'")
    stop = halt.Halt()
    stop.ask("a test")
    with pytest.raises(halt.Halted, match="after 0 of 5 pieces"):
        jobs.transcribe_in_pieces(good, PLAN, table, lambda: Counting(folder), unit=2, stop=stop)
    with pytest.raises(RuntimeError, match="1 of 5 pieces failed"):
        jobs.transcribe_in_pieces(good, PLAN, table, lambda: Counting(folder, ("two.wav\t1",)), unit=4)
    assert len(list(made.iterdir())) == 5
    segments, heads = jobs.transcribe_in_pieces(good, PLAN, table, lambda: Counting(folder), unit=4, language="en")
    assert len(list(made.iterdir())) == 6  # the one that had failed
    assert segments.count() == 5 and not jobs.exists(spark, table)
    rows = [(r.source_id, r.seq) for r in segments.orderBy("source_id", "seq").collect()]
    assert [seq for _, seq in rows] == [0, 1, 2, 0, 1]
    assert {(r.language, r.duration_ms) for r in heads.collect()} <= {("en", 7500), ("es", 7500)}


def test_a_source_that_changed_is_made_anew(spark, recordings, tmp_path):
    table = str(tmp_path / "table")
    good = recordings.filter("path like '%one%'")
    jobs.transcribe_in_pieces(good, PLAN, table, keep=True)
    longer = good.withColumn("content", F.unhex(F.concat(F.hex("content"), F.lit("00"))))
    assert jobs._usable(spark, table, jobs._live(good, pipeline.plan_chunks(good, PLAN))).count() == 3
    assert jobs._usable(spark, table, jobs._live(longer, pipeline.plan_chunks(good, PLAN))).count() == 0


def test_transcripts_wait_for_their_speakers(spark, recordings, tmp_path):
    good, stage = recordings.filter("path like '%one%'"), str(tmp_path / "stage")

    class Broken:
        def diarize(self, path, content, num_speakers=None):
            raise OSError("no access")

    with pytest.raises(Exception, match="no access"):
        jobs.transcribe_and_diarize(good, stage, diarizer=Broken)
    assert jobs.exists(spark, stage)

    class Never:
        def transcribe(self, path, content):
            raise AssertionError("it is there already")

    turned, segments, status = jobs.transcribe_and_diarize(good, stage, transcriber=Never)
    assert [(r.status, r.error) for r in status.collect()] == [("DONE", None)]
    assert segments.count() == 3 and [r.speaker for r in turned.orderBy("turn_index").collect()] == ["INTERVIEWEE", "INTERVIEWER", "INTERVIEWEE"]
    assert not jobs.exists(spark, stage)


def test_speakers_of_recordings_in_pieces(spark, recordings, tmp_path):
    """Cut, halted, resumed and diarized; a damaged file is a row with its error, and no access is known before any work."""
    stage, table, made = str(tmp_path / "stage"), str(tmp_path / "table"), tmp_path / "made"
    made.mkdir()
    folder = str(made)
    in_pieces = lambda stop=None: jobs.transcribe_in_pieces(recordings, PLAN, table, lambda: Counting(folder), unit=1, stop=stop)

    class Asks(models.AlternatingDiarizer):
        def check_access(self):
            raise PermissionError("no token")

    with pytest.raises(PermissionError, match="no token"):
        jobs.transcribe_and_diarize(recordings, stage, diarizer=Asks, whole=in_pieces)
    assert not list(made.iterdir())
    stop = halt.Halt()
    stop.ask()
    with pytest.raises(halt.Halted):
        jobs.transcribe_and_diarize(recordings, stage, whole=lambda: in_pieces(stop))
    turned, segments, status = jobs.transcribe_and_diarize(recordings, stage, whole=in_pieces)
    assert segments.count() == 5 and turned.select("source_id").distinct().count() == 2
    found = {r.source_id.rsplit("/", 1)[1]: (r.status, r.error) for r in status.collect()}
    assert found["one.wav"] == found["two.wav"] == ("DONE", None) and found["damaged.wav"][0] == "FAILED" and "Error" in found["damaged.wav"][1]


def test_options_reach_engines():
    class Engine:
        def __init__(self, model_size, beam_size=1, other=3):
            self.got = (model_size, beam_size, other)

    assert models.configured(Engine, Options(model_size="tiny", beam_size=4))().got == ("tiny", 4, 3)
    assert len(list(models.LoudnessTranscriber(vad_filter=True, vad_min_speech_duration_ms=1500).transcribe("x", wav(TALK)))) == 2


def test_all_formats_are_written(recordings, tmp_path):
    good, out = recordings.filter("path like '%one%'"), tmp_path / "out"
    turned = pipeline.transcribe_and_diarize(good)
    formats = [".txt", ".json", ".srt", "transcript.json", "transcript.txt"]
    assert pipeline.export(pipeline.transcribe(good), str(out), formats, turned=turned) == dict.fromkeys(formats, 1)
    assert sorted(p.name for p in out.iterdir()) == ["one.json", "one.srt", "one.transcript.json", "one.transcript.txt", "one.txt"]
    data = json.loads((out / "one.transcript.json").read_text())
    assert data["schema_version"] == "1.0" and len(data["turns"]) == 3 and data["metadata"]["duration_s"] == 7.5
    with pytest.raises(ValueError, match="needs turns"):
        pipeline.export(pipeline.transcribe(good), str(out), ["transcript.txt"])


def test_command_line(spark, recordings, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(spark, "stop", lambda: None)
    folder, out = str(tmp_path / "in"), tmp_path / "out"
    assert __main__.main([folder, "--batch", "--format", "txt", "--format", ".srt", "--output-dir", str(out), "--log-level", "ERROR"]) == 0
    said = capsys.readouterr()
    assert "2/3 succeeded" in said.out and "damaged" in said.err
    assert sorted(p.name for p in out.iterdir()) == ["one.srt", "one.txt", "two.srt", "two.txt"]
    one = f"{folder}/one.wav"
    assert __main__.main([one, "--diarize", "--diarize-format", "transcript.txt", "--output", str(out)]) == 0
    assert (out / "one.transcript.txt").read_text().count("[INTERVIEW") == 3
    assert __main__.main([one, "--chunk", "--chunk-minutes", "0.05", "--keep-chunks", "--output", str(tmp_path / "cut")]) == 0
    assert sorted(p.name for p in (tmp_path / "cut").iterdir())[:2] == ["one.txt", "one_chunk000.wav"]
    assert __main__.main([folder, "--batch", "--skip-existing", "--format", "txt", "--output", str(out)]) == 0
    assert "0/1 succeeded" in capsys.readouterr().out
    assert __main__.main([one, "--batch"]) == 1 and __main__.main([f"{folder}/none.wav"]) == 1


def test_halt_by_signal_and_line():
    forced = []
    with halt.Halt(listen=True, at_once=lambda: forced.append(1)) as stop:
        stop.check("nothing")
        signal.raise_signal(signal.SIGINT)
        with pytest.raises(halt.Halted, match=r"2 of 3 \(SIGINT\)"):
            stop.check("2 of 3")
        with pytest.raises(SystemExit):
            signal.raise_signal(signal.SIGTERM)
    assert forced == [1]
    stop = halt.Halt()
    stop.read_lines(["hello\n", " PAUSE \n"])
    assert stop.asked and stop.reason == "standard input"


def test_factories_of_one_name_are_told_apart(recordings):
    def saying(word):
        class Model:
            def transcribe(self, path, content):
                yield models.Spoken(0, 1, word, -0.1)

        return lambda: Model()

    one = recordings.filter("path like '%one%'")
    assert [models.transcribed(one, saying(w)).first().text for w in ("a", "b", "a")] == ["a", "b", "a"]


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_widths_of_samples(width):
    x = np.array([0.0, 0.5, -0.5, 0.25, -1.0])
    top = 1 << (8 * width - 1)
    values = np.clip(np.round(x * top), -top, top - 1).astype("i8")
    raw = (values + 128).astype("u1").tobytes() if width == 1 else b"".join(int(v).to_bytes(width, "little", signed=True) for v in values)
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(width), w.setframerate(audio.RATE)
        w.writeframes(raw)
    assert np.allclose(audio.samples(out.getvalue()), x, atol=0.01)
    same = audio.prepared(out.getvalue())
    assert (same == out.getvalue()) == (width == 2) and np.allclose(audio.samples(same), x, atol=0.01)


def plain_cuts(total, gaps, plan):
    cursor, cuts = 0, []
    while cursor + plan.target_ms < total:
        near = cursor + plan.target_ms
        best = max(((b - a, -k, (a + b) // 2) for k, (a, b) in enumerate(gaps) if a < near + plan.window_ms and b > near - plan.window_ms), default=None)
        cursor = best[2] if best and best[2] > cursor else cursor + plan.hard_ms
        cuts += [cursor] if cursor < total else []
    return cuts


def test_cuts_against_a_look_at_all_silences():
    rng = random.Random(8)
    plan = chunks.ChunkPlan(target_ms=100, max_ms=130, window_ms=25)
    for _ in range(300):
        gaps = sorted((a, a + rng.choice([1, 5, 20, 90])) for a in (rng.randrange(1500) for _ in range(rng.randint(0, 40))))
        assert chunks.cuts_of(1500, gaps, plan) == plain_cuts(1500, gaps, plan)
    many = [(k * 10, k * 10 + 3) for k in range(200_000)]
    assert len(chunks.cuts_of(2_000_000, many, plan)) > 10_000


def test_common_length_bounds_the_likeness():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd e") for _ in range(rng.randint(0, 60))) for _ in range(2))
        if rng.random() < 0.5:
            b = a[: rng.randint(0, len(a))] + b[:5]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert reassemble.common_length(a, b) == table[-1][-1]
        assert reassemble.alike(a, b) == (difflib.SequenceMatcher(None, a, b).ratio() >= reassemble.LIKENESS)


def test_boundary_dedup_against_plain_python(spark):
    pieces = {}
    for r in fixtures.chunks(spark, SF).collect():
        pieces.setdefault(r.source_id, {})[r.idx] = r
    rows = {}
    for r in fixtures.chunk_results(spark, SF).collect():
        rows.setdefault(r.source_id, {}).setdefault(r.idx, []).append(r)
    want = []
    for source, parts in rows.items():
        so_far = ""
        for idx in sorted(parts):
            piece = pieces[source][idx]
            kept = [(r.seq, r.start_ms + piece.start_ms, r.text) for r in sorted(parts[idx], key=lambda r: r.seq) if idx == 0 or not piece.overlap_start_ms or r.end_ms > piece.overlap_start_ms]
            if not kept:
                continue
            tail, head = " ".join(so_far.split()[-30:]).lower(), " ".join(" ".join(t.strip() for _, _, t in kept).split()[:30]).lower()
            if tail and head and difflib.SequenceMatcher(None, tail, head).ratio() >= 0.82:
                kept = [x for x in kept if x[1] >= piece.start_ms + piece.overlap_start_ms] or kept
            so_far += " " + " ".join(t.strip() for _, _, t in kept)
            want += [(source, idx, start, text) for _, start, text in kept]
    got = catalog.QUERIES["boundary_dedup"](spark, SF).orderBy("source_id", "seq").collect()
    assert [(r.source_id, r.idx, r.start_ms, r.text) for r in got] == sorted(want, key=lambda x: (x[0], x[1])) if "text" in got[0].asDict() else len(got) == len(want)


def plain_merge(rows, pieces):
    """rows: (source, idx, seq, start, end, text) from the piece's start; pieces: (source, idx) -> (start, overlap)."""
    out = []
    for source in sorted({r[0] for r in rows}):
        so_far, at = [], 0
        for idx in sorted({r[1] for r in rows if r[0] == source}):
            start, overlap = pieces[source, idx]
            kept = [r for r in sorted(rows) if r[:2] == (source, idx) and (idx == 0 or not overlap or r[4] > overlap)]
            head = " ".join(" ".join(r[5] for r in kept).split()[:30]).lower()
            if so_far and head and difflib.SequenceMatcher(None, " ".join(so_far[-30:]).lower(), head).ratio() >= 0.82:
                kept = [r for r in kept if r[3] >= overlap] or kept
            for r in kept:
                so_far += r[5].split()
                out.append((source, at, idx, r[3] + start, r[5]))
                at += 1
    return out


@pytest.mark.parametrize(("stretch", "most"), [(2, 12), (3, 40), (64, 20)])
def test_merge_by_composition_against_plain_python(spark, stretch, most):
    """Chunks of few and many words, whose first words are often the last ones merged so far, in stretches of any length."""
    rng = random.Random(stretch)
    vocab = [f"Word{k}" for k in range(50)]
    rows, pieces = [], {}
    for source in range(5):
        said = []
        for idx in range(rng.choice([1, 9, 30])):
            pieces[source, idx] = (idx * 1000, rng.choice([0, 200]))
            words = [rng.choice(vocab) for _ in range(rng.randint(0, most))]
            if rng.random() < 0.7:
                words = said[-rng.randint(5, 30) :] + words
            # now and then something that no merge has kept
            said = words if rng.random() < 0.5 else said + words
            at = 0
            for seq, k in enumerate(range(0, len(words), 7)):
                rows.append((source, idx, seq, at, at + rng.choice([90, 150]), " ".join(words[k : k + 7])))
                at += 100
    have = spark.createDataFrame([(*r, 0.5) for r in rows], "source_id long, idx long, seq long, start_ms long, end_ms long, text string, confidence double").repartition(3)
    where = spark.createDataFrame([(*k, *v) for k, v in pieces.items()], "source_id long, idx long, start_ms long, overlap_start_ms long")
    got = [(r.source_id, r.seq, r.idx, r.start_ms, r.text) for r in reassemble.reassembled(have, where, stretch=stretch).orderBy("source_id", "seq").collect()]
    assert got == plain_merge(rows, pieces)
    assert len(got) < len(rows)


def test_similarity_against_plain_python(spark):
    said = {}
    for r in fixtures.chunk_results(spark, SF).orderBy("source_id", "idx", "seq").collect():
        said.setdefault((r.source_id, r.idx), []).extend(r.text.split())
    edges = {k: (" ".join(w[:30]).lower(), " ".join(w[-30:]).lower()) for k, w in said.items()}
    want, before = {}, {}
    for source, idx in sorted(edges):
        if source in before:
            want[source, idx] = difflib.SequenceMatcher(None, before[source], edges[source, idx][0]).ratio()
        before[source] = edges[source, idx][1]
    got = {(r.source_id, r.idx): r.ratio for r in catalog.QUERIES["similarity"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_headers_names_and_lines(spark):
    pieces = spark.createDataFrame([("a", 0, 5000), ("a", 1, 9000), ("b", 0, 100)], "source_id string, idx long, end_ms long")
    languages = spark.createDataFrame([("a", 1, "fr"), ("a", 0, "en")], "source_id string, idx long, language string")
    assert sorted((r.source_id, r.language, r.duration_ms) for r in reassemble.headers(pieces, languages).collect()) == [("a", "en", 9000), ("b", "es", 100)]
    assert reassemble.matched(languages, pieces.filter("source_id = 'a'")).count() == 2
    with pytest.raises(Exception, match="a chunk has no result"):
        reassemble.matched(languages, pieces).collect()
    names = spark.createDataFrame([("/x/talk.one.mp3", 7), ("y.wav", 1234)], "s string, i long")
    assert [r.n for r in names.select(chunks.chunk_name(F.col("s"), F.col("i")).alias("n")).collect()] == ["talk.one_chunk007.wav", "y_chunk1234.wav"]
    segments = spark.createDataFrame([("a", 0, "X", 0, 1500, " hi ", 0.5), ("a", 1, None, 1500, 2000, "yo", 1.0)], "source_id string, seq long, speaker string, start_ms long, end_ms long, text string, confidence double")
    assert [r.line for r in render.segment_lines(segments).orderBy("seq").collect()] == ["[X] [0.0s → 1.5s] (50%) hi", "[1.5s → 2.0s] (100%) yo"]
    turned = align.turns(segments.withColumn("speaker", F.lit("X")).withColumn("text", F.repeat("text", 50)))
    assert render.turn_lines(turned).first().line == "[X] 0.0s–2.0s: " + ("hi " + " hi " * 19 + " hi")[:0] + turned.first().text[:80]
    assert render.summaries(segments, pipeline.results(segments, "en")).first().line == "language=en, duration=2.0s, segments=2, avg_confidence=75%"
    assert resume.completed(languages).first().idxs == [0, 1]
    assert audio.BATCH_SUFFIXES == (".mp3", ".wav", ".m4a", ".flac", ".ogg", ".opus", ".aac")


def test_log_levels():
    log.configure("DEBUG")
    assert logging.getLogger("voxweave").isEnabledFor(logging.DEBUG)
    log.configure("ERROR")
    assert not logging.getLogger("voxweave").isEnabledFor(logging.WARNING)
    out, others = io.StringIO(), list(logging.getLogger().handlers)
    log.configure("INFO", out)
    logging.getLogger("voxweave.plans.jobs").info("%d done", 3)
    assert out.getvalue().startswith("[info ") and out.getvalue().endswith("plans.jobs: 3 done\n") and logging.getLogger().handlers == others


def test_a_still_source_closes_its_turn(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "A", 0, 10, "x"), (1, 1, "A", 10, 20, "y"), (1, 2, "B", 20, 30, "z")], "source_id long, seq long, speaker string, start_ms long, end_ms long, text string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = streams.closed_turns(stream, idle_ms=500).writeStream.format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            if q.awaitTermination(1) or spark.table("closed").count() == 2:
                break
        assert sorted((r.turn_index, r.speaker, r.text) for r in spark.table("closed").collect()) == [(0, "A", "x y"), (1, "B", "z")]
    finally:
        q.stop()
