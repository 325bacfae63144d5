"""Recordings by ranges against whole files, and the sink of files."""

import io
import os
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_operators import wav
from voxweave.operators import chunks, render
from voxweave.plans import jobs, pipeline
from voxweave.sources import audio, recordings
from voxweave.sources.sink import FilesWriter

TALK = [(2000, True), (1500, False), (2000, True), (1000, False), (1000, True)]
PLAN = chunks.ChunkPlan(target_ms=3000, max_ms=4000, window_ms=1000)


def written(spans, rate=16_000, channels=1, width=2):
    """Loud and quiet spans (ms, loud) at any rate, as WAV."""
    x = np.concatenate([np.sin(np.arange(ms * rate // 1000) * 0.3) * (0.5 if loud else 0.0005) for ms, loud in spans])
    top = 1 << (8 * width - 1)
    values = np.repeat(np.clip(np.round(x * top), -top, top - 1).astype("i8"), channels)
    raw = (values + 128).astype("u1").tobytes() if width == 1 else values.astype("<i8").view("u1").reshape(-1, 8)[:, :width].tobytes()
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels), w.setsampwidth(width), w.setframerate(rate)
        w.writeframes(raw)
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    at = tmp_path / "in folder"
    at.mkdir()
    (at / "long.wav").write_bytes(wav(TALK * 4))
    (at / "other.WAV").write_bytes(written(TALK * 2, 44_100, 2, 3))
    (at / "bytes.wav").write_bytes(written(TALK, 8_000, 1, 1))
    (at / "damaged.wav").write_bytes(b"RIFF, but no more")
    (at / "empty.wav").write_bytes(written([(0, True)]))
    (at / "notes.txt").write_text("no sound")
    return str(at)


def test_each_byte_lies_in_one_range(spark, folder):
    rows = recordings.ranges(spark, folder, 70_000)
    found = {}
    for r in rows.collect():
        found.setdefault(os.path.basename(r.path), []).append(r)
    assert set(found) == {"long.wav", "other.WAV", "bytes.wav", "damaged.wav", "empty.wav"}
    assert "ValueError" in found["damaged.wav"][0].error and found["empty.wav"][0].frames == 0
    for name in ("long.wav", "other.WAV", "bytes.wav"):
        parts = sorted(found[name], key=lambda r: r["first"])
        with wave.open(os.path.join(folder, name)) as w:
            assert b"".join(bytes(p.pcm) for p in parts) == w.readframes(w.getnframes())
            assert all(p["first"] % p.rate == 0 and (p.rate, p.channels, p.width, p.frames) == (w.getframerate(), w.getnchannels(), w.getsampwidth(), w.getnframes()) for p in parts)
    assert len(found["long.wav"]) > 8 and rows.rdd.getNumPartitions() > 8
    heads = {os.path.basename(r.path): r for r in recordings.headers(spark, folder).collect()}
    assert heads["long.wav"].frames == 30 * 16_000 and heads["damaged.wav"].error and len(heads) == 5


def test_headers_of_other_forms():
    plain = written([(100, True)])
    fmt, data = plain[12:36], plain[44:]
    forms = {
        "a list first": b"RIFF\0\0\0\0WAVE" + b"LIST\x05\0\0\0abcde\0" + fmt + b"data" + len(data).to_bytes(4, "little") + data,
        "no length": b"RIFF\xff\xff\xff\xffWAVE" + fmt + b"data\xff\xff\xff\xff" + data,
        "long": b"RF64\xff\xff\xff\xffWAVE" + b"ds64\x1c\0\0\0" + (0).to_bytes(8, "little") + len(data).to_bytes(8, "little") + bytes(12) + fmt + b"data\xff\xff\xff\xff" + data,
        "extensible": b"RIFF\0\0\0\0WAVE" + b"fmt \x28\0\0\0\xfe\xff" + fmt[10:] + b"\x16\0\x10\0\0\0\0\0\x01\0" + bytes(14) + b"data" + len(data).to_bytes(4, "little") + data,
    }
    for name, content in forms.items():
        file = io.BytesIO(content)
        found = recordings.header(file, len(content))
        assert (found.rate, found.channels, found.width, found.frames) == (16_000, 1, 2, 1600), name
        assert recordings.pcm(file, found, 10, 20) == data[20:40], name
    for wrong in (b"", plain[:30], plain.replace(b"\x01\x00\x01\x00", b"\x03\x00\x01\x00", 1), b"RIFF\0\0\0\0WAVE" + b"data\0\0\0\0"):
        with pytest.raises((ValueError, Exception)):
            recordings.header(io.BytesIO(wrong), len(wrong))


@pytest.mark.parametrize("least", [300, 800, 2000])
def test_silences_across_ranges(spark, folder, least):
    """Quiet spans that cross edges of ranges, and such as fill a whole one, are those of the whole file."""
    quiet = [(700, True), (3300, False), (400, True), (950, False), (20, True), (1500, False), (1000, True)]
    with open(os.path.join(folder, "long.wav"), "wb") as f:
        f.write(wav(quiet * 3))
    found = {}
    for r in recordings.silences(recordings.ranges(spark, folder, 70_000), least).collect():
        found.setdefault(os.path.basename(r.path), []).append((r.start_ms, r.end_ms))
    whole = audio.samples(open(os.path.join(folder, "long.wav"), "rb").read())
    assert sorted(found.get("long.wav", [])) == audio.silent_spans(whole, audio.RATE, least)
    if least <= 800:  # at their own rates, as at that of engines
        for name in ("other.WAV", "bytes.wav"):
            want = audio.silent_spans(audio.samples(open(os.path.join(folder, name), "rb").read()), audio.RATE, least)
            assert np.allclose(sorted(found[name]), want, atol=3), name


def test_pieces_by_range(spark, folder, tmp_path):
    held = recordings.Folder(spark, folder, 70_000)
    same = pipeline.Contents(pipeline.read(spark, folder).filter("path like '%long.wav'"))
    pieces = pipeline.plan_chunks(held, PLAN).cache()
    mine = pieces.filter("source_id like '%long.wav'")
    strip = lambda df: sorted(tuple(r)[1:] for r in df.collect())
    assert strip(mine) == strip(pipeline.plan_chunks(same, PLAN)) and mine.count() > 5
    a = {r.idx: bytes(r.content) for r in held.cut(mine).collect()}
    b = {r.idx: bytes(r.content) for r in same.cut(mine.withColumn("source_id", F.lit(same.files.first().path))).collect()}
    assert a == b
    # a piece of another rate: its own frames, at the engines' rate
    other = pieces.filter("source_id like '%other.WAV'")
    for r in held.cut(other).join(other.withColumnRenamed("source_id", "path"), ["path", "idx"]).collect():
        ms = r.end_ms + r.overlap_end_ms - r.start_ms + r.overlap_start_ms
        assert abs(len(audio.samples(bytes(r.content))) - ms * 16) <= 16
    segments, heads = jobs.transcribe_in_pieces(held, PLAN, str(tmp_path / "table"), unit=5)
    assert {os.path.basename(r.source_id) for r in heads.collect()} == {"long.wav", "other.WAV", "bytes.wav", "empty.wav"}
    assert segments.filter("source_id like '%long.wav'").count() == 9
    pieces.unpersist()


def test_what_a_lower_rate_cannot_hold_is_taken_out():
    t = np.arange(44_100) / 44_100
    low, high = np.sin(2 * np.pi * 440 * t), np.sin(2 * np.pi * 15_000 * t)
    got = audio.resampled(low + high, 44_100, 16_000)
    want = np.sin(2 * np.pi * 440 * np.arange(16_000) / 16_000)
    assert np.abs(got - want)[200:-200].max() < 0.03


def test_files_appear_with_the_commit_only(spark, tmp_path):
    rows = spark.createDataFrame([(f"s{k}", '{"a": [1]}' if k else '{"b": "ö"}') for k in range(20)], "source_id string, body string").repartition(4)
    assert render.write(rows, str(tmp_path / "out"), ".json") == 20
    assert sorted(os.listdir(tmp_path / "out")) == sorted(f"s{k}.json" for k in range(20))
    assert (tmp_path / "out/s0.json").read_text() == '{\n  "b": "ö"\n}'
    # a task that fails: no file at all, and nothing is left of the others
    broken = rows.withColumn("body", F.when(F.col("source_id") == "s7", F.lit("{no json")).otherwise(F.col("body")))
    with pytest.raises(Exception, match="s7|JSON|Expecting"):
        render.write(broken, str(tmp_path / "none"), ".json")
    assert not (tmp_path / "none").exists() or os.listdir(tmp_path / "none") == []
    assert render.write(rows.limit(3).withColumn("body", F.lit("new")), str(tmp_path / "out"), ".txt") == 3
    assert len(os.listdir(tmp_path / "out")) == 23


def test_attempts_that_do_not_count_leave_nothing(tmp_path, monkeypatch):
    """Two attempts of a task, of which one is committed; one that was killed in its midst; and an abort."""
    import pyspark

    class Task:
        def partitionId(self):
            return 0

        def attemptNumber(self):
            return 0

    monkeypatch.setattr(pyspark.TaskContext, "get", staticmethod(Task))
    writer = FilesWriter({"path": str(tmp_path / "out"), "ext": ".txt"}, False)
    writer.write(iter([("a", "first"), ("b", "first")]))
    kept = writer.write(iter([("a", "second"), ("b", b"second")]))

    def killed():
        yield "a", "third"
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        writer.write(killed())
    assert [n for n in os.listdir(tmp_path / "out") if not n.startswith(".")] == []
    writer.commit([kept, None])
    assert {n: (tmp_path / "out" / n).read_text() for n in os.listdir(tmp_path / "out")} == {"a.txt": "second", "b.txt": "second"}
    again = FilesWriter({"path": str(tmp_path / "out")}, False)
    again.abort([again.write(iter([("c", "x")]))])
    assert sorted(os.listdir(tmp_path / "out")) == ["a.txt", "b.txt"]
