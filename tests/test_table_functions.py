"""Engines and turns in SQL."""

import pytest

from tests.test_operators import wav
from voxweave.operators import align, models, table_functions

TALK = [(2000, True), (1500, False), (2000, True), (1000, False), (400, True)]


@pytest.fixture
def known(spark):
    table_functions.register(spark)
    spark.createDataFrame([("one", wav(TALK)), ("damaged", b"RIFF, but no more")], "path string, content binary").createOrReplaceTempView("files")
    return spark


def test_transcribe(known):
    rows = known.sql("SELECT * FROM transcribe(TABLE(SELECT path, content, 1 AS extra FROM files))").collect()
    said = sorted((r.seq, r.start_ms, r.end_ms, r.confidence) for r in rows if r.status == "DONE")
    want = [(r.seq, r.start_ms, r.end_ms, r.confidence) for r in models.transcribed(known.table("files")).orderBy("seq").collect()]
    assert said == want and len(said) == 3
    failed = [r for r in rows if r.status == "FAILED"]
    assert [r.source_id for r in failed] == ["damaged"] and "Error" in failed[0].error and failed[0].seq is None
    # an option that the engine takes: what is shorter than 250 ms is no speech
    fewer = known.sql("SELECT * FROM transcribe(TABLE(files), engine => 'loudness', vad_filter => true)").filter("status = 'DONE'")
    assert fewer.count() == 3


def test_diarize(known):
    rows = known.sql("SELECT * FROM diarize(TABLE(files), num_speakers => 3)").filter("status = 'DONE'").orderBy("dseq").collect()
    assert [r.speaker for r in rows] == ["SPEAKER_00", "SPEAKER_01", "SPEAKER_02"]


@pytest.mark.parametrize(
    ("call", "said"),
    [
        ("transcribe(TABLE(files), engine => 'none')", "unknown engine"),
        ("transcribe(TABLE(SELECT path FROM files))", "the table has no content"),
        ("transcribe(TABLE(files), beam_size => 99)", "beam_size"),
        ("diarize(TABLE(files), num_speakers => 0)", "one at least"),
        ("speaker_turns(TABLE(files))", "the table has no source_id"),
    ],
)
def test_errors_of_analysis(known, call, said):
    with pytest.raises(Exception, match=said):
        known.sql(f"SELECT * FROM {call}").schema  # noqa: B018


def test_turns(known):
    rows = [(s, k, "AB"[k // 3 % 2] if k % 4 else None, k * 10, k * 10 + 5, f" w{k} ") for s in (1, 2, 3) for k in range(20)]
    labelled = known.createDataFrame(rows, "source_id long, seq long, speaker string, start_ms long, end_ms long, text string").repartition(3)
    got = known.sql("SELECT * FROM speaker_turns(TABLE({rows}))", rows=labelled)
    want = align.turns(labelled, carry=True).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert known.sql("SELECT * FROM speaker_turns(TABLE({rows}))", rows=labelled.limit(0)).count() == 0
