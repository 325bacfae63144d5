"""Streams: rows in any order, work in units that are done once, and halts that leave other work alone."""

import random
import threading
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from voxweave.operators import align, halt
from voxweave.streaming import ordered, units

BEGIN = datetime(2024, 1, 1)
SCHEMA = "source_id long, seq long, speaker string, ts timestamp, start_ms long, end_ms long, text string"


def talk(seed, sources=4, rows=40):
    rng = random.Random(seed)
    return [(s, k, rng.choice(["A", "B", None, ""]), BEGIN + timedelta(seconds=10 * k), k * 100, k * 100 + 90, f" said {k} ") for s in range(sources) for k in range(rows)]


def streamed(spark, make, batches, name, where):
    ordered.use_rocksdb(spark)
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{where}/in{k}")
    out = None
    # a batch at a time on one checkpoint, as micro-batches that come one after another
    for k in range(len(batches)):
        spark.read.parquet(f"{where}/in{k}").coalesce(1).write.mode("append").parquet(f"{where}/stream")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{where}/stream")
        q = make(stream).writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/check").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert q.exception() is None
        out = spark.read.parquet(f"{where}/out")
    return out


def shuffled(seed, rows, count, reach):
    """Rows in micro-batches, none of which comes later than reach seconds after one that is newer; then a row of another source that moves the watermark on."""
    rng = random.Random(seed)
    order = sorted(rows, key=lambda r: (r[3] - BEGIN).total_seconds() + rng.random() * reach)
    size = -(-len(order) // count)
    parts = [order[k : k + size] for k in range(0, len(order), size)]
    for p in parts:
        rng.shuffle(p)
    end = BEGIN + timedelta(days=2)
    return parts + [[(99, 0, "Z", end, 0, 1, "end")]]


def test_rows_in_any_order_are_labelled_as_in_a_batch(spark, tmp_path):
    rows = talk(1)
    batches = shuffled(2, rows, 4, 120)
    assert any(a[1] > b[1] for p in batches for a, b in zip(p, p[1:]) if a[0] == b[0])
    got = streamed(spark, lambda s: ordered.labelled(s, "200 seconds"), batches, "labels", str(tmp_path))
    want = align.carried(spark.createDataFrame(rows, SCHEMA).withColumn("speaker", F.expr("nullif(speaker, '')")))
    assert sorted((r.source_id, r.seq, r.speaker) for r in got.filter("source_id < 99").collect()) == sorted((r.source_id, r.seq, r.speaker) for r in want.collect())


def test_turns_of_rows_in_any_order_and_finished_sources(spark, tmp_path):
    rows = talk(3, sources=3)
    # source 0 goes on after a day: it was finished, and begins anew
    late = [(0, 100 + k, "C", BEGIN + timedelta(days=1, seconds=k), k, k + 1, "later") for k in range(3)]
    got = streamed(spark, lambda s: ordered.turns(s, "200 seconds", 600_000), shuffled(4, rows, 3, 120)[:-1] + [late] + shuffled(4, rows, 3, 120)[-1:], "turns", str(tmp_path))
    carried = {}
    want = []
    for s, _, speaker, _, a, b, text in rows:
        now = speaker or (carried[s][2] if s in carried else "UNKNOWN")
        if s in carried and carried[s][2] == now:
            carried[s] = (*carried[s][:4], b, f"{carried[s][5]} {text.strip()}")
        else:
            if s in carried:
                want.append(carried[s])
            carried[s] = (s, carried[s][1] + 1 if s in carried else 0, now, a, b, text.strip())
    want += carried.values()
    want.append((0, 0, "C", 0, 3, "later later later"))
    assert sorted(map(tuple, got.filter("source_id < 99").collect())) == sorted(want)


def test_units_are_done_once(spark, tmp_path):
    rows = spark.range(50).withColumn("unit", F.col("id") % 5)
    done, folder = [], str(tmp_path / "work")

    def each(batch, number):
        mine = sorted(r.id for r in batch.collect())
        if len(done) == 2 and not broken:
            broken.append(1)
            raise OSError("lost")
        done.append(mine)

    broken = []
    with pytest.raises(Exception, match="lost"):
        units.run(rows, each, halt.Halt(), folder)
    assert len(done) == 2
    stop = halt.Halt()
    stop.ask("a test")
    with pytest.raises(halt.Halted, match="after some"):
        units.run(rows, each, stop, folder)
    assert len(done) == 2
    units.run(rows, each, halt.Halt(), folder)
    units.run(rows, each, halt.Halt(), folder)
    assert len(done) == 5 and sorted(x for d in done for x in d) == list(range(50))


def test_a_second_signal_ends_the_unit_and_no_other_work(spark, tmp_path):
    stop, other, began = halt.Halt(), [], threading.Event()

    def each(batch, number):
        began.set()
        spark.range(0, 2, 1, 2).foreach(lambda r: time.sleep(60))

    t = threading.Thread(target=lambda: other.append(spark.range(0, 1, 1, 1).rdd.map(lambda x: time.sleep(6) or 1).count()))
    t.start()

    def signals():
        began.wait(60)
        time.sleep(1)
        stop.ask("first")
        stop.at_once()

    s = threading.Thread(target=signals)
    s.start()
    at = time.time()
    try:
        units.run(spark.range(4).withColumn("unit", F.col("id") % 2), each, stop, str(tmp_path / "work"))
    except Exception:  # the unit was broken off
        pass
    assert time.time() - at < 50
    t.join(60), s.join(60)
    assert other == [1]
