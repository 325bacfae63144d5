"""Adaptive time partitions against a plain version, file by file."""

import calendar
import hashlib
import random
import zlib
from datetime import datetime, timedelta

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from voxweave.llm import time_layout
from voxweave.llm.tables import table

EPOCH, BEFORE = datetime(1970, 1, 1), datetime(2024, 3, 1)
SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"


def moment(r):
    if r[1] is None or r[0] is None:
        return r[1]
    k = zlib.crc32(str(r[0]).encode()) % 128
    if k < 16:
        return r[1] - timedelta(days=(k + 6) ** 3)
    return datetime.combine((r[1] - timedelta(days=r[1].weekday())).date(), datetime.min.time()) if k > 111 else r[1]


def plain_layout(rows, limit):
    """(leaf, part) -> rows in their order."""
    out = {}
    order = lambda r: (moment(r) or EPOCH, (r[2] is not None, r[2] or EPOCH), (r[0] is not None, r[0] or 0))

    def put(name, found):
        found = sorted(found, key=order)
        for k in range(0, len(found), limit):
            out[name, k // limit + 1] = found[k : k + limit]

    def split(depth, rows, members, parents):
        runs = []
        for k in members:
            mine = [r for r in rows if (moment(r).year, moment(r).month, moment(r).day, moment(r).hour)[depth] == k]
            if len(mine) > limit and depth < 3:
                below = [range(1, 13), range(1, calendar.monthrange(int(parents[:4] or k), k if depth == 1 else 1)[1] + 1), range(24)][depth]
                split(depth + 1, mine, below, f"{parents}{k:04d}/" if depth == 0 else f"{parents}{k:02d}/")
                runs.append(None)
            elif runs and runs[-1] and len(runs[-1][2]) + len(mine) <= limit:
                runs[-1][1] = k
                runs[-1][2].extend(mine)
            else:
                runs.append([k, k, mine])
        for run in runs:
            if run and run[2]:
                width = 4 if depth == 0 else 2
                put(f"{parents}{run[0]:0{width}d}-{run[1]:0{width}d}", run[2])

    timed = [r for r in rows if r[1] is not None]
    if timed:
        years = [moment(r).year for r in timed]
        split(0, timed, range(min(years), max(years) + 1), "")
    put("null", [r for r in rows if r[1] is None])
    return out


def ids(rows):
    return hashlib.sha256(",".join("" if r[0] is None else str(r[0]) for r in rows).encode()).hexdigest()


def brute(rows, share):
    limit = 1 + len(rows) // share
    early = lambda r: r[2] is not None and r[2] < BEFORE
    first, last = plain_layout([r for r in rows if early(r)], limit), plain_layout(rows, limit)
    same = lambda place: place in first and sorted(map(repr, first[place])) == sorted(map(repr, last[place]))
    return sorted((leaf, part, len(found), sum(not early(r) for r in found), not same((leaf, part)), ids(found)) for (leaf, part), found in last.items())


def check(spark, df, rows, share=40):
    made = None if share == 650 else time_layout.laid_out(df, time_layout.click_moment(), "arrived_at", "click_id", str(BEFORE), time_layout.scratch(spark, "test"), share)
    found = (made or time_layout.op11_time_partitions(df)).collect()
    assert sorted((r.leaf, r.part, r.n_rows, r.n_new, r.rewritten, r.ids_sha256) for r in found) == brute(rows, share)
    assert len({r.path for r in found}) == len(found)
    assert {r.columns for r in found} <= {",".join(df.columns)}
    # whole rows, from the files themselves; no others are there
    if found:
        each = [[tuple(x[c] for c in df.columns) for x in pq.ParquetFile(r.path.removeprefix("file://")).read().to_pylist()] for r in found]
        assert sorted(map(repr, sum(each, []))) == sorted(map(repr, rows))
        folder = found[0].path.rsplit("/", 2)[0]
        assert sorted(p for ps in time_layout.listed(spark, folder).values() for p in ps) == sorted(r.path for r in found)
    return found


def clicks(seed, n, hours=24 * 120, busy=0.0, days=0.1):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        at = datetime(2024, 1, 1) + timedelta(hours=rng.random() * hours)
        if rng.random() < busy:
            at = datetime(2024, 2, 28, 22, 30) + timedelta(seconds=rng.randrange(3))
        ts = None if rng.random() < 0.03 else at
        arrived = None if rng.random() < 0.01 else at + timedelta(days=rng.expovariate(1 / days), microseconds=rng.randrange(10))
        out.append((None if rng.random() < 0.01 else k, ts, arrived, k % 7, None, k / 8, "{}"))
        if rng.random() < 0.05:
            out.extend([out[-1]] * rng.choice([1, 2, 9]))
    return out


@pytest.mark.parametrize("rows", [clicks(1, 900), clicks(2, 3000, busy=0.4), clicks(3, 1500, hours=30, days=40), clicks(4, 40), []], ids=["spread", "busy", "late", "few", "none"])
def test_against_plain(spark, rows):
    check(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), rows)


def test_alike_rows_cross_boundaries(spark):
    """A part's edge falls among rows that are alike in every column, and among rows of one id and time that differ otherwise."""
    at = datetime(2024, 2, 5)
    rows = [(5, at, at, 1, "a", 0.5, None)] * 40 + [(5, at, at, 1, f"k{k}", 1.0, None) for k in range(40)] + clicks(5, 700) + [(None, None, None, None, None, None, None)] * 9
    check(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), rows)


def test_clashing_names_and_files_that_stay(spark):
    rows = clicks(6, 1200)
    df = spark.createDataFrame(rows, SCHEMA)
    extra = [(*r, 1, "x", 2, 3, 4, 5) for r in rows]
    names = ["file", "_m", "_a", "_r", "_year", "_f0"]
    for name, value in zip(names, (1, "x", 2, 3, 4, 5)):
        df = df.withColumn(name, F.lit(value))
    found = check(spark, df, extra)
    assert any(not r.rewritten for r in found) and any(r.rewritten for r in found)


def test_selection_by_small_digits(spark, monkeypatch):
    monkeypatch.setattr(time_layout, "DIGIT", 3)
    rows = clicks(7, 2000, busy=0.5)
    check(spark, spark.createDataFrame(rows, SCHEMA).repartition(2), rows)


def test_table(spark):
    df = table(spark, "/root/testdata/sf0.001", "clicks")
    check(spark, df, [tuple(r) for r in df.collect()], 650)
