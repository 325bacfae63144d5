"""Decontamination and licence scans against DuckDB, and on awkward rows."""

import random
import re

import duckdb
import pytest

from tests.llm import cases
from voxweave.llm import decontaminate, licenses, tables
from voxweave.llm.tables import table

SF = "/root/testdata/sf0.01"


def oracle(sql, **frames):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        if name in frames:
            con.register(name, frames[name])
        else:
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    rel = con.sql(sql)
    order = sorted(rel.columns)
    return order, sorted(tuple(r[rel.columns.index(c)] for c in order) for r in rel.fetchall())


def got(df):
    order = sorted(df.columns)
    return order, sorted(tuple(r[c] for c in order) for r in df.collect())


def test_decontamination_table(spark):
    ours = got(decontaminate.op8_decontaminate(table(spark, SF, "documents"), table(spark, SF, "benchmark")))
    assert ours == oracle(decontaminate.SQL) and len(ours[1]) > 5


@pytest.mark.parametrize("limit", [tables.BROADCAST_BYTES, 0])
def test_decontamination_cases(spark, monkeypatch, limit):
    monkeypatch.setattr(tables, "BROADCAST_BYTES", limit)
    docs = cases.frame(spark, extra=True)
    items = spark.createDataFrame(
        [(1, "quick brown FOX jumps over the lazy dog. a"), (2, None), (3, ""), (4, "word"), (5, "more words"), (6, "a b c d e f g h"), (7, "not there at all, is it"), (8, "a b c d e f g h"), (9, "jumps over the lazy dog. but then not much else here")],
        "item_id long, text string",
    )
    want = oracle(decontaminate.SQL, documents=docs.select("doc_id", "text").toPandas(), benchmark=items.toPandas())
    assert got(decontaminate.op8_decontaminate(docs, items)) == want
    assert {(r[1], r[2]) for r in want[1]} >= {(0, 1), (4, 4), (7, 6), (7, 8)}
    assert got(decontaminate.op8_decontaminate(docs.union(docs), items.union(items))) == want
    assert decontaminate.op8_decontaminate(cases.empty(spark), items).count() == 0
    assert decontaminate.op8_decontaminate(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [tables.BROADCAST_BYTES, 0])
def test_decontamination_without_ids(spark, monkeypatch, limit):
    monkeypatch.setattr(tables, "BROADCAST_BYTES", limit)
    a, b, c = "one two three four five six", "red green blue black white grey", "up down left right in out"
    docs = spark.createDataFrame([(None, "x " + a), (None, c + " y"), (1, "z " + b), (2, "nothing at all of these items")], "doc_id long, text string")
    items = spark.createDataFrame([(None, b), (1, a), (2, c), (3, "not in any of these documents")], "item_id long, text string")
    found = decontaminate.op8_decontaminate(docs, items)
    assert {(r.doc_id, r.item_id, r.n_shingles, r.shared) for r in found.collect()} == {(None, 1, 2, 2), (None, 2, 2, 2), (1, None, 2, 2)}


def test_long_items_are_found_by_their_sketches(spark):
    """Items of up to 600 shingles, with part of their words changed, at and about the threshold: sketches of a fixed size against exact search."""
    rng = random.Random(5)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = [fresh(rng.choice([80, 150, 300, 600])) for _ in range(40)]
    items = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "item_id long, text string")
    docs = []
    for k, t in enumerate(texts):
        for lost in (0.0, 0.02, 0.04, 0.055, 0.06, 0.1, 0.3):
            part = [w if rng.random() >= lost else "other" for w in t]
            docs.append((len(docs), " ".join(fresh(50) + part + fresh(400))))
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    shown = lambda df: sorted((r.doc_id, r.item_id, r.shared) for r in df.collect())
    exact = shown(decontaminate.contained(docs, items, exact=True))
    assert shown(decontaminate.contained(docs, items)) == exact and len(exact) > 120
    sizes = {r.item_id: r.n for r in decontaminate.sketches(decontaminate.item_shingles(items)).groupBy("item_id").agg(decontaminate.F.count("*").alias("n")).collect()}
    assert all(n == decontaminate.SKETCH for n in sizes.values())


def test_thousands_of_rows_without_id_are_met_once(spark):
    """5,000 documents and 100 items without an id or with one id: the rows of the check grow with the texts, not with texts times items."""
    item = lambda k: " ".join(f"i{k}-{j}" for j in range(9))
    docs = spark.createDataFrame([(None if k % 2 else 7, f"words before {item(k % 100)} and after") for k in range(5000)], "doc_id long, text string").repartition(4)
    items = spark.createDataFrame([(k, item(k)) for k in range(100)], "item_id long, text string")
    shingles = decontaminate.item_shingles(items).cache()
    assert decontaminate.matched(docs, shingles).count() == 500
    found = decontaminate.contained(docs, items).collect()
    assert sorted((r.doc_id or 0, r.item_id, r.shared) for r in found) == sorted((0 if k % 2 else 7, k, 5) for k in range(100))
    shingles.unpersist()


def test_long_text_around_a_short_item(spark):
    words = " ".join(f"w{k % 9973}" for k in range(3_000_000))
    docs = spark.createDataFrame([(1, words + " a needle in this very large stack " + words[:1000])], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a needle in this very large stack"), (2, "short one")], "item_id long, text string")
    assert [(r.item_id, r.shared) for r in decontaminate.contained(docs, items).collect()] == [(1, 3)]


def test_licenses_table(spark):
    ours = got(licenses.op9_licenses(table(spark, SF, "documents")))
    assert ours == oracle(licenses.SQL) and len(ours[1]) > 5


def test_licenses_cases(spark):
    mit = dict(licenses.KNOWN)["MIT"]
    texts = [
        (1, "Copyright (c) 2020 Someone\n\n" + mit),
        (2, mit.upper().replace(",", " ").replace(" ", "  ")),
        (3, "Intro.\n\nReleased  under the MIT Licence!\nlicensed under cc by-nc 4.0\nlicensed under cc by-nc 4.0"),
        (4, "licensed to nobody"),
        (5, None),
        (6, ""),
        (7, mit + " except on Sundays"),
        (None, "Licensed under the Apache License, Version 2.0."),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    out = {(r.doc_id, r.scope, r.place, r.license) for r in licenses.op9_licenses(docs).collect()}
    whole = {x for x in out if x[1] == "text"}
    assert whole == {(1, "text", 0, "MIT"), (2, "text", 0, "MIT"), (None, "text", 0, "Apache-2.0")}
    assert {(3, "line", 2, "MIT"), (3, "line", 3, "CC-BY-NC-4.0"), (3, "line", 4, "CC-BY-NC-4.0")} <= out
    assert not any(x[0] in (4, 5, 6) for x in out)
    assert licenses.op9_licenses(cases.frame(spark, extra=True)).count() == 0
    assert licenses.op9_licenses(cases.empty(spark)).count() == 0
    assert licenses.op9_licenses(docs.union(docs)).count() == 2 * licenses.op9_licenses(docs).count()


def test_known_texts_inside_longer_ones(spark):
    """Licences with blank lines, in the middle of other text, with their own copyright lines and spellings."""
    by = {}
    for name, text in licenses.KNOWN:
        by.setdefault(name, []).append(text)
    rows, want = [], set()
    for k, (name, texts) in enumerate(sorted(by.items())):
        text = max(texts, key=len)
        inside = "Some words.\n\nCopyright (c) 2021 A. Body\n\n" + re.sub(r"\blicense\b", "licence", text) + "\n \nAnd more words."
        rows.append((k, inside))
        want.add((k, name))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = licenses.op9_licenses(docs).collect()
    assert {(r.doc_id, r.license) for r in found} == want
    assert all(r.place in (2, 3) for r in found if r.scope == "blocks")  # with its heading, and without
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    theirs = con.sql(licenses.SQL).fetchall()
    assert sorted(theirs) == sorted((r.doc_id, r.scope, r.place, r.license, r.digest) for r in found)


def test_anchors_of_other_texts(spark):
    texts = [("own", "Use it for zymurgy only.")]
    docs = spark.createDataFrame([(1, "use it for ZYMURGY only"), (2, "x")], "doc_id long, text string")
    assert [(r.doc_id, r.license) for r in licenses.scan(docs, texts).filter("scope = 'text'").collect()] == [(1, "own")]
    assert [r.doc_id for r in licenses.scan(docs, [("odd", "Ξ")]).collect()] == []


def test_every_known_text_has_an_anchor():
    assert all(any(a in text.lower() for a in licenses.anchors()) for _, text in licenses.KNOWN)
