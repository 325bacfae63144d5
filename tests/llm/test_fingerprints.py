"""Fingerprints: edited texts against plain Python, equality, order, insertion, deletion and likeness."""

import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from voxweave.llm import fingerprints as fp
from voxweave.llm import tables
from voxweave.llm.tables import table


def edited(rows):
    """rows: doc_id, text, hash of the text (null: empty), by which repeated doc_ids go."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2]), reverse=True)
    texts = [t or "" for _, t, _ in rows]
    out = []
    for k, (doc, _, _) in enumerate(rows):
        text, after = texts[k], texts[(k + 1) % len(rows)]
        cut = len(text) // 3
        whole = text[: len(text) - cut] + after[:cut]
        out.append((doc, len(text), hashlib.sha256(whole.encode()).hexdigest()))
    return sorted(out, key=repr)


def check(docs):
    rows = [(r.doc_id, r.text, r.tie) for r in docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie")).collect()]
    got = fp.op1_fingerprints(docs).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=repr) == edited(rows)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    return got


@pytest.mark.parametrize("size", [2000, 3])
def test_cases(spark, monkeypatch, size):
    monkeypatch.setattr(tables, "RANGE_ROWS", size)
    docs = cases.frame(spark, extra=True)
    got = {r.doc_id: r for r in check(docs)}
    assert got[0].fingerprint == got[5].fingerprint == got[8].fingerprint  # equal texts, and one with its paragraphs the other way round
    assert got[1].fingerprint == got[2].fingerprint != got[3].fingerprint
    assert len({got[k].fingerprint for k in (0, 2, 3, 4, 6, 7, 9, 12)}) == 8
    check(docs.union(docs))
    check(spark.createDataFrame([(None, "a b c"), (None, "d e f g"), (3, None)], "doc_id long, text string"))
    check(spark.createDataFrame([(5, "only one of them")], "doc_id long, text string"))
    assert fp.op1_fingerprints(cases.empty(spark)).count() == 0


def test_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    got = check(docs)
    assert sum(r.near_edited for r in got) / len(got) > 0.5 > 0.1 > sum(r.near_next for r in got) / len(got)
    by_text = {}
    for r, t in ((r, t) for r in got for t in [next(x.text for x in docs.filter(F.col("doc_id") == r.doc_id).collect())] if r.doc_id < 5):
        by_text.setdefault(t, set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values())


def test_ranges_of_outlying_repeated_and_missing_ids(spark, monkeypatch):
    """No range holds twice the rows that it should, and the order is kept across ranges."""
    monkeypatch.setattr(tables, "RANGE_ROWS", 40)
    rows = [(k, f"document number {k} of some") for k in range(300)] + [(10**17, "far away"), (-(2**63), "least"), (2**63 - 1, "most")]
    rows += [(7, "the same row")] * 200 + [(8, f"another text {k}") for k in range(200)] + [(None, f"no id {k}") for k in range(100)] + [(None, None)] * 100
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found, n = tables.id_ranges(docs)
    sizes = [r["count"] for r in found.groupBy("range").count().collect()]
    assert sum(sizes) == len(rows) and len(sizes) > 0.8 * n and max(sizes) <= 2 * 40
    low = {r["range"]: (r.a, r.b) for r in found.groupBy("range").agg(F.min(F.struct(*tables.KEY)).alias("a"), F.max(F.struct(*tables.KEY)).alias("b")).collect()}
    ends = [x for k in sorted(low) for x in low[k]]
    assert ends == sorted(ends)
    check(docs)


def test_likeness_against_python(spark):
    """Lanes, cosine and both likenesses of the query, from hashes that Spark gives for single runs."""
    docs = table(spark, "/root/testdata/sf0.001", "documents").filter("doc_id < 40")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    order = sorted(texts, reverse=True)

    def runs(text):
        out = []
        for paragraph in text.split("\n"):
            words = re.findall(r"[^ \t\n\x0b\f\r]+", paragraph)
            places = [m.span() for m in re.finditer(r"[^ \t\n\x0b\f\r]+", paragraph)]
            out += [paragraph[places[k][0] : places[k + 3][1]] for k in range(len(words) - 3)] or ([paragraph[places[0][0] :].rstrip(" ")] if words else [])
        return out

    edited_texts = {}
    for k, doc in enumerate(order):
        cut = len(texts[doc]) // 3
        edited_texts[doc] = texts[doc][: len(texts[doc]) - cut] + texts[order[(k + 1) % len(order)]][:cut]
    every = sorted({x for t in [*texts.values(), *edited_texts.values()] for x in runs(t)})
    hashes = spark.createDataFrame([(x,) for x in every], "x string").select("x", *[F.xxhash64("x", F.lit(w)).alias(f"h{w}") for w in range(fp.HASHES)])
    known = {r.x: [r.h0, r.h1] for r in hashes.collect()}

    def lanes(text):
        found = runs(text)
        return np.array([sum(known[x][w] >> (fp.STRIDE * k + b) & 1 for x in found) for w in range(fp.HASHES) for k in range(fp.PACKED) for b in range(fp.STRIDE)]) * 2.0 - len(found)

    def like(a, b):
        norm = math.sqrt(float(a @ a) * float(b @ b))
        return min(1.0, max(0.0, float(a @ b) / norm)) if norm else 0.0

    for r in fp.op1_fingerprints(docs).collect():
        after = texts[order[(order.index(r.doc_id) + 1) % len(order)]]
        for got, other in ((r.near_edited, edited_texts[r.doc_id]), (r.near_next, after)):
            same = sorted(texts[r.doc_id].split("\n")) == sorted(other.split("\n"))
            assert abs(got - (1.0 if same else like(lanes(texts[r.doc_id]), lanes(other)))) < 1e-9


def test_sums_are_insertion_and_deletion(spark):
    rows = spark.createDataFrame([("ab", "one two three four five\nsix"), ("a", "one two three four five"), ("b", "six"), ("aab", "six\none two three four five\none two three four five")], "k string, text string")
    lanes = {r.k: r.lanes for r in fp.fingerprint(rows, ["k"], "text").collect()}
    one = spark.createDataFrame([(lanes["a"], lanes["b"], lanes["ab"], lanes["aab"])], "a array<bigint>, b array<bigint>, ab array<bigint>, aab array<bigint>")
    r = one.select(fp.combined(F.col("a"), F.col("b")).alias("sum"), fp.removed(F.col("ab"), F.col("b")).alias("less"), fp.combined(F.col("ab"), F.col("a")).alias("more"), fp.likeness(F.col("ab"), F.col("ab")).alias("same"), fp.likeness(F.col("a"), F.col("b")).alias("other")).first()
    assert r.sum == lanes["ab"] and r.less == lanes["a"] and r.more == lanes["aab"] and r.same == 1.0 and r.other < 0.6


def test_a_word_put_in_keeps_texts_alike(spark):
    words = [f"w{k * k % 211}x{k}" for k in range(120)]
    texts = [words, ["new", *words], words[:40] + words[41:], ["other", *(w[::-1] for w in words)], ["a", "b"], []]
    rows = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "k long, text string")
    lanes = {r.k: r.lanes for r in fp.fingerprint(rows, ["k"], "text").collect()}
    assert [lanes[k][fp.EQUAL_LANES] for k in range(6)] == [117, 118, 116, 118, 1, 0]
    pairs = spark.createDataFrame([(k, lanes[0], lanes[k]) for k in (1, 2, 3)], "k long, a array<bigint>, b array<bigint>")
    like = {r.k: r.v for r in pairs.select("k", fp.likeness(F.col("a"), F.col("b")).alias("v")).collect()}
    assert like[1] > 0.85 and like[2] > 0.8 and like[3] < 0.5


def test_ranges_have_a_bound(spark, monkeypatch):
    """However small a range should be, there are no more of them than MOST_RANGES, and the rows are the same."""
    docs = spark.createDataFrame([(k, f"word {k} and more", None, None, None) for k in range(60)], cases.SCHEMA)
    want = sorted(map(tuple, fp.op1_fingerprints(docs).collect()))
    monkeypatch.setattr(tables, "RANGE_BYTES", 10)
    monkeypatch.setattr(tables, "MOST_RANGES", 7)
    rows, n = tables.id_ranges(docs.select("doc_id", "text"))
    assert n == 7 and rows.select("range").distinct().count() == 7
    assert sorted(map(tuple, fp.op1_fingerprints(docs).collect())) == want
