"""Texts of a megabyte and more through operators whose own tests have short ones; ties of scores."""

import random

from voxweave.llm import decontaminate, fingerprints, licenses, near, toxicity


def long_text(words=160_000, seed=1):
    rng = random.Random(seed)
    return " ".join(f"word{rng.randrange(5000)}" + ("\n" if k % 40 == 39 else "") for k in range(words))


def test_fingerprints(spark):
    text = long_text()
    docs = spark.createDataFrame([(1, text), (2, text + "\none more line of text"), (3, "short")], "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints.op1_fingerprints(docs).collect()}
    assert got[1].n_chars == len(text) and got[2].near_next > 0.99 and got[3].near_next < 0.5


def test_near_copies(spark):
    text = long_text()
    docs = spark.createDataFrame([(1, text), (2, text + " end"), (3, long_text(seed=2)[: len(text) // 3]), (4, "one run " + "x" * 2_000_000)], "doc_id long, text string")
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in near.op2_ngram_join(docs).collect()}
    assert got[1][0] == got[2][0] == 1 and got[3][0] == 3 and got[4] == (4, 1)


def test_items_inside(spark):
    item = "these seven words are a benchmark item for certain"
    docs = spark.createDataFrame([(1, long_text() + " " + item + " " + long_text(seed=3)), (2, long_text())], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, "none of this is anywhere in those documents at all")], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.containment) for r in decontaminate.contained(docs, items).collect()] == [(1, 7, 1.0)]


def test_licences_inside(spark):
    notice = "Released under the MIT License."
    docs = spark.createDataFrame([(1, long_text() + "\n\n" + notice + "\n\n" + long_text(seed=3))], "doc_id long, text string")
    assert {(r.doc_id, r.license) for r in licenses.op9_licenses(docs).collect()} == {(1, "MIT")}


def test_toxicity_of_long_and_of_equal_texts(spark):
    rows = [(k, f"calm words of text number {k % 7} here", 0) for k in range(60)] + [(100 + k, f"vile grubby words of text {k % 5} here", 1) for k in range(60)]
    model = toxicity.fit(spark.createDataFrame([(k, f"{t} {k}x", y) for k, t, y in rows], "doc_id long, text string, label int"))
    docs = spark.createDataFrame([(1, long_text()), (2, "vile grubby vile"), (3, "vile grubby vile"), (4, long_text() + " vile grubby vile grubby vile grubby")], "doc_id long, text string")
    got = {r.doc_id: r.toxicity for r in toxicity.assess(docs, model, ["doc_id"]).collect()}
    assert got[2] == got[3] > got[1] and got[4] >= got[1]
