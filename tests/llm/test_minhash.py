"""MinHash deduplication against all pairs, and its sketches."""

import numpy as np
import pytest

from tests.llm import cases, test_near
from voxweave.llm import minhash, near
from voxweave.llm.shingles import mixed
from voxweave.llm.tables import table


def brute(rows, percent=85):
    out = test_near.brute(rows, percent)
    return sorted((doc, n, c, doc == c) for doc, n, c in out)


def got(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect())


@pytest.mark.parametrize("seed", [3, 4])
def test_against_all_pairs(spark, seed):
    rows = test_near.copies(seed, words=90)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(minhash.op12_minhash_dedup(df)) == brute(rows)


def test_cases_and_repeated_rows(spark):
    docs = cases.frame(spark, extra=True)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(minhash.op12_minhash_dedup(docs.union(docs))) == brute(rows + rows)
    assert minhash.op12_minhash_dedup(cases.empty(spark)).count() == 0


def test_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    assert got(minhash.op12_minhash_dedup(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_rows_without_id(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (5, "x y z u v w"), (None, "x y z u v w"), (None, "")]
    found = minhash.op12_minhash_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(repr, found)) == sorted(repr(type(found[0])(doc_id=a, n_shingles=n, component_id=c, kept=k)) for a, n, c, k in [(None, 2, None, True), (None, 2, None, True), (5, 2, 5, True), (None, 2, 5, False), (None, 0, None, True)])


def test_buckets_of_centres_that_link_with_nothing(spark, monkeypatch):
    """Sets that share buckets with centres unlike them and with each other: the rest is searched in blocks; hot buckets are dealt out."""
    monkeypatch.setattr(near, "HOT_ROWS", 20)
    monkeypatch.setattr(near, "BLOCK_ENTRIES", 2000)
    rows = test_near.copies(9, docs=300, words=70)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(minhash.op12_minhash_dedup(df)) == brute(rows)


def test_sketches_agree_as_often_as_sets():
    rng = np.random.default_rng(1)
    for size in (1, 2, 7, 40, 240, 5000):
        agree, want = [], []
        for _ in range(150):
            every = np.unique(mixed(rng.integers(0, 2**62, size + size // 5, dtype="u8")))
            a, b = every[np.sort(rng.permutation(len(every))[:size])], every[np.sort(rng.permutation(len(every))[:size])]
            want.append(len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
            agree.append((minhash.sketch(a) == minhash.sketch(b)).mean())
        assert abs(np.mean(agree) - np.mean(want)) < 0.03
    one = mixed(np.array([5], "u8"))
    assert (minhash.sketch(one) == one[0]).all()
