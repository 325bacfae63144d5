"""The n-gram join against all pairs."""

import random
import re

import numpy as np
import pytest

from tests.llm import cases
from voxweave.llm import near
from voxweave.llm.tables import table

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORDS.findall(lowered)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows, percent=75):
    sets = [(doc, shingles(text)) for doc, text in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    x, y = find(i), find(j)
                    root[max(x, y)] = min(x, y)
    least = {}
    for i, (doc, _) in enumerate(sets):
        r = find(i)
        least[r] = min(least.get(r, doc), doc)
    return sorted((doc, len(s), least[find(i)]) for i, (doc, s) in enumerate(sets))


def got(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def copies(seed, docs=160, words=60):
    """Groups of near copies at all distances, passages that unrelated documents share, exact copies."""
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(4000)]
    fresh = lambda n: [rng.choice(vocab) for _ in range(n)]
    passage = fresh(45)
    bases = [fresh(words) for _ in range(4)]
    out = []
    for _ in range(docs):
        kind = rng.random()
        if kind < 0.6:
            w = list(rng.choice(bases))
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            if rng.random() < 0.3:
                w = w[: rng.randint(40, len(w))]
        elif kind < 0.85:
            w = passage + fresh(rng.randint(0, 25))
        else:
            w = fresh(rng.randint(1, 9))
        out.append(" ".join(w))
    return [(k * 3, t) for k, t in enumerate(out)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    rows = copies(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(near.op2_ngram_join(df)) == brute(rows)


def test_cases_and_repeated_rows(spark):
    docs = cases.frame(spark, extra=True)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(near.op2_ngram_join(docs)) == brute(rows)
    assert got(near.op2_ngram_join(docs.union(docs))) == brute(rows + rows)
    assert near.op2_ngram_join(cases.empty(spark)).count() == 0


def test_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    assert got(near.op2_ngram_join(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("entries", [400, 250_000])
def test_sets_that_share_rare_shingles_and_do_not_link(spark, monkeypatch, entries):
    """Lists on which many components meet, in one block and in several; a line that all documents share; a link that only one pair makes."""
    monkeypatch.setattr(near, "BLOCK_ENTRIES", entries)
    rng = random.Random(4)
    fresh = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    parts = [fresh(14) for _ in range(9)]
    line = fresh(8)
    # of nine shared passages each takes seven, so that nearly all shingles are shared and few pairs are alike
    rows = []
    for k in range(130):
        chosen = rng.sample(parts, 7)
        rows.append((k, " ".join(w for p in chosen for w in p) + "\n" + " ".join(line)))
    rows += [(1000 + k, " ".join(line)) for k in range(5)] + [(2000, rows[3][1] + " end"), (-(2**63), rows[5][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(near.op2_ngram_join(df)) == brute(rows)


def test_missing_ids_stay_missing(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (-(2**63), "x y z u v w"), (0, "q")], "doc_id long, text string")
    assert {r.doc_id for r in near.op2_ngram_join(df).collect()} == {None, -(2**63), 0}


def test_rows_are_met_once_each_whatever_their_ids(spark):
    """Thousands of rows without a doc_id, and of one doc_id: no join by doc_id makes more rows than there are."""
    rng = random.Random(7)
    texts = [" ".join(f"w{rng.randrange(3)}-{k // 2}-{j}" if j % 40 == 7 else f"w{k // 2}-{j}" for j in range(60)) for k in range(5000)]
    rows = [(None if k < 2500 else 77, t) for k, t in enumerate(texts)] + [(None, texts[0])] * 300 + [(77, texts[4000])] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    counts = near.shared_counts(df).cache()
    met, sets = near.set_texts(df, counts)
    assert met.count() == sets == counts.select("node").distinct().count()
    counts.unpersist()
    found = near.op2_ngram_join(df).collect()
    assert len(found) == len(rows)
    plain = [(k, t) for k, (_, t) in enumerate(rows)]
    groups = {}
    for k, (_, n, c) in enumerate(sorted(got(near.op2_ngram_join(spark.createDataFrame(plain, "doc_id long, text string").repartition(4))))):
        groups.setdefault(c, []).append(k)
    ids = {c: min((rows[k][0] for k in members if rows[k][0] is not None), default=None) for c, members in groups.items()}
    want = sorted((rows[k][0] or 0, ids[c] or 0) for c, members in groups.items() for k in members)
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in found) == want


@pytest.mark.parametrize("hot", [10, 4096])
def test_hot_lists_are_dealt_out(spark, monkeypatch, hot):
    monkeypatch.setattr(near, "HOT_ROWS", hot)
    rows = copies(11)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(near.op2_ngram_join(df)) == brute(rows)


def test_t_occurrence_against_counts():
    rng = np.random.default_rng(2)
    for _ in range(100):
        query = np.unique(rng.integers(0, 60, rng.integers(1, 50))).astype("u8")
        sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))).astype("u8") for _ in range(12)]
        required = rng.integers(1, 20, len(sets))
        wanted = rng.random(len(sets)) < 0.8
        want = [len(np.intersect1d(query, s)) for s in sets]
        found = near.t_occurrence(query, near.Index(sets), required, wanted)
        assert sorted(found.tolist()) == [k for k, (w, r) in enumerate(zip(want, required)) if wanted[k] and w >= r]
