"""The chain model against sums over all labellings, and by held-out accuracy."""

import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from tests.llm import cases
from voxweave.llm import quality
from voxweave.llm.tables import table

SF = "/root/testdata/sf0.1"


def test_forward_backward_against_all_labellings():
    rng = np.random.default_rng(0)
    counts = np.array([1, 4, 2, 6])
    bad, pairs = rng.normal(size=counts.sum()), rng.normal(size=(2, 2))
    chains = quality.Chains(counts)
    marginal, z, expected = chains.forward_backward(bad, pairs)
    at = 0
    for k, n in enumerate(counts.tolist()):
        total, share, seen = 0.0, np.zeros(n), np.zeros((2, 2))
        for labels in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(bad[at + i] for i in range(n) if labels[i]) + sum(pairs[a, b] for a, b in zip(labels, labels[1:])))
            total += w
            share += w * np.array(labels)
            for a, b in zip(labels, labels[1:]):
                seen[a, b] += w
        row = int(np.flatnonzero(chains.order == k)[0])
        assert np.allclose(marginal[at : at + n], share / total)
        assert np.isclose(z[row], np.log(total)) and np.allclose(expected[row], seen / total)
        at += n


def test_lines_and_shares():
    texts = ["Aa bb bb\nXX!! YY!!", "", "a | b | c\n\n9"]
    data = np.frombuffer("".join(texts).encode(), "u1")
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    features, lengths, counts = quality.line_features(data, offsets)
    assert counts.tolist() == [2, 1, 3] and lengths.sum() == len(data)
    upper, bangs, repeats = features[:, 1], features[:, 4], features[:, 6]
    assert np.isclose(upper[1], 1) and np.isclose(bangs[1], 1) and np.isclose(repeats[0], 1 / 3) and repeats[1:].sum() == 0


def plain_features(text):
    """The features of each line, by loops over its characters and words; ASCII texts only."""
    space, plain = " \t\n\x0b\f\r", ".,;:'\"-()?"
    parts = text.split("\n")
    lines = [part + "\n" * (k + 1 < len(parts)) for k, part in enumerate(parts)]
    shares, own = [], []
    for k, line in enumerate(lines):
        words = line.split()
        marks = [c for c in line if 33 <= ord(c) < 127 and not c.isalnum() and c not in plain and c not in "|!"]
        solid, some = max(1, sum(c not in space for c in line)), max(1, len(words))
        upper, lower = sum(c.isupper() for c in line), sum(c.islower() for c in line)
        lowered = [w.lower() for w in words]
        ended = sum(w[-1] in marks for w in words)
        shares.append([upper / max(1, upper + lower), len(marks) / solid, min(1, line.count("|") / some), min(1, line.count("!") / some), sum(c.isdigit() for c in line) / solid, sum(a == b for a, b in zip(lowered, lowered[1:])) / some, min(1, ended / some), min(2, solid / some / 10)])
        own.append([math.log1p(len(line)) / 8, math.log1p(len(words)) / 6, float(k == 0), float(k + 1 == len(lines))])
    zero = [0.0] * quality.SHARES
    return np.array([[1.0, *shares[k], *own[k], *(shares[k - 1] if k else zero), *(shares[k + 1] if k + 1 < len(lines) else zero)] for k in range(len(lines))]), np.array([len(x) for x in lines])


def test_score_against_a_plain_version(spark):
    """Features, marginals, length-weighted share and score of whole texts, by loops."""
    texts = ["Aa bb bb\nXX!! YY!! $$\n\nplain words, here 12", "", None, "| a | b |\nZ z Z", "one line of text.", "\n\n", "BUY NOW!!! ### $$$ 99% off\n" * 6]
    rng = np.random.default_rng(3)
    model = quality.QualityModel(rng.normal(size=quality.FEATURES), rng.normal(size=(2, 2)), -1.3, 0.4)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.assess(docs, model, ["doc_id"]).collect():
        features, lengths = plain_features(texts[r.doc_id] or "")
        bad = features @ model.weights
        total, share = 0.0, np.zeros(len(bad))
        for labels in itertools.product((0, 1), repeat=len(bad)):
            w = np.exp(sum(b for b, y in zip(bad, labels) if y) + sum(model.pairs[a, b] for a, b in zip(labels, labels[1:])))
            total += w
            share += w * np.array(labels)
        share = float((share / total * (lengths + 1)).sum() / (lengths + 1).sum())
        assert abs(r.bad_share - share) < 1e-5
        assert abs(r.quality - 1 / (1 + math.exp(-(model.slope * math.log(share + 1e-4) + model.bias)))) < 1e-4


def test_gradient_is_that_of_the_likelihood():
    """After enough steps no small change of the weights makes the documents' labels likelier, but for the shrinkage."""
    rng = np.random.default_rng(7)
    counts = np.array([1, 3, 2, 4, 2, 3, 1, 2])
    features = np.hstack([np.ones((counts.sum(), 1)), rng.normal(size=(counts.sum(), quality.FEATURES - 1))])
    good = np.array([True, False, True, False, True, False, False, True])
    model = quality.fit_chain(features, counts, good, 800)

    def value(weights, pairs):
        at, out = 0, 0.0
        for n, is_good in zip(counts.tolist(), good.tolist()):
            bad, total = features[at : at + n] @ weights, 0.0
            for labels in itertools.product((0, 1), repeat=n):
                total += np.exp(sum(b for b, y in zip(bad, labels) if y) + sum(pairs[a, b] for a, b in zip(labels, labels[1:])))
            p = np.exp(pairs[0, 0] * (n - 1)) / total
            out += np.log(p) if is_good else np.log(1 - p)
            at += n
        return out / len(counts) - 0.5e-3 * ((weights**2).sum() + (pairs**2).sum())

    best = value(model.weights, model.pairs)
    for k in range(quality.FEATURES):
        for step in (0.3, -0.3):
            moved = model.weights.copy()
            moved[k] += step
            assert value(moved, model.pairs) < best + 1e-4


def test_long_texts_are_scored_and_not_learned_from(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_LINES", 60)
    monkeypatch.setattr(quality, "LONGEST_LINES", 20)
    rows = [(k, "A good line of words.\n" * 3 if k % 2 else "BUY!! BUY!! $$$\n" * 3, k % 2) for k in range(40)] + [(100, "x\n" * 50_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = quality.fit(docs)
    got = {r.doc_id: r for r in quality.assess(docs, model, ["doc_id"]).collect()}
    assert got[100].lines == 50_001 and got[1].quality > 0.5 > got[0].quality


def test_alike_rows_at_the_bound_of_lines(spark, monkeypatch):
    """More lines of rows that are alike in id and text than the sample may hold: as many rows count as there is room for."""
    monkeypatch.setattr(quality, "SAMPLE_LINES", 60)
    schema, text = "doc_id long, text string, label int", "A plain sentence, as one would write it.\nAnd a second line of it."
    bad = spark.createDataFrame([(k, f"$$$ !!! BUY {k}\n>>> xx {k * 7} %%", 0) for k in range(20)], schema)
    # the good rows are drawn last
    good = spark.createDataFrame([(1000 + k, text, 1) for k in range(200)], schema).orderBy(F.desc(F.xxhash64("doc_id", "text"))).limit(1)
    copies = good.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(40)))).drop("k")
    model = quality.fit(bad.union(copies))
    assert model.weights.any()
    found = {r.doc_id >= 1000: r.quality for r in quality.assess(bad.union(good), model, ["doc_id"]).collect()}
    assert found[True] > 0.5 > found[False]


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    out = quality.op7_quality(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    good = [r for r in out if r.quality == 1]
    bad = [r for r in out if r.quality == 0]
    assert sum(r.predicted == 1 for r in good) / len(good) > 0.98
    assert sum(r.predicted == 0 for r in bad) / len(bad) > 0.95


def test_cases(spark):
    docs = cases.frame(spark, extra=True)
    labels = spark.createDataFrame([(0, 1, 0), (4, 0, 0), (6, None, 0), (7, 0, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.op7_quality(docs, labels).collect()
    assert sorted(r.doc_id for r in rows) == sorted(cases.TEXTS) and all(0 <= r.score <= 1 for r in rows)
    assert quality.op7_quality(docs.union(docs), labels).count() == 2 * len(cases.TEXTS)
    assert quality.op7_quality(cases.empty(spark), labels).count() == 0
    none = quality.op7_quality(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
