"""Maximal segments against their recursive definition, and held-out precision and recall."""

import math
import random
import re
import time

import numpy as np

from tests.llm import cases
from voxweave.llm import toxicity
from voxweave.llm.tables import table

SF = "/root/testdata/sf0.1"


def recursive(values, begin=0):
    """The contiguous part with the largest positive sum (the shortest of them), then the same on both sides."""
    best = None
    for i in range(len(values)):
        total = 0
        for j in range(i, len(values)):
            total += values[j]
            if total > 0 and (best is None or (total, -(j - i)) > (best[0], -(best[2] - best[1]))):
                best = (total, i, j)
    if best is None:
        return []
    total, i, j = best
    return recursive(values[:i], begin) + [(begin + i, begin + j, total)] + recursive(values[j + 1 :], begin + j + 1)


def test_maximal_segments():
    rng = random.Random(4)
    for _ in range(200):
        dense = [rng.choice([0.53, 1.91, 2.77, 4.13]) + rng.random() / 100 if rng.random() < 0.4 else rng.choice([-1.0, -0.7, -3.0]) for _ in range(30)]
        want = [(a, b, round(s, 6)) for a, b, s in recursive(dense)]
        assert [(a, b, round(s, 6)) for a, b, s in toxicity.maximal_segments(np.array(dense))] == want


def test_a_million_words_in_seconds():
    model = toxicity.ToxicityModel({"bad": 1.0, "nice": -2.0}, 1.5, 0.1, 3.0, -4.0)
    rng = random.Random(1)
    text = " ".join(rng.choice(["bad", "nice", "so"]) for _ in range(1_000_000))
    began = time.process_time()
    assert model.segments(text)[1] == 1_000_000
    assert time.process_time() - began < 20


def test_karlin_root():
    values, odds = np.array([3.0, -0.5]), np.array([0.05, 0.95])
    root = toxicity.karlin(values, odds)
    assert root > 0 and abs(float(odds @ np.exp(root * values)) - 1) < 1e-6


def test_held_out(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    out = toxicity.op4_toxicity(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    hit = sum(r.toxic == 1 and r.predicted == 1 for r in out)
    assert hit / sum(r.toxic for r in out) > 0.85
    assert hit / sum(r.predicted for r in out) > 0.93


def test_score_against_a_plain_version(spark):
    """Lexicon, segments, evidence and score of a small table, by loops over all words and all stretches."""
    rng = random.Random(9)
    plain = [f"w{chr(97 + k)}{chr(97 + j)}" for k in range(6) for j in range(6)]
    nasty, nice = ["vile", "viles", "grubby", "rotten"], ["gentle", "gently"]
    rows = []
    for k in range(240):
        words = [rng.choice(plain) for _ in range(rng.randint(3, 25))]
        if k % 3 == 0:
            words[2:2] = [rng.choice(nasty) for _ in range(3)]
        elif rng.random() < 0.7:
            words.append(rng.choice(nice))
        rows.append((k, " ".join(words) + rng.choice(["", ".", " 12 _x"]), int(k % 3 == 0)))
    rows += [(1000 + k, t, y) for k, t, y in rows[:30]] + [(2000, None, 0), (2001, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = toxicity.fit(docs)

    texts = {t: y for _, t, y in rows if t is not None}
    n = {y: sum(v == y for v in texts.values()) for y in (0, 1)}
    counts = {0: {}, 1: {}}
    for t, y in texts.items():
        words = set(re.findall("[a-z]+", t.lower()))
        for w in words | {w[:k] + "-" for w in words for k in (4, 5, 6, 7) if len(w) > k}:
            counts[y][w] = counts[y].get(w, 0) + 1
    lexicon = {}
    for w in counts[0].keys() | counts[1].keys():
        y1, y0 = counts[1].get(w, 0), counts[0].get(w, 0)
        a = 50 * (y1 + y0) / (n[0] + n[1])
        delta = math.log((y1 + a) / (n[1] + 50 - y1 - a)) - math.log((y0 + a) / (n[0] + 50 - y0 - a))
        z = delta / math.sqrt(1 / (y1 + a) + 1 / (y0 + a))
        if z >= 3 and y1 >= 3 or z <= -3 and y0 >= 3:
            lexicon[w] = delta if z > 0 else min(delta, -0.25)
    assert lexicon.keys() == model.lexicon.keys() and {"vile", "gent-"} <= lexicon.keys()
    assert all(abs(lexicon[w] - model.lexicon[w]) < 1e-6 for w in lexicon)

    def score(text):
        words = re.findall("[a-z]+", (text or "").lower())
        values = [next((lexicon[x] for x in [w, *(w[:k] + "-" for k in (7, 6, 5, 4) if len(w) > k)] if x in lexicon), -0.25) for w in words]
        found = [model.rate * s - math.log(max(1, model.scale * len(words))) for _, _, s in recursive(values)]
        evidence = math.log1p(sum(x for x in found if x > 0))
        return 1 / (1 + math.exp(-(model.slope * evidence + model.bias)))

    out = toxicity.assess(docs, model, ["doc_id"]).collect()
    want = {k: score(t) for k, t, _ in rows}
    assert len(out) == len(rows) and all(abs(r.toxicity - want[r.doc_id]) < 1e-6 for r in out)
    assert sum((r.toxicity >= 0.5) == y for r, (_, _, y) in zip(sorted(out, key=lambda r: r.doc_id), sorted(rows), strict=True)) > 0.95 * len(rows)


def test_passages_are_places_in_the_text():
    model = toxicity.ToxicityModel({"bad": 6.0, "wors-": 3.0}, 1.5, 0.1, 3.0, -4.0)
    text = "Fine words here. BAD worst\nbad end of it"
    (a, b, evidence), = model.passages(text)
    assert text[a:b] == "BAD worst\nbad" and evidence > 0
    text = "İİİİ and bad"
    (a, b, _), = model.passages(text)
    assert text[a:b] == "bad"
    assert model.passages(None) == model.passages("") == []


def test_cases(spark):
    docs = cases.frame(spark, extra=True)
    labels = spark.createDataFrame([(0, 1, 0), (4, 0, 0), (6, None, None), (7, 0, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = toxicity.op4_toxicity(docs, labels).collect()
    assert sorted(r.doc_id for r in rows) == sorted(cases.TEXTS) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.op4_toxicity(docs.union(docs), labels).count() == 2 * len(cases.TEXTS)
    assert toxicity.op4_toxicity(cases.empty(spark), labels).count() == 0
