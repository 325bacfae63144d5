"""Language identification against a plain Viterbi, and by held-out accuracy."""

import math
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm import cases
from voxweave.llm import language
from voxweave.llm.tables import table

SF = "/root/testdata/sf0.01"


def plain_viterbi(scores):
    best, back = scores[0].astype("f8"), []
    for row in scores[1:]:
        now, come = [], []
        for k in range(len(row)):
            options = [best[j] - (0 if j == k else language.SWITCH) for j in range(len(row))]
            now.append(max(options) + row[k])
            come.append(int(np.argmax(options)))
        back.append(come)
        best = np.array(now)
    path = [int(np.argmax(best))]
    for come in reversed(back):
        path.append(come[path[-1]])
    return path[::-1], max(best)


def value(scores, path):
    return sum(scores[t][k] for t, k in enumerate(path)) - language.SWITCH * sum(a != b for a, b in zip(path, path[1:]))


@pytest.mark.parametrize("together", [1, 5, 32])
def test_viterbi_of_many_texts_at_once(monkeypatch, together):
    monkeypatch.setattr(language, "TOGETHER", together)
    rng = np.random.default_rng(1)
    model = language.LanguageModel(["a", "b", "c"], rng.random((language.BUCKETS, 3)), np.ones((len(language.SCRIPTS) + 1, 3)))
    counts = rng.integers(0, 30, 40)
    scores = (rng.random((counts.sum(), 3)) * 12).astype("f4")
    got, at = model.labels(scores, counts), 0
    for n in counts.tolist():
        if n:
            mine = scores[at : at + n].astype("f8")
            path, best = plain_viterbi(mine)
            assert abs(value(mine, got[at : at + n].tolist()) - best) < 1e-3
        at += n


def test_words_are_cut_at_texts():
    texts = ["ab c", "", "déf İx", "-", "ß"]
    _, first, counts, script, letters = language._words(texts)
    assert counts.tolist() == [2, 0, 2, 0, 1] and len(first) == 5 and set(script.tolist()) == {1}
    assert letters.tolist() == [2, 1, 3, 2, 1]


def test_held_out_accuracy(spark):
    docs = table(spark, SF, "documents")
    rows = language.op10_language(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 200
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98


def test_mixed_text_has_spans_and_scripts_narrow(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang")
    greek = spark.createDataFrame([(10**6 + k, "αυτό είναι ένα κείμενο στα ελληνικά", "el") for k in range(4)], "doc_id long, text string, lang string")
    model = language.fit(docs.union(greek))
    by = {r.lang: r.text for r in docs.filter("length(text) > 900").collect()}
    spans = model.spans(by["fr"][:300] + " " + by["de"][:300] + " ελληνικά κείμενο")
    assert [s[0] for s in spans][:2] == ["fr", "de"] and spans[-1][0] == "el"


def test_prediction_against_a_plain_version(spark):
    """Counts, log likelihoods, scripts, spans and shares by loops over characters and words."""
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", "lang")
    rows = [(r.doc_id, r.text or "", r.lang) for r in docs.collect()]
    learned = [r for r in rows if r[2] is not None and zlib.crc32(str(r[0]).encode()) % 4 != 2]

    def words(text):
        text = f" {text} ".lower()
        kind = [{"L": 2, "M": 1}.get(unicodedata.category(c)[0], 0) for c in text]
        code = [ord(c) if k else 0 for c, k in zip(text, kind)]
        out, at = [], 0
        while at < len(text):
            if not kind[at]:
                at += 1
                continue
            begin = at
            while kind[at]:
                at += 1
            hashes = []
            for k in range(begin, at):
                h = code[k] * 0x9E3779B1 % 2**32 ^ code[k - 1] * 0x85EBCA6B % 2**32 ^ code[k + 1] * 0xC2B2AE35 % 2**32
                h = (h ^ h >> 15) * 0x2C1B3C6D % 2**32
                hashes.append(h >> 13 & language.BUCKETS - 1)
            script = next((n for n, spans in enumerate(language.SCRIPTS.values(), 1) for a, b in spans if a <= code[begin] <= b), 0)
            out.append((hashes, script, sum(k == 2 for k in kind[begin:at])))
        return out

    languages = sorted({r[2] for r in learned})
    counts = {x: Counter() for x in languages}
    scripts = {x: Counter() for x in languages}
    for _, text, lang in learned:
        for hashes, script, letters in words(text):
            counts[lang].update(hashes)
            scripts[lang][script] += letters
    used = len(set().union(*counts.values()))
    weight = lambda x, h: math.log((counts[x][h] + 0.1) / (sum(counts[x].values()) + 0.1 * used))
    admits = lambda x, script: scripts[x][script] / max(1, sum(scripts[x].values())) >= language.SCRIPT_SHARE or all(scripts[y][script] / max(1, sum(scripts[y].values())) < language.SCRIPT_SHARE for y in languages)

    got = {r.doc_id: r for r in language.op10_language(docs).collect()}
    assert len(got) == len(rows)
    for doc, text, _ in rows[::5]:
        found = words(text)
        if not sum(x[2] for x in found):
            assert (got[doc].lang_pred, got[doc].score) == ("und", 0.0)
            continue
        scores = np.array([[sum(weight(x, h) for h in hashes) + (0 if admits(x, script) else -1e4) for x in languages] for hashes, script, _ in found])
        path, _ = plain_viterbi(scores)
        share = Counter()
        for k, (_, _, letters) in zip(path, found):
            share[languages[k]] += letters
        best = max(sorted(share), key=share.get)
        assert got[doc].lang_pred == best and abs(got[doc].score - share[best] / sum(share.values())) < 1e-3


def test_texts_without_a_letter_and_with_one(spark):
    docs = spark.createDataFrame([(k, "some words of a text", "en") for k in range(12)] + [(100, "\u0301", None), (101, "\u4dc0", None), (102, "\ud7b0", None), (103, "12 ½ ² !", None), (104, "7 é", None), (105, "\u0301 a", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language.op10_language(docs).collect()}
    assert [got[k] for k in range(100, 106)] == ["und", "und", "en", "und", "en", "en"]


def test_three_hundred_languages():
    names = [f"l{k:03d}" for k in range(300)]
    own = {name: chr(0x4E00 + 3 * k) * 3 for k, name in enumerate(names)}
    h = {name: language._words([text])[0] for name, text in own.items()}
    counts = np.zeros((language.BUCKETS, 300))
    for k, name in enumerate(names):
        counts[h[name], k] += 50
    model = language.LanguageModel(names, counts, np.ones((len(language.SCRIPTS) + 1, 300)))
    assert [p[0] for p in model.predict([own[x] for x in ("l000", "l255", "l256", "l299")])] == ["l000", "l255", "l256", "l299"]


def test_samples_keep_their_bound(spark):
    rows = spark.range(5000).selectExpr("id % 1700 as doc_id", "id")
    assert 0 < language.sampled(rows, 1000).count() <= 1000 and language.sampled(rows, 5000).count() == 5000
    assert language.sampled(rows, 1000).exceptAll(language.sampled(rows, 1000)).isEmpty()


def test_samples_of_rows_with_one_id_or_none(spark):
    """Ties of the drawing hash: exactly as many rows as the bound, and a model that knows the language."""
    texts = [f"the old house near the river number {k} is open again" for k in range(70)]
    for key in ("cast(null as long)", "5L"):
        rows = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string").selectExpr(f"{key} as doc_id", "text", "lang")
        assert language.sampled(rows, 20).count() == 20 and language.sampled(rows, 20).distinct().count() == 20
        alike = rows.union(rows.limit(1).selectExpr("*", "explode(sequence(1, 400)) as k").drop("k"))
        assert language.sampled(alike, 20).count() == 20 and language.sampled(alike, 300).count() == 300
        assert language.sampled(rows.limit(1).crossJoin(spark.range(50)).drop("id"), 20).count() == 20
        model = language.fit(rows, 20)
        assert {r.lang_pred for r in language.identify(rows, model, ["doc_id"]).collect()} == {"en"}


def test_more_rows_of_one_id_than_the_sample_holds(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_ROWS", 30)
    monkeypatch.setattr(language.fit, "__defaults__", (30,))
    rows = [(None if k % 2 else 8, ("the house is old" if k % 3 else "das haus ist alt und schön") + f" {k}", "en" if k % 3 else "de", None, 1) for k in range(300)]
    found = language.op10_language(spark.createDataFrame(rows, cases.SCHEMA)).collect()
    assert len(found) == 300 and {r.lang_pred for r in found} == {"en", "de"}


def test_long_text_and_ties():
    rng = np.random.default_rng(1)
    model = language.LanguageModel(["a", "b"], np.ones((language.BUCKETS, 2)), np.ones((len(language.SCRIPTS) + 1, 2)))
    assert model.predict(["same odds"])[0][0] == "a"
    long = " ".join("".join(chr(97 + x) for x in rng.integers(0, 26, 5)) for _ in range(200_000))
    assert model.predict([long, "", "b"])[0] == ("a", 1.0, 1)


def test_cases(spark):
    docs = cases.frame(spark, extra=True)
    out = {r.doc_id: r for r in language.op10_language(docs).collect()}
    assert set(out) == set(cases.TEXTS)
    for doc in (1, 2, 3):
        assert (out[doc].lang_pred, out[doc].score) == ("und", 0.0)
    assert out[0].lang_pred == "en"
    assert language.op10_language(cases.empty(spark)).count() == 0
    twice = language.op10_language(docs.union(docs))
    assert twice.count() == 2 * len(cases.TEXTS)
    nothing = language.op10_language(docs.filter("lang is null"))
    assert [r.lang_pred for r in nothing.collect()] == ["und"]
