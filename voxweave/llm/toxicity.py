"""Toxic passages by maximum-scoring segments.

A word's score is its log-odds between toxic and clean documents under an informative Dirichlet prior (a
share of the word's frequency over both), kept where it is significant, for toxic and for clean words alike. A
word without a significant score of its own takes that of its longest prefix that has one, counted likewise;
every other word costs DRIFT, and no clean word costs less. The maximal scoring segments of a text are found
in one pass over its words. A segment's score S is set against what chance gives: in clean text a segment of
at least S is expected K * n * exp(-lambda * S) times among n words (Karlin and Altschul), with lambda from the
scores' distribution in clean text. The evidence of a text sums lambda * S - ln(K * n) over its significant
segments, and a logistic function of it, fitted on the labelled sample, is its score.

Words are runs of letters, in lower case, cut by the same function when they are counted and when they are scored. They
are counted by documents with different texts, so that copies of one text count once, on a sample that
``SAMPLE_ROWS`` bounds; only significant words reach the driver, as many as that sample has.
Null and empty texts have no segment. Without rows of both labels every score is 0. A text's words are scored
together, so a very long text takes memory in proportion to its words.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxweave.llm.arrow import keep as keep_cache
from voxweave.llm.arrow import mapped
from voxweave.llm.language import held_out, sampled
from voxweave.llm.quality import fit_logistic, labelled_texts
from voxweave.llm.tables import discard, saved

SAMPLE_ROWS = 20_000
PRIOR = 50.0
#: Least z-score of a word's log-odds either way, documents that must have it, and the cost of any other word.
SIGNIFICANCE, SUPPORT, DRIFT = 3.0, 3, 0.25
#: Lengths of prefixes that are counted beside words; their entries in a lexicon end in a hyphen.
PREFIXES = (4, 5, 6, 7)
#: Words whose scores a Python worker keeps, in each of two generations, and words that it counts at once.
KNOWN_WORDS, COUNTED_WORDS = 300_000, 1_000_000
WORD = re.compile(r"[^\W\d_]+")


def lowered(text: str | None) -> str:
    """The text in lower case, character by character."""
    return (text or "").replace("İ", "i").lower()


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of a row of scores, as (first, last place, score), in linear time.

    Candidates keep the sum before them and up to their end; a new one is joined to the last earlier one with a
    smaller sum before it unless that one's sum at its end reaches the new one's. Each candidate keeps the number
    of that earlier one, so that no candidate is looked at twice on the way back.
    """
    sums = np.cumsum(scores)
    held: list[tuple[int, int, float, float, int]] = []
    places = np.flatnonzero(scores > 0)
    for place, begin, end in zip(places.tolist(), (sums[places] - scores[places]).tolist(), sums[places].tolist(), strict=True):
        new = (place, place, begin, end)
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= new[2]:
                j = held[j][4]
            if j < 0 or held[j][3] >= new[3]:
                held.append((*new, j))
                break
            new = (held[j][0], new[1], held[j][2], new[3])
            del held[j:]
    return [(a, b, r - left) for a, b, left, r, _ in held]


class _Scores(dict):
    """Scores of words that this worker has met; those of the generation before are taken over when asked for."""

    def __init__(self, model: ToxicityModel, old: dict):
        self.word, self.old = model.word, old

    def __missing__(self, word: str) -> float:
        score = self.old.get(word)
        if score is None:
            score = self.word(word)
        self[word] = score
        return score


#: The worker's scores, by the model that they are of.
_scores: dict[str, _Scores] = {}


def _scores_of(model: ToxicityModel) -> _Scores:
    known = _scores.get(model.name)
    if known is None:
        if not _scores:
            keep_cache("toxicity", _scores.clear)
        _scores.clear()
        known = _scores[model.name] = _Scores(model, {})
    elif len(known) > KNOWN_WORDS:
        known.old = {}
        known = _scores[model.name] = _Scores(model, known)
    return known


class ToxicityModel:
    def __init__(self, lexicon: dict[str, float], rate: float, scale: float, slope: float = 0.0, bias: float = -30.0):
        self.lexicon, self.rate, self.scale, self.slope, self.bias = lexicon, rate, scale, slope, bias
        self.prefixes = {w[:-1]: score for w, score in lexicon.items() if w[-1:] == "-"}
        self.name = uuid.uuid4().hex

    def word(self, word: str) -> float:
        """The score of a word."""
        found = self.lexicon.get(word)
        if found is None:
            for k in reversed(PREFIXES):
                if len(word) > k and (found := self.prefixes.get(word[:k])) is not None:
                    break
        return -DRIFT if found is None else found

    def segments(self, text: str | None) -> tuple[list[tuple[int, int, float]], int]:
        """Significant segments as (first word, last word, evidence), and the number of words."""
        words = WORD.findall(lowered(text))
        scores = np.fromiter(map(_scores_of(self).__getitem__, words), "f8", len(words))
        if not len(words) or scores.max() <= 0:
            return [], len(words)
        chance = math.log(max(1.0, self.scale * len(words)))
        found = [(a, b, self.rate * s - chance) for a, b, s in maximal_segments(scores)]
        return [x for x in found if x[2] > 0], len(words)

    def evidence(self, text: str | None) -> float:
        return math.log1p(sum(x[2] for x in self.segments(text)[0]))

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * evidence + self.bias))))

    def passages(self, text: str | None) -> list[tuple[int, int, float]]:
        """Significant segments as (first character, end, evidence) in the text itself."""
        found, _ = self.segments(text)
        if not found:
            return []
        spans = [m.span() for m in WORD.finditer(lowered(text))]
        return [(spans[a][0], spans[b][1], e) for a, b, e in found]


def karlin(values: np.ndarray, odds: np.ndarray) -> float:
    """The positive root of sum(odds * exp(root * values)) = 1, for a negative mean."""
    high = 1e-3
    while float(odds @ np.exp(high * values)) < 1 and high < 50:
        high *= 2
    low = 0.0
    for _ in range(80):
        mid = (low + high) / 2
        if float(odds @ np.exp(mid * values)) < 1:
            low = mid
        else:
            high = mid
    return max(high, 1e-3)


def _counted(rows: DataFrame) -> DataFrame:
    """word, toxic, clean: in how many texts of each label a word, or a prefix with a hyphen, occurs; and, with word null, the words of all."""

    def counts(batches):
        import pyarrow as pa

        by: dict[int, Counter] = {0: Counter(), 1: Counter()}

        def flush():
            words = list(by[0].keys() | by[1].keys())
            cols = [pa.array(words, pa.string()), *(pa.array([by[label][w] for w in words], pa.int64()) for label in (1, 0))]
            by[0].clear(), by[1].clear()
            return pa.RecordBatch.from_arrays(cols, names=["word", "toxic", "clean"])

        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = WORD.findall(lowered(text.as_py()))
                each = set(words)
                by[label].update(each)
                by[label].update({f"{w[:k]}-" for k in PREFIXES for w in each if len(w) > k})
                by[label][None] += len(words)
                if len(by[0]) + len(by[1]) > COUNTED_WORDS:
                    yield flush()
        yield flush()

    each = mapped(rows.select("label", "text"), counts, "word string, toxic long, clean long")
    return each.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """labelled: doc_id, text and label (1 toxic)."""
    rows = sampled(labelled.filter("label is not null and text is not null"), sample_rows).select(F.col("label").cast("int").alias("label"), "text", F.xxhash64("text").alias("same"))
    rows = saved(rows.groupBy("same").agg(F.max("label").alias("label"), F.first("text").alias("text")).select("label", "text"))
    totals = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    if set(totals) != {0, 1}:
        return ToxicityModel({}, 1.0, 1.0)
    n1, n0 = totals[1], totals[0]
    counted = saved(_counted(rows))
    clean_words = max(1, counted.filter("word is null").first().clean)
    share = (F.col("toxic") + F.col("clean")) / (n1 + n0)
    prior = F.lit(PRIOR) * share
    log_odds = lambda y, n: F.log((y + prior) / (n + PRIOR - y - prior + 1e-9))
    delta = log_odds(F.col("toxic"), n1) - log_odds(F.col("clean"), n0)
    spread = F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("clean") + prior))
    known = counted.filter(F.col("word").isNotNull()).select("word", "toxic", "clean", delta.alias("delta"), (delta / spread).alias("z"))
    significant = (F.col("z") >= SIGNIFICANCE) & (F.col("toxic") >= SUPPORT) | (F.col("z") <= -SIGNIFICANCE) & (F.col("clean") >= SUPPORT)
    chosen = sorted(known.filter(significant).collect(), key=lambda r: r.word)
    lexicon = {r.word: r.delta if r.z > 0 else min(r.delta, -DRIFT) for r in chosen}
    if not any(x > 0 for x in lexicon.values()):
        return ToxicityModel({}, 1.0, 1.0)
    odds = np.array([(r.clean + 0.5) / clean_words for r in chosen])
    values = np.array([lexicon[r.word] for r in chosen])
    odds, values = np.append(odds, max(1e-6, 1 - odds.sum())), np.append(values, -DRIFT)
    rate = karlin(values, odds / odds.sum())
    # K of a walk with rare steps up: the odds of a step up, discounted as in exp(-lambda * S) by the step itself
    up = values > 0
    scale = float((odds[up] * np.exp(rate * values[up])).sum())
    model = ToxicityModel(lexicon, rate, scale)
    found = [(r.label, r.evidence) for r in _assessed(rows.select("label", "text"), model, ["label"]).select("label", "evidence").collect()]
    y, x = np.array([f[0] for f in found], "f8"), np.array([f[1] for f in found])
    model.slope, model.bias = fit_logistic(x, y)
    discard(rows, counted)
    return model


def _assessed(rows: DataFrame, model: ToxicityModel, keep: list[str]) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def assessed(batches):
        import pyarrow as pa

        passage = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("evidence", pa.float64())])
        for batch in batches:
            passages = [shared.value.passages(t.as_py()) for t in batch.column(len(keep))]
            evidence = [math.log1p(sum(p[2] for p in ps)) for ps in passages]
            spans = [[{"start": a, "end": b, "evidence": e} for a, b, e in ps] for ps in passages]
            cols = [batch.column(k) for k in range(len(keep))] + [pa.array(evidence, pa.float64()), pa.array([shared.value.score(e) for e in evidence], pa.float64()), pa.array(spans, pa.list_(passage))]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "evidence", "toxicity", "passages"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return mapped(rows.select(*keep, F.col("text").alias("_text")), assessed, f"{schema}, evidence double, toxicity double, passages array<struct<start: int, end: int, evidence: double>>", keeps="toxicity")


def assess(docs: DataFrame, model: ToxicityModel, keep: list[str]) -> DataFrame:
    """docs' columns keep, then evidence, toxicity (0 to 1) and passages (characters of the text), from its text."""
    return _assessed(docs, model, keep)


def op4_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    sample = sampled(labels.filter(F.col("toxic").isNotNull() & ~held_out(5, 0)), SAMPLE_ROWS)
    model = fit(labelled_texts(docs, F.broadcast(sample), "toxic"))
    out = assess(docs.select("doc_id", "text"), model, ["doc_id"])
    return out.select("doc_id", held_out(5, 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
