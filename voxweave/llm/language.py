"""Language identification of mixed-language texts.

A word's script narrows the languages that it may be in; each of them scores the word by the log
likelihood of its character trigrams; and a Viterbi pass over the words, with a penalty for each switch of
language, labels spans. A text's language is the one with most letters in its spans, and the score its
share of the letters.

Trigrams of lower-cased words, with a mark for the word's edges, are counted by a hash into BUCKETS counters
per language, on a sample of labelled rows that ``SAMPLE_ROWS`` bounds. So a model has a bounded size, and
is sent to the executors once.

Null texts, and texts without a letter, are ``und`` with score 0; so is every text if no row is labelled.
Ties go to the language whose name comes first. Repeated rows are rows of their own.
"""

from __future__ import annotations

import unicodedata
from array import array
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxweave.llm.arrow import mapped

SAMPLE_ROWS = 20_000
BUCKETS = 1 << 16
SWITCH = 12.0
#: A language takes part in a script if at least this share of its letters are in it.
SCRIPT_SHARE = 0.01
BLOCK_CHARS = 1_000_000
#: Texts of a block that are worth advancing together.
TOGETHER = 20
#: First and last code point of the letters of each script.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)],
}


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: 2 for a letter, 1 for a mark, which may stand in a word, 0 for others; and the number of its script (0: none of them)."""
    letter = np.zeros(0x110000, dtype="u1")
    for a, b in ((0, 0x34000), (0xE0000, 0xE0200)):  # no letter or mark is assigned elsewhere
        letter[a:b] = ["ML".find(unicodedata.category(chr(c))[0]) + 1 for c in range(a, b)]
    script = np.zeros(0x110000, dtype="u1")
    for k, ranges in enumerate(SCRIPTS.values(), 1):
        for a, b in ranges:
            script[a : b + 1] = k
    return letter, script


def _words(texts: list[str]):
    """Over all texts: hashes of trigrams, one per letter or mark; where each word begins among them; words per text; words' scripts and letters."""
    letter, script = _tables()
    joined = " ".join([" ", *texts, " "]).lower()
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    kind = letter[np.minimum(code, 0x10FFFF)]
    is_letter = kind > 0
    at = np.flatnonzero(is_letter)
    now = np.where(is_letter, code, 0).astype("u4")
    h = now[at] * np.uint32(0x9E3779B1) ^ (now[at - 1] * np.uint32(0x85EBCA6B)) ^ (now[at + 1] * np.uint32(0xC2B2AE35))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h = (h >> np.uint32(13)) & np.uint32(BUCKETS - 1)
    first = np.flatnonzero(~is_letter[at - 1])
    lengths = [len(t) for t in texts]
    if len(joined) != sum(lengths) + len(texts) + 3:  # lower() changes the length of a few letters
        lengths = [len(t.lower()) for t in texts]
    ends = np.cumsum(np.array(lengths, "i8") + 1) + 2
    bounds = np.searchsorted(at[first], np.concatenate([[0], ends]))
    letters = np.add.reduceat(kind[at] == 2, first, dtype="i8") if len(first) else np.zeros(0, "i8")
    return h, first, np.diff(bounds), script[code[at[first]]], letters


def _blocks(texts: list[str]):
    """Slices of texts with a bounded number of characters (or one text)."""
    begin, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > BLOCK_CHARS:
            yield begin, k
            begin, size = k, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def sampled(rows: DataFrame, most: int, key: str = "doc_id") -> DataFrame:
    """``most`` of the rows, at random by a hash of the key and thus the same ones each time; all if there are not as many.

    Where rows of one key (or without it) are more than there is room for, they are drawn by a hash of all their columns; of
    rows that are alike in all of these as many count as there is room for.
    """
    below, edge, room = _drawn(rows, F.xxhash64(key), most)
    if edge is None:
        return rows
    out = rows.filter(F.xxhash64(key) < edge)
    if not room:
        return out
    tied = rows.filter(F.xxhash64(key) == edge)
    whole = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])
    _, last, left = _drawn(tied, whole, room)
    out = out.unionByName(tied.filter(whole < last))
    return out.unionByName(repeated(tied.filter(whole == last), left)) if left else out


def _drawn(rows: DataFrame, h: Column, most: int) -> tuple[int, int | None, int]:
    """How many rows have an h below the edge, the h of row most + 1 (None if there is no such row), and how many rows with that h there is room for."""
    first = rows.select(h.alias("h")).orderBy("h").limit(most + 1)
    found = first.groupBy("h").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("n"), F.max("h").alias("h"), F.max_by("n", "h").alias("tied")).first()
    if (found.n or 0) <= most:
        return found.n or 0, None, 0
    return found.n - found.tied, found.h, most - (found.n - found.tied)


def repeated(rows: DataFrame, times: int) -> DataFrame:
    """Any one of the rows, ``times`` times."""
    return rows.limit(1).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("_copy")


def _alone(value: list[float] | None, scores: np.ndarray) -> tuple[int, np.ndarray]:
    """Viterbi over the words of one text, from the values at the word before them: that word's label, and theirs."""
    many = scores.shape[1]
    back = array("H")
    at = 0
    if value is None:
        value = [0.0] * many
    for begin in range(0, len(scores), 1 << 16):
        for row in scores[begin : begin + (1 << 16)].tolist():
            most = max(value)
            best, top = value.index(most), most - SWITCH
            back.extend([k if v >= top else best for k, v in enumerate(value)])
            value = [(v if v >= top else top) + x - most for v, x in zip(value, row)]
    labels = np.empty(len(scores), "u2")
    at = value.index(max(value))
    for t in range(len(scores) - 1, -1, -1):
        labels[t] = at
        at = back[t * many + at]
    return at, labels


class LanguageModel:
    """Log likelihoods by bucket and language, and which languages each script admits."""

    def __init__(self, languages: list[str], counts: np.ndarray, by_script: np.ndarray):
        self.languages = languages
        total = counts.sum(axis=0, keepdims=True)
        used = max(1, int((counts.sum(axis=1) > 0).sum()))
        self.weights = np.log((counts + 0.1) / (total + 0.1 * used)).astype("f4")
        share = by_script / np.maximum(1, by_script.sum(axis=0, keepdims=True))
        admitted = share >= SCRIPT_SHARE
        admitted[~admitted.any(axis=1)] = True
        self.admits = np.where(admitted, 0, -1e4).astype("f4")

    def word_scores(self, texts: list[str]):
        """Per word: scores by language and letters; and the number of words of each text."""
        h, first, counts, script, letters = _words(texts)
        if not len(first):
            return np.zeros((0, len(self.languages)), "f4"), letters, counts
        return np.add.reduceat(self.weights[h], first, axis=0) + self.admits[script], letters, counts

    def labels(self, scores: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The best language of each word, by Viterbi over the words of each text.

        All texts of a block advance together, longest first; when fewer than TOGETHER are left, each goes on by itself.
        """
        out = np.zeros(len(scores), "u2")
        order = np.argsort(-counts, kind="stable")
        begins = (np.cumsum(counts) - counts)[order]
        sizes = counts[order]
        active = len(order) - np.searchsorted(sizes[::-1], np.arange(1, (sizes[0] if len(sizes) else 0) + 1))
        steps = int(np.searchsorted(-active, -TOGETHER, "right"))  # with TOGETHER texts or more
        value, back = None, []
        for t, n in enumerate(active[:steps].tolist()):
            now = scores[begins[:n] + t]
            if t:
                value = value[:n]
                best = value.argmax(axis=1)
                top = value[np.arange(n), best][:, None] - SWITCH
                stay = value >= top
                back.append(np.where(stay, np.arange(now.shape[1]), best[:, None]).astype("u2"))
                now = now + np.where(stay, value, top)
                now -= now.max(axis=1, keepdims=True)
            stop = active[t + 1] if t + 1 < len(active) else 0
            if stop < n:
                out[begins[stop:n] + t] = now[stop:n].argmax(axis=1)
            value = now
        for k in range(active[steps] if steps < len(active) else 0):
            begin, end = begins[k], begins[k] + sizes[k]
            before = out[begin + steps - 1 : begin + steps] if steps else out[:0]
            before[:], out[begin + steps : end] = _alone(value[k].tolist() if steps else None, scores[begin + steps : end])
        for t in range(steps - 1, 0, -1):
            n = active[t]
            out[begins[:n] + t - 1] = back[t - 1][np.arange(n), out[begins[:n] + t]]
        return out

    def predict(self, texts: list[str]) -> list[tuple[str, float, int]]:
        """Language, score and number of spans of each text."""
        result: list[tuple[str, float, int]] = []
        if not self.languages:
            return [("und", 0.0, 0)] * len(texts)
        # texts of like length together, so that few blocks have a long one
        order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
        ordered = [texts[k] for k in order]
        for a, b in _blocks(ordered):
            scores, letters, counts = self.word_scores(ordered[a:b])
            labels = self.labels(scores, counts)
            ends = np.cumsum(counts)
            of = np.repeat(np.arange(b - a), counts)
            share = np.zeros((b - a, len(self.languages)))
            np.add.at(share, (of, labels), letters)
            total = share.sum(axis=1)
            best = share.argmax(axis=1)
            turns = np.zeros(len(labels) + 1, "i8")
            if len(labels):
                turns[1:] = np.cumsum(np.concatenate([[True], (labels[1:] != labels[:-1]) | (of[1:] != of[:-1])]))
            spans = turns[ends] - turns[ends - counts]
            result += [(self.languages[k], s / n, int(c)) if n else ("und", 0.0, 0) for k, s, n, c in zip(best.tolist(), share[np.arange(b - a), best].tolist(), total.tolist(), spans.tolist(), strict=True)]
        by = dict(zip(order, result, strict=True))
        return [by[k] for k in range(len(texts))]

    def spans(self, text: str | None) -> list[tuple[str, int]]:
        """Runs of words in one language: (language, words)."""
        if not text or not self.languages:
            return []
        scores, _, counts = self.word_scores([text])
        out: list[tuple[str, int]] = []
        for label in self.labels(scores, counts).tolist():
            name = self.languages[label]
            if out and out[-1][0] == name:
                out[-1] = (name, out[-1][1] + 1)
            else:
                out.append((name, 1))
        return out


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Counts over the texts of a sample of labelled (doc_id, text, lang); only sums by language, bucket and script reach the driver."""

    def counted(batches):
        import pyarrow as pa

        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                mine = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                total = sums.setdefault(lang, np.zeros(BUCKETS + len(SCRIPTS) + 1, "i8"))
                for a, b in _blocks(mine):
                    h, _, _, script, letters = _words(mine[a:b])
                    total[:BUCKETS] += np.bincount(h, minlength=BUCKETS)
                    total[BUCKETS:] += np.bincount(script, letters, len(SCRIPTS) + 1).astype("i8")
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["lang", "at", "n"])

    rows = sampled(labelled.filter("lang is not null and text is not null"), sample_rows).select("lang", "text")
    found = mapped(rows, counted, "lang string, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toArrow()
    named = found["lang"].combine_chunks().dictionary_encode()
    languages = sorted(named.dictionary.to_pylist())
    counts = np.zeros((BUCKETS + len(SCRIPTS) + 1, len(languages)))
    place = np.array([languages.index(x) for x in named.dictionary.to_pylist()], "i8")
    if len(found):
        counts[found["at"].to_numpy(), place[named.indices.to_numpy()]] = found["n"].to_numpy()
    return LanguageModel(languages, counts[:BUCKETS], counts[BUCKETS:])


def held_out(modulus: int, rest: int, key: str = "doc_id") -> Column:
    """Whether crc32 of the key as text leaves the rest; false for a null key."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(modulus)) == rest, F.lit(False))


def identify(docs: DataFrame, model: LanguageModel, keep: list[str]) -> DataFrame:
    """docs' columns keep, then lang_pred, lang_score and lang_spans, from its text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predicted(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
            got = shared.value.predict(texts)
            cols = [batch.column(k) for k in range(len(keep))]
            cols += [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "lang_pred", "lang_score", "lang_spans"])

    rows = docs.select(*keep, F.col("text").alias("_text"))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return mapped(rows, predicted, f"{schema}, lang_pred string, lang_score double, lang_spans long")


def op10_language(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text", "lang")
    model = fit(docs.filter(~held_out(4, 2)))
    out = identify(docs, model, ["doc_id"])
    return out.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_spans").alias("n_spans"))
