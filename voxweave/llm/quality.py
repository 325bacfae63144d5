"""Document quality from line labels of a linear-chain conditional random field.

Every line of a text is good or bad. A line's features are shares of its characters and words (upper case,
symbols, bars, exclamation marks, digits, words that repeat the one before), its place, and the same shares
of the lines before and after it; the chain adds a weight for each pair of neighbouring labels.

Only documents are labelled. A good document's lines are all good; of a bad one's at least one is bad. The
weights maximise the likelihood of just that: log P(all good) for the good, log(1 - P(all good)) for the
bad, by gradients from forward-backward. They are fitted on a sample that ``SAMPLE_ROWS``, ``SAMPLE_LINES`` and
``LONGEST_LINES`` bound, so that what reaches the driver, 116 bytes a line, and the steps taken there are bounded too.

A document's score is a logistic function of the log of its bad share: the marginal P(bad) of each line,
weighted by the line's length. Null and empty texts have one empty line. Ties and repeated rows need no
care; without any labelled row every score is 0.5.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxweave.llm.arrow import mapped
from voxweave.llm.language import held_out, repeated, sampled
from voxweave.llm.shingles import _word_hashes

SAMPLE_ROWS = 6_000
#: Lines of the sampled texts in all, and of one of them; a text of more is not learned from.
SAMPLE_LINES, LONGEST_LINES = 250_000, 2_000
STEPS = 150
BLOCK_BYTES = 4 << 20
SHARES = 8
#: Bias, own shares, length, word length, first, last, and the shares of both neighbours.
FEATURES = 1 + SHARES + 4 + 2 * SHARES

_CLASS = np.zeros(256, dtype="u1")  # 1 upper, 2 lower, 3 digit, 4 space, 5 bar, 6 exclamation mark, 7 plain mark, 8 symbol, 0 other
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[[32, 9, 10, 11, 12, 13]] = 1, 2, 3, 4
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum()]] = 8
_CLASS[[ord(c) for c in ".,;:'\"-()?"]] = 7
_CLASS[ord("|")], _CLASS[ord("!")] = 5, 6


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines x FEATURES), lengths in bytes, and lines per text, for texts that lie one after another in data."""
    breaks = np.flatnonzero(data == 10)
    # a line begins at a text's start and after each line break
    starts = np.sort(np.concatenate([offsets[:-1] * 2, breaks * 2 + 3])) >> 1
    counts = np.ones(len(offsets) - 1, "i8") + np.diff(np.searchsorted(breaks, offsets))
    first = np.zeros(len(starts), bool)
    last = np.zeros(len(starts), bool)
    ends_at = np.cumsum(counts)
    if len(starts):
        first[ends_at - counts] = True
        last[ends_at - 1] = True
    stops = np.empty_like(starts)
    stops[:-1] = starts[1:]
    if len(starts):
        stops[-1] = len(data)
    lengths = stops - starts

    def per_line(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype="i8")])
        return (sums[stops] - sums[starts]).astype("f8")

    kind = _CLASS[data]
    space = kind == 4
    begins = ~space & np.concatenate([[True], space[:-1]]) if len(data) else space
    follows = np.concatenate([space[1:], [True]]) if len(data) else space
    hashes, _ = _word_hashes(data, np.unique(np.append(starts, len(data)))) if len(data) else (np.zeros(0, "u8"), None)
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    word_at = np.flatnonzero(~space & (np.concatenate([[True], space[:-1]]) | edge[:-1])) if len(data) else np.zeros(0, "i8")
    again = np.zeros(len(data), bool)
    if len(word_at) > 1:
        line_of = np.searchsorted(starts, word_at, "right")
        again[word_at[1:]] = (hashes[1:] == hashes[:-1]) & (line_of[1:] == line_of[:-1])
    begins = np.zeros(len(data), bool)
    begins[word_at] = True
    upper, lower, digit, bars, bangs, symbols = (per_line(kind == k) for k in (1, 2, 3, 5, 6, 8))
    words, repeats = per_line(begins), per_line(again)
    ended = per_line((kind == 8) & follows)
    solid = np.maximum(1, per_line(~space))
    some = np.maximum(1, words)
    shares = np.stack([upper / np.maximum(1, upper + lower), symbols / solid, np.minimum(1, bars / some), np.minimum(1, bangs / some), digit / solid, repeats / some, np.minimum(1, ended / some), np.minimum(2, solid / some / 10)], axis=1)
    before = np.vstack([np.zeros((1, SHARES)), shares[:-1]]) if len(starts) else shares
    after = np.vstack([shares[1:], np.zeros((1, SHARES))]) if len(starts) else shares
    before[first] = 0
    after[last] = 0
    own = np.stack([np.log1p(lengths) / 8, np.log1p(words) / 6, first.astype("f8"), last.astype("f8")], axis=1)
    return np.hstack([np.ones((len(starts), 1)), shares, own, before, after]).astype("f4"), lengths, counts


class Chains:
    """Chains of lines that advance together, longest first."""

    def __init__(self, counts: np.ndarray):
        order = np.argsort(-counts, kind="stable")
        self.begins = (np.cumsum(counts) - counts)[order]
        sizes = counts[order]
        self.sizes, self.order = sizes, order
        self.active = (len(order) - np.searchsorted(sizes[::-1], np.arange(1, (sizes[0] if len(sizes) else 0) + 1))).tolist()

    def forward_backward(self, bad: np.ndarray, pairs: np.ndarray):
        """bad: log potential of the bad label per line (good: 0); pairs[y, z]: of label z after y.

        Marginals of bad per line, log Z per chain, and summed expectations of the pairs per chain.
        """
        n = len(bad)
        alpha, beta, expected = np.zeros((n, 2)), np.zeros((n, 2)), np.zeros((len(self.begins), 2, 2))
        local = np.stack([np.zeros(n), bad], axis=1)
        for t, k in enumerate(self.active):
            at = self.begins[:k] + t
            alpha[at] = local[at] if not t else local[at] + np.logaddexp(alpha[at - 1, :1] + pairs[0], alpha[at - 1, 1:] + pairs[1])
        for t in range(len(self.active) - 2, -1, -1):
            at = self.begins[: self.active[t + 1]] + t
            ahead = local[at + 1] + beta[at + 1]
            beta[at] = np.logaddexp(pairs[:, 0] + ahead[:, :1], pairs[:, 1] + ahead[:, 1:])
        ends = self.begins + self.sizes - 1
        z = np.logaddexp(alpha[ends, 0], alpha[ends, 1])
        for t in range(1, len(self.active)):
            k = self.active[t]
            at = self.begins[:k] + t
            expected[:k] += np.exp(alpha[at - 1][:, :, None] + pairs + (local[at] + beta[at])[:, None, :] - z[:k, None, None])
        total = alpha + beta
        marginal = np.exp(total[:, 1] - np.logaddexp(total[:, 0], total[:, 1]))
        return marginal, z, expected


class QualityModel:
    def __init__(self, weights: np.ndarray, pairs: np.ndarray, slope: float = 0.0, bias: float = 0.0):
        self.weights, self.pairs, self.slope, self.bias = weights, pairs, slope, bias

    def bad_shares(self, features: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per text the length-weighted share of bad; per line P(bad)."""
        if not len(counts):
            return np.zeros(0), np.zeros(0)
        marginal, _, _ = Chains(counts).forward_backward(features @ self.weights, self.pairs)
        weight = lengths + 1.0
        starts = np.cumsum(counts) - counts
        return np.add.reduceat(marginal * weight, starts) / np.add.reduceat(weight, starts), marginal

    def scores(self, shares: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * np.log(shares + 1e-4) + self.bias)))


def fit_chain(features: np.ndarray, counts: np.ndarray, good: np.ndarray, steps: int = STEPS) -> QualityModel:
    """Adam over the likelihood of document labels; good has a flag per text."""
    chains = Chains(counts)
    flag = good[chains.order]
    starts = np.cumsum(counts) - counts
    weights, pairs = np.zeros(FEATURES), np.zeros((2, 2))
    weights[0] = -3.0
    pairs[0, 0] = pairs[1, 1] = 0.5
    m = v = np.zeros(FEATURES + 4)
    steps_between = chains.sizes - 1
    for step in range(1, steps + 1):
        marginal, z, expected = chains.forward_backward(features @ weights, pairs)
        all_good = np.minimum(pairs[0, 0] * steps_between - z, -1e-9)
        p0 = np.exp(all_good)
        # d log P(all good) is the all-good features less the expected ones; for bad texts by the chain rule
        factor = np.where(flag, 1.0, -p0 / np.maximum(1 - p0, 1e-6))
        factor = np.clip(factor, -20, 1)
        per_text = np.empty(len(counts))
        per_text[chains.order] = factor
        grad_w = -(features * (marginal * np.repeat(per_text, counts))[:, None]).sum(axis=0)
        seen = -expected
        seen[:, 0, 0] += steps_between
        grad_p = (seen * factor[:, None, None]).sum(axis=0).ravel()
        grad = np.concatenate([grad_w, grad_p]) / len(counts) - 1e-3 * np.concatenate([weights, pairs.ravel()])
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        weights = weights + move[:FEATURES]
        pairs = pairs + move[FEATURES:].reshape(2, 2)
    return QualityModel(weights, pairs)


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and bias by Newton steps with a little shrinkage."""
    a = np.stack([x, np.ones(len(x))], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        w = w + np.clip(np.linalg.solve(h, a.T @ (y - p) - 1e-3 * w), -3, 3)
    return float(w[0]), float(w[1])


def _sliced(column):
    """(features, lengths, counts) of slices of an Arrow string column with a bounded number of bytes, or one text."""
    import pyarrow as pa

    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], "i8", len(column) + 1, 8 * column.offset)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, "u1") if buffer is not None and buffer.size else np.zeros(0, "u1")
    at = 0
    while at < len(column):
        stop = min(len(column), max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, "right")) - 1))
        begin, end = int(offsets[at]), int(offsets[stop])
        yield line_features(data[begin:end], offsets[at : stop + 1] - begin)
        at = stop


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> QualityModel:
    """labelled: doc_id, text and label (1 good, 0 bad). The features of the sampled rows' lines come to the driver."""

    def featured(batches):
        import pyarrow as pa

        for batch in batches:
            labels, at = batch.column(0).to_pylist(), 0
            for features, lengths, counts in _sliced(batch.column(1)):
                ends = np.cumsum(counts)
                rows = [(labels[at + k], features[b - c : b].tobytes(), lengths[b - c : b].astype("<i8").tobytes()) for k, (b, c) in enumerate(zip(ends.tolist(), counts.tolist(), strict=True))]
                at += len(counts)
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], names=["label", "features", "lengths"])

    rows = sampled(labelled.filter("label is not null"), sample_rows)
    lines = F.char_length(F.coalesce("text", F.lit(""))) - F.char_length(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(""))) + 1
    rows = rows.select(F.col("label").cast("int").alias("label"), "text", lines.alias("_lines"), F.xxhash64("doc_id", "text").alias("_h")).filter(F.col("_lines") <= LONGEST_LINES)
    # a running sum over as many rows as the sample has
    so_far = Window.partitionBy(F.lit(0)).orderBy("_h", "label").rowsBetween(Window.unboundedPreceding, 0)
    fits = rows.select("_h", "label", F.sum("_lines").over(so_far).alias("_sum"))
    last = fits.filter(F.col("_sum") > SAMPLE_LINES).agg(F.min("_h")).first()[0]
    if last is not None:
        # of the rows that are alike at the bound, as many as there is room for
        room = fits.filter((F.col("_h") == last) & (F.col("_sum") <= SAMPLE_LINES)).count()
        some = rows.filter(F.col("_h") < F.lit(last))
        rows = some.unionByName(repeated(rows.filter(F.col("_h") == last), room)) if room else some
    rows = rows.select("label", "text")
    found = sorted(mapped(rows, featured, "label int, features binary, lengths binary").collect(), key=lambda r: (r.label, bytes(r.features)))
    if len({r.label for r in found}) < 2:
        return QualityModel(np.zeros(FEATURES), np.zeros((2, 2)))
    parts = [np.frombuffer(r.features, "f4").reshape(-1, FEATURES) for r in found]
    counts = np.array([len(p) for p in parts])
    good = np.array([r.label == 1 for r in found])
    features = np.concatenate(parts).astype("f8")
    lengths = np.concatenate([np.frombuffer(r.lengths, "<i8") for r in found])
    model = fit_chain(features, counts, good)
    shares, _ = model.bad_shares(features, lengths, counts)
    model.slope, model.bias = fit_logistic(np.log(shares + 1e-4), good.astype("f8"))
    return model


def assess(docs: DataFrame, model: QualityModel, keep: list[str]) -> DataFrame:
    """docs' columns keep, then quality (0 to 1), bad_share, lines and bad_lines, from its text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def assessed(batches):
        import pyarrow as pa

        for batch in batches:
            found = [(shared.value.bad_shares(f, n, c), c) for f, n, c in _sliced(batch.column(len(keep)))]
            if not found:
                continue
            shares = np.concatenate([x[0][0] for x in found])
            counts = np.concatenate([x[1] for x in found])
            bad = np.concatenate([np.add.reduceat(m > 0.5, np.cumsum(c) - c, dtype="i8") for (_, m), c in found])
            cols = [batch.column(k) for k in range(len(keep))] + [pa.array(shared.value.scores(shares)), pa.array(shares), pa.array(counts, pa.int64()), pa.array(bad, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "quality", "bad_share", "lines", "bad_lines"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return mapped(docs.select(*keep, F.col("text").alias("_text")), assessed, f"{schema}, quality double, bad_share double, lines long, bad_lines long")


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """doc_id, text, label of the rows that may be learned from: crc32 of doc_id modulo 5 is not 0."""
    known = labels.filter(F.col(label).isNotNull() & ~held_out(5, 0)).groupBy("doc_id").agg(F.max(label).alias("label"))
    return docs.select("doc_id", "text").join(known, "doc_id")


def op7_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    sample = sampled(labels.filter(F.col("quality").isNotNull() & ~held_out(5, 0)), SAMPLE_ROWS)
    model = fit(labelled_texts(docs, F.broadcast(sample), "quality"))
    out = assess(docs.select("doc_id", "text"), model, ["doc_id"])
    return out.select("doc_id", held_out(5, 0).alias("held_out"), F.col("quality").alias("score"), (F.col("quality") >= 0.3).cast("int").alias("predicted"), "bad_share", "lines", "bad_lines")
