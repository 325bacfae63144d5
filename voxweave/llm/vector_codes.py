"""Codes of vectors by product quantisation, with partial-distance search for the nearest codebook entry.

A component x becomes the integer floor(256 * x). Vectors are cut into PARTS equal parts, each with a codebook of
ENTRIES entries, which starts as that part of the vectors of the smallest vec_ids and is refined ROUNDS times: every part
goes to its nearest entry, and an entry becomes the componentwise floor of its parts' mean. All of it is exact.

*Partial-distance search.* The dimensions of a part are taken in descending variance over its codebook. After each one the
entry that leads is measured whole, which gives the row's best complete distance so far, and masks drop the entries whose
accumulated distance strictly exceeds it; so what is left at the end holds every nearest entry, ties included.

Each task sums its parts by entry; Spark adds the sums. The driver holds the codebooks, whose size is fixed.

Rows are dropped whose vector is null, holds a null or non-finite component, or whose length is not the most common one
among the rest (the least on a tie) or no multiple of PARTS. Fewer than ENTRIES vectors make as many entries; repeated
vec_ids are rows of their own, of which the smaller vector comes first; those without vec_id come last. Components too
large for 64-bit distances are handled by Python's integers; an error that no long can hold is null, as is
the sum of its label.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxweave.llm.arrow import mapped
from voxweave.llm.tables import saved, small

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integers below this in size have distances of up to 1024 dimensions that fit into 64 bits.
PLAIN = 1 << 25
#: Sums are handed on in limbs of so many bits.
LIMB = 60
#: Rows that are searched together.
ROWS = 4096


def kept(embeddings: DataFrame, vector: str = "embedding") -> tuple[DataFrame, int]:
    """vec_id, label, vector of the rows that count, and their length."""
    value = F.col(vector)
    whole = value.isNotNull() & (F.size(value) > 0) & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = embeddings.filter(F.coalesce(whole, F.lit(False))).select("vec_id", "label", value.alias("vector"))
    sizes = rows.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("size") % PARTS == 0)
    most = sizes.orderBy(F.desc("n"), "size").first()
    length = most["size"] if most else 0
    return rows.filter(F.size("vector") == length), length


def integers(flat: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), as 64-bit integers, or as Python's where those would not do."""
    with np.errstate(over="ignore"):
        scaled = np.floor(flat.astype("f8") * SCALE)
    if not len(flat) or np.abs(scaled).max() < PLAIN:
        return scaled.astype("i8")
    out = np.empty(len(flat), object)
    out[:] = [int(s) if math.isfinite(s) else int(x) * SCALE for s, x in zip(scaled.tolist(), flat.astype("f8").tolist())]
    return out


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the nearest entry of the book, the least of several, and its squared distance."""
    variance = (len(book) * (book**2).sum(axis=0) - book.sum(axis=0) ** 2).tolist()  # times the square of the entries
    dims = sorted(range(book.shape[1]), key=lambda d: -variance[d])
    whole = lambda rows, entries: ((x[rows] - book[entries]) ** 2).sum(axis=1)
    every = np.arange(len(x))
    far = (x[:, dims[0], None] - book[None, :, dims[0]]) ** 2
    leader = far.argmin(axis=1)
    best = whole(every, leader)
    row, entry = np.nonzero(far <= best[:, None])
    far = far[row, entry]
    for k, d in enumerate(dims[1:], 2):
        far = far + (x[row, d] - book[entry, d]) ** 2
        if k + 1 < len(dims):
            starts = np.searchsorted(row, every)
            lead = np.minimum.reduceat(far, starts) if far.dtype != object else np.array([min(g) for g in np.split(far, starts[1:])], object)
            at = np.flatnonzero(far == lead[row])
            at = at[np.searchsorted(row[at], every)]
            best = np.minimum(best, whole(every, entry[at]))
        stays = far <= best[row]
        row, entry, far = row[stays], entry[stays], far[stays]
    starts = np.searchsorted(row, every)
    least = np.minimum.reduceat(far, starts) if far.dtype != object else np.array([min(g) for g in np.split(far, starts[1:])], object)
    at = np.flatnonzero(far == least[row])
    at = at[np.searchsorted(row[at], every)]
    return entry[at], far[at]


def _coded(vectors, length: int, books: list[np.ndarray]):
    """Slices of an Arrow list column: the integers (rows, PARTS, length / PARTS), entries and distances (rows, PARTS)."""
    for begin in range(0, len(vectors), ROWS):
        x = integers(vectors.slice(begin, ROWS).flatten().to_numpy(zero_copy_only=False)).reshape(-1, PARTS, length // PARTS)
        found = [nearest(x[:, p], books[p]) for p in range(PARTS)]
        yield x, np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _limbs(value: int):
    """(k, limb) for which the value is the sum of limb << (LIMB * k), each limb within LIMB bits and of the value's sign."""
    sign, value, k = (-1 if value < 0 else 1), abs(value), 0
    while value or not k:
        yield k, sign * (value & ((1 << LIMB) - 1))
        value, k = value >> LIMB, k + 1


def _refined(rows: DataFrame, length: int, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round; the counts of an entry come as place -1."""

    def summed(batches):
        import pyarrow as pa

        width = length // PARTS
        total = np.zeros((PARTS, ENTRIES, width), object)
        count = np.zeros((PARTS, ENTRIES), "i8")
        for batch in batches:
            for x, entry, _ in _coded(batch.column(0), length, books):
                for p in range(PARTS):
                    count[p] += np.bincount(entry[:, p], minlength=ENTRIES)
                    if x.dtype == object:
                        for e, part in zip(entry[:, p].tolist(), x[:, p]):
                            total[p, e] += part
                        continue
                    for d in range(width):
                        part = np.zeros(ENTRIES, "i8")
                        np.add.at(part, entry[:, p], x[:, p, d])
                        total[p, :, d] += part
        out = [(p, e, d, k, str(limb)) for p, e in np.argwhere(count).tolist() for d in range(width) for k, limb in _limbs(int(total[p, e, d]))]
        out += [(p, e, -1, 0, str(count[p, e])) for p, e in np.argwhere(count).tolist()]
        cols = list(zip(*out)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int32()] * 4 + [pa.string()])], names=["part", "entry", "place", "limb", "total"])

    sums = mapped(rows.select("vector"), summed, "part int, entry int, place int, limb int, total string")
    # as many rows as the codebooks have components
    found = sums.groupBy("part", "entry", "place", "limb").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    total: dict[tuple[int, int, int], int] = {}
    for r in found:
        key = (r.part, r.entry, r.place)
        total[key] = total.get(key, 0) + (int(r.total) << (LIMB * r.limb))
    out = [b.copy() for b in books]
    for (p, e, d), value in total.items():
        if d >= 0:
            new = value // total[p, e, -1]
            if out[p].dtype != object and abs(new) >= PLAIN:
                out[p] = out[p].astype(object)
            out[p][e, d] = new
    return out


def codebooks(rows: DataFrame, length: int, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebook of each part (entries, length / PARTS) after the rounds."""
    first = rows.select("vec_id", "vector").orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(ENTRIES).collect()
    x = integers(np.array([v for r in first for v in r.vector], "f8")).reshape(len(first), PARTS, length // PARTS)
    books = [x[:, p].copy() for p in range(PARTS)]
    for _ in range(rounds):
        books = _refined(rows, length, books)
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def codes(rows: DataFrame, length: int, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code, error of each row."""
    most = (1 << 63) - 1

    def coded(batches):
        import pyarrow as pa

        for batch in batches:
            text, error = [], []
            for _, entry, far in _coded(batch.column(2), length, books):
                text += [bytes(e).hex() for e in entry.astype("u1")]
                error += far.sum(axis=1).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([x if x <= most else None for x in error], pa.int64())], names=["vec_id", "label", "code", "error"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    return mapped(rows.select("vec_id", "label", "vector"), coded, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def compressed(embeddings: DataFrame, vector: str = "embedding") -> tuple[DataFrame, list[np.ndarray]]:
    """vec_id, label, code, error of the rows that count, written to the shared folder, and the codebooks."""
    rows, length = kept(embeddings, vector)
    if not length:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).limit(0), []
    books = codebooks(rows, length)
    return saved(codes(rows, length, books)), books


def op13_vector_codes(embeddings: DataFrame) -> DataFrame:
    found, books = compressed(embeddings)
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    by_label = found.groupBy(F.col("label").alias("_label")).agg(F.when((F.count("error") == F.count(F.lit(1))) & (total <= (1 << 63) - 1), total).cast("long").alias("label_error"))
    out = found.join(small(by_label, 48), F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    width = 64 // PARTS
    far = " + ".join(f"(x.sub[{k}] - b.sub[{k}]) * (x.sub[{k}] - b.sub[{k}])" for k in range(1, width + 1))
    means = ", ".join(f"CAST(floor(sum(x.sub[{k}]) / count(*)) AS BIGINT)" for k in range(1, width + 1))
    steps = []
    for n in range(ROUNDS + 1):
        near = f"SELECT r, p, min(d) AS d, arg_min(e, d * {ENTRIES} + e) AS e FROM (SELECT x.r, x.p, b.e, {far} AS d FROM parts x JOIN book{n} b ON x.p = b.p) GROUP BY r, p"
        steps.append(f"near{n} AS MATERIALIZED ({near})")
        if n < ROUNDS:
            mean = f"SELECT x.p, a.e, [{means}] AS sub FROM parts x JOIN near{n} a ON x.r = a.r AND x.p = a.p GROUP BY x.p, a.e"
            steps.append(f"book{n + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.sub, b.sub) AS sub FROM book{n} b LEFT JOIN ({mean}) m ON b.p = m.p AND b.e = m.e)")
    return f"""
    WITH kept AS MATERIALIZED (
      SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * x) AS BIGINT)) AS v
      FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    parts AS MATERIALIZED (SELECT r, p, v[p * {width} + 1 : p * {width} + {width}] AS sub FROM kept, (SELECT unnest(range({PARTS})) AS p)),
    book0 AS MATERIALIZED (SELECT p, r - 1 AS e, sub FROM parts WHERE r <= {ENTRIES}),
    {", ".join(steps)},
    coded AS (SELECT r, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY r),
    books AS (SELECT sha256(string_agg(array_to_string(sub, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{ROUNDS})
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
    FROM kept JOIN coded USING (r), books"""


SQL = _sql()
