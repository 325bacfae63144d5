"""Near-duplicate documents by MinHash with one permutation, confirmed on whole shingle sets.

1. *Sketch.* A text's shingle hashes, which are one permutation of all shingles, are cut into BANDS * ROWS ranges of
   equal width; a range's least hash is its value. An empty range takes the value of the first filled one in a random
   order of its own (optimal densification), so that two sets agree in any range with a chance of their Jaccard
   similarity, however few shingles they have. Each run of ROWS values makes a bucket; a pair at the threshold of
   0.85 shares none of the BANDS buckets with odds of 6 in 10^9.
2. Equal sets become one. Buckets that more than one set is in are kept.
3. *Star-shaped edges.* In a bucket each set of a band of sizes is paired with that band's two centres only, not with all
   others, and the pairs are decided on the whole sets.
4. Buckets in which components still meet are searched in blocks, as the n-gram join does, so that no link between
   sets that share a bucket is lost where it matters to the components.

Null and empty texts have no shingles and link with nothing. Repeated rows and rows without doc_id are rows of their own;
``kept`` compares doc_id with component_id as equal if both are null, so rows without doc_id are kept where their component has
no doc_id at all, and repeated rows of the kept doc_id all are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxweave.llm import near
from voxweave.llm.arrow import mapped
from voxweave.llm.tables import discard, saved

PERCENT, BANDS, ROWS = 85, 40, 6
BINS = BANDS * ROWS
_rng = np.random.default_rng(20240612)
#: For each range the order in which it tries the others, as the place that each of them has in it.
_TRIES = np.argsort(_rng.permuted(np.tile(np.arange(BINS), (BINS, 1)), axis=1), axis=1)
#: Odd multipliers for the rows of a band, and a value that tells bands apart.
_ROW = _rng.integers(0, 2**63, ROWS, dtype="u8") * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(0, 2**63, BANDS, dtype="u8")
#: The least hash of each range, and one past the last.
_EDGES = np.array([-(-(k << 64) // BINS) for k in range(BINS)], "u8")


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The value of each range for a set (sorted, not empty)."""
    first = np.searchsorted(hashes, _EDGES)
    filled = np.append(first[1:], len(hashes)) > first
    out = hashes[np.minimum(first, len(hashes) - 1)]
    if not filled.all():
        have, empty = np.flatnonzero(filled), np.flatnonzero(~filled)
        out[empty] = out[have[_TRIES[np.ix_(empty, have)].argmin(axis=1)]]
    return out


def buckets(sketches: np.ndarray) -> np.ndarray:
    """The buckets (sets, BANDS) of sketches (sets, BINS)."""
    from voxweave.llm.shingles import mixed

    return mixed((sketches.reshape(-1, BANDS, ROWS) * _ROW).sum(axis=2, dtype="u8") + _BAND)


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, tie (a hash of the text), n, node (the digest of its set) and buckets (none without shingles) of each row."""

    def rows(batches):
        import pyarrow as pa

        from voxweave.llm.shingles import column_sets, set_digest

        kind = pa.list_(pa.int64())
        for batch in batches:
            n, node, found = [], [], []
            for hashes in column_sets(batch.column(2)):
                n.append(len(hashes))
                node.append(set_digest(hashes))
                if len(hashes):
                    found.append(sketch(hashes))
            ends = np.cumsum(np.where(np.array(n, "i8") > 0, BANDS, 0))
            values = buckets(np.stack(found)).view("i8").ravel() if found else np.zeros(0, "i8")
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(values), type=kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(node, pa.int64()), lists], names=["doc_id", "tie", "n", "node", "buckets"])

    return mapped(near.keyed(docs), rows, "doc_id long, tie long, n long, node long, buckets array<long>")


def shared_buckets(rows: DataFrame) -> DataFrame:
    """h, node, n of the sets of rows that are in buckets of more than one set."""
    sets = rows.filter("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("buckets").alias("buckets"))
    each = saved(sets.select("node", "n", F.explode("buckets").alias("h")))
    several = saved(each.groupBy("h").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("rows")).filter("low <> high").select("h", "rows"))
    found = saved(near.met(each, several.select("h"), ["h"], several, "left_semi").select("h", "node", "n"))
    discard(each, several)
    return found


def whole_sets(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """node, n, shingles of each node of rows (doc_id, tie, node)."""

    def scan(batches):
        import pyarrow as pa

        from voxweave.llm.shingles import column_sets

        for batch in batches:
            at, n, found = [], [], []
            for k, hashes in enumerate(column_sets(batch.column(1))):
                at.append(k), n.append(len(hashes)), found.append(hashes.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(found, pa.binary())], names=["node", "n", "shingles"])

    return mapped(near.set_texts(docs, rows)[0], scan, "node long, n long, shingles binary")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    rows = saved(sketched(docs))
    lists = shared_buckets(rows)
    wanted = rows.join(lists.select("node").distinct(), "node", "left_semi")
    sets = saved(whole_sets(docs, wanted))
    roots = near.linked(lists, sets, percent)
    discard(lists, sets)
    return near.with_components(rows, roots)


def op12_minhash_dedup(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def join_sql(percent: int, more: str = "") -> str:
    """DuckDB SQL for the rows of the exact join at a percentage: doc_id, n_shingles, component_id; more: columns that follow from these."""
    return rf"""
    WITH RECURSIVE words AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    sets AS MATERIALIZED (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' '))) END AS s FROM words),
    grams AS MATERIALIZED (SELECT r, len(s) AS n, unnest(s) AS g FROM sets),
    pairs AS (SELECT a.r AS a, b.r AS b, a.n AS n, b.n AS m, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.r < b.r
      WHERE 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n) GROUP BY ALL),
    links AS MATERIALIZED (SELECT a, b FROM pairs WHERE 100 * c >= {percent} * (n + m - c)),
    edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reached AS (SELECT r, r AS t FROM sets UNION SELECT reached.r, b FROM reached JOIN edges ON t = a),
    roots AS (SELECT reached.r, min(doc_id) AS component_id FROM reached JOIN sets ON t = sets.r GROUP BY reached.r)
    SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id{more} FROM sets JOIN roots USING (r)"""


SQL = join_sql(PERCENT, ", doc_id IS NOT DISTINCT FROM component_id AS kept")
