"""Benchmark decontamination by size-partitioned MinHash containment search, with DataFrame functions only.

A test item is contained in a document when at least PERCENT / 100 of its distinct five-word shingles occur
there (an item of fewer words has its whole sequence as its one shingle, looked for as a run of as many
words). Items are partitioned by their number of shingles, a partition for each power of two, and the partition fixes how many
of an item's smallest hash values (its bottom-k MinHash sketch) are looked up in documents, and how many of them a document
must have:

* up to WHOLE shingles, of which m may be lacking: 2 * m + 1 values, of which all but m must be found, so nothing is missed;
* beyond that SKETCH values. How many of them a document holds that contains the item is hypergeometric; what must be found
  lies SIGMAS standard deviations below the mean at the threshold, so that an item at the threshold is missed with odds of
  about 3 in 10^7, and one above it with less. ``exact`` looks up as many values as miss nothing, for items of any size.

A sketch of the document would not do: in a long one a short item's values would be lost among the others. Candidates are then
checked by the exact shingles: of their documents only the places whose hash is of a found item's shingle are taken out as words.

Words are runs of bytes other than ASCII white space, A-Z lower-cased. Null and empty texts contain
nothing and are contained in nothing. Rows with equal doc_id or item_id count as one document or item that
has the shingles of all of them; null is an id like any other, and its rows are met once each.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxweave.llm.tables import saved, small

PERCENT = 75
SHINGLE = 5
#: Shingles up to which an item's sketch misses nothing; values of the sketch of a longer one, and how far below the mean a document may stay.
WHOLE, SKETCH, SIGMAS = 64, 65, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


def runs(of: Column, length: Column | int) -> Column:
    """All runs of length words, none if there are not as many."""
    length = F.lit(length) if isinstance(length, int) else length
    return F.when(F.size(of) >= length, F.transform(F.sequence(F.lit(1), F.size(of) - length + 1), lambda i: F.slice(of, i, length))).otherwise(F.array().cast("array<array<string>>"))


def joined(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """left and right joined where their keys are equal or both null; the key stands in the result once."""
    other = right.withColumnRenamed(key, "_other")
    return left.join(other, F.col(key).eqNullSafe(F.col("_other")), how).drop("_other")


def item_shingles(items: DataFrame) -> DataFrame:
    """item_id, shingle (its words joined by a space), width (its words), h (its hash), n (shingles of the item)."""
    rows = items.select("item_id", words(F.col("text")).alias("_w")).filter(F.size("_w") > 0)
    rows = rows.select("item_id", F.explode(runs(F.col("_w"), F.least(F.size("_w"), F.lit(SHINGLE)))).alias("_s"))
    rows = rows.select("item_id", F.concat_ws(" ", "_s").alias("shingle"), F.size("_s").alias("width"), F.xxhash64("_s").alias("h")).distinct()
    sizes = rows.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return joined(rows, sizes, "item_id")


def sketches(shingles: DataFrame, percent: int = PERCENT, exact: bool = False) -> DataFrame:
    """h, width, item_id, need: of each item the smallest hash values, as many as its size partition asks for, and how many of them a document must have."""
    per_item = shingles.groupBy("item_id", "n").agg(F.sort_array(F.collect_set(F.struct("h", "width"))).alias("_all"))
    lacks = lambda n: n - F.ceil(n * percent / 100).cast("long")
    largest = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n").cast("double")))).cast("long")  # of the item's partition
    whole = F.least(F.col("n"), 2 * lacks(largest) + 1)
    share = percent / 100
    spread = SIGMAS * math.sqrt(SKETCH * share * (1 - share))
    short = F.lit(exact) | (largest <= WHOLE)
    taken = F.when(short, whole).otherwise(F.lit(SKETCH).cast("long"))
    need = F.when(short, whole - lacks(F.col("n"))).otherwise(F.lit(max(1, math.floor(SKETCH * share - spread))).cast("long"))
    rows = per_item.select("item_id", need.alias("need"), F.explode(F.slice("_all", F.lit(1), taken.cast("int"))).alias("_v"))
    return rows.select(F.col("_v.h").alias("h"), F.col("_v.width").alias("width"), "item_id", "need")


def hashed_runs(of: Column, widths: list[int]) -> Column:
    """The hashes of all runs of these many words, in order, those of each width after those before it."""
    places = lambda k: F.when(F.size(of) >= k, F.sequence(F.lit(1), F.size(of) - k + 1)).otherwise(F.array().cast("array<int>"))
    parts = [F.transform(places(k), lambda at: F.xxhash64(F.slice(of, at, k))) for k in widths]  # noqa: B023
    return F.concat(*parts) if parts else F.array().cast("array<long>")


def _widths(rows: DataFrame) -> list[int]:
    return sorted(r.width for r in rows.select("width").distinct().collect())  # five values at most


def candidates(docs: DataFrame, sketch: DataFrame) -> DataFrame:
    """Distinct (doc_id, item_id) where the document has as many values of the item's sketch as it needs."""
    rows = docs.select("doc_id", words(F.col("text")).alias("_w"))
    rows = rows.select("doc_id", F.explode(hashed_runs(F.col("_w"), _widths(sketch))).alias("h"))
    hits = rows.join(small(sketch.select("h", "item_id", "need"), 56), "h").distinct()
    return hits.groupBy("doc_id", "item_id", "need").agg(F.count(F.lit(1)).alias("hits")).filter("hits >= need").select("doc_id", "item_id")


def matched(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Distinct (doc_id, shingle) of the wanted shingles (h, width, shingle) that occur in docs; words are put together only at places whose hash is wanted."""
    texts = docs.select("doc_id", F.xxhash64("text").alias("_tie"), words(F.col("text")).alias("_w"))
    found = None
    for k in _widths(wanted):
        hashes = small(wanted.filter(F.col("width") == k).select("h").distinct(), 24)
        places = texts.select("doc_id", "_tie", F.posexplode(hashed_runs(F.col("_w"), [k])).alias("_at", "h")).join(hashes, "h", "left_semi")
        # rows of one doc_id and text have the same places; other rows keep theirs apart
        lists = places.groupBy("doc_id", "_tie").agg(F.collect_set(F.col("_at") + 1).alias("_places")).select(F.col("doc_id").alias("_doc"), F.col("_tie").alias("_text"), "_places")
        met = texts.join(lists, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_tie") == F.col("_text")))
        some = met.select("doc_id", F.explode(F.transform("_places", lambda at: F.concat_ws(" ", F.slice("_w", at, k)))).alias("shingle")).distinct()  # noqa: B023
        found = some if found is None else found.unionByName(some)
    return found


def contained(docs: DataFrame, items: DataFrame, percent: int = PERCENT, exact: bool = False) -> DataFrame:
    """doc_id, item_id, n_shingles, shared, containment for every item contained in a document."""
    docs = docs.select("doc_id", "text").filter("text is not null")
    shingles = saved(item_shingles(items))
    found = saved(candidates(docs, sketches(shingles, percent, exact)))
    texts = saved(joined(docs, small(found.select("doc_id").distinct(), 64), "doc_id", "left_semi"))
    wanted = saved(joined(shingles, small(found.select("item_id").distinct(), 48), "item_id", "left_semi"))
    has = matched(texts, wanted)
    if has is None:
        has = texts.select("doc_id", F.lit("").alias("shingle")).limit(0)
    each = has.join(small(wanted.select("item_id", "n", "shingle"), 64 + F.octet_length("shingle")), "shingle")
    # an item that shares shingles with one found elsewhere is a pair only where it was found itself
    pairs = found.select(F.col("doc_id").alias("_doc"), F.col("item_id").alias("_item"))
    each = each.join(small(pairs, 48), F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("item_id").eqNullSafe(F.col("_item")), "left_semi")
    out = each.groupBy("doc_id", "item_id", "n").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") * 100 >= F.col("n") * percent)
    return out.select("doc_id", "item_id", F.col("n").alias("n_shingles"), "shared", (F.col("shared") / F.col("n")).alias("containment"))


def op8_decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    return contained(docs, items)


SQL = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), i AS (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark
), want AS (
    SELECT DISTINCT item_id, least(len(w), 5) AS k, array_to_string(w[p : p + least(len(w), 5) - 1], ' ') AS s
    FROM i, unnest(range(1, greatest(len(w) - 3, 2))) AS t(p) WHERE len(w) > 0
), sizes AS (
    SELECT item_id, count(*) AS n FROM want GROUP BY item_id
), widths AS (
    SELECT DISTINCT k FROM want
), has AS (
    SELECT DISTINCT doc_id, k, array_to_string(w[p : p + k - 1], ' ') AS s
    FROM d, widths, unnest(range(1, len(w) - k + 2)) AS t(p) WHERE len(w) >= k
)
SELECT doc_id, item_id, n AS n_shingles, count(*) AS shared, count(*) / n::DOUBLE AS containment
FROM has JOIN want USING (k, s) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id, n HAVING count(*) * 100 >= n * 75
"""
