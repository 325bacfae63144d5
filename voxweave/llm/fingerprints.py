"""Document fingerprints: a homomorphic multiset hash over paragraphs.

Every paragraph (a line of the text) is hashed to one wide vector, and a document's fingerprint is the
sum of its paragraphs' vectors, each lane modulo a power of two. The sum does not depend on the order of
paragraphs, and paragraphs are inserted or deleted by adding or subtracting their vectors.

A vector has three parts:

- ``EQUAL_LANES`` lanes modulo 2**32, drawn from the SHA-256 digest of the whole paragraph. They decide
  equality of the multisets of paragraphs.
- one lane modulo 2**32 that counts the paragraph's runs of ``RUN_WORDS`` words, one from every word that has
  as many after it (a paragraph of fewer words is one run), and
- ``SKETCH_LANES`` lanes modulo 2**30 that count the runs whose hash has a given bit set. Centred by the
  count they are a sum of random signs (an AMS sketch), so the cosine of two fingerprints estimates the
  likeness of the texts, with a standard error near ``SKETCH_LANES ** -0.5``.

Null text counts as empty. An empty text has one empty paragraph. Repeated rows are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxweave.llm.tables import KEY, id_ranges, saved, small

EQUAL_LANES = 16
#: Hashes of a run, and how their bits are packed while they are summed: two lanes to a long, 30 bits apart.
HASHES, PACKED, STRIDE = 2, 2, 30
SKETCH_LANES = HASHES * PACKED * STRIDE
RUN_WORDS = 4
MASK = (1 << 32) - 1


def _runs(paragraph: Column) -> Column:
    """All runs of RUN_WORDS words, overlapping; a shorter paragraph is one run, and one without words has none."""
    more = RUN_WORDS - 1
    every = F.regexp_extract_all(paragraph, F.lit(rf"(?<!\S)(?=(\S++(?:\s++\S++){{{more}}}))"), F.lit(1))
    return F.when(paragraph.rlike(rf"(?:\S++\s++){{{more}}}\S"), every).otherwise(F.regexp_extract_all(paragraph, F.lit(r"(?s)\S.*+"), F.lit(0)))


def _equality_sums() -> list[Column]:
    """_digest is null on all but one row of a paragraph."""
    lane = lambda i: F.xxhash64(F.col("_digest"), F.lit(i)).bitwiseAND(F.lit(MASK))
    return [F.sum(F.when(F.col("_digest").isNotNull(), lane(i)).otherwise(F.lit(0))).alias(f"e{i}") for i in range(EQUAL_LANES)]


def _packed_sums() -> list[Column]:
    """Sums of PACKED sketch lanes each: the lanes of bits b, b + STRIDE, ... of a run's hash lie STRIDE bits apart."""
    every = sum(1 << (STRIDE * k) for k in range(PACKED))
    return [F.sum(F.shiftright(f"_hash{w}", b).bitwiseAND(F.lit(every))).alias(f"s{w}_{b}") for w in range(HASHES) for b in range(STRIDE)]


def fingerprint(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row per combination of keys with ``lanes`` array<bigint>; the keys must identify a row.

    If rows are already dealt by some of the keys, the sums need no further shuffle.
    """
    paragraphs = rows.select(*keys, F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("_par"))
    paragraphs = paragraphs.select(*keys, F.sha2("_par", 256).alias("_digest"), _runs(F.col("_par")).alias("_runs"))
    runs = paragraphs.select(*keys, "_digest", F.posexplode_outer("_runs").alias("_at", "_run"))
    first = F.coalesce(F.col("_at"), F.lit(0)) == 0
    runs = runs.select(
        *keys,
        F.when(first, F.col("_digest")).alias("_digest"),
        F.col("_run").isNotNull().cast("long").alias("_one"),
        *[F.when(F.col("_run").isNotNull(), F.xxhash64(F.rtrim("_run"), F.lit(w))).otherwise(F.lit(0)).alias(f"_hash{w}") for w in range(HASHES)],
    )
    summed = runs.groupBy(*keys).agg(*_equality_sums(), F.sum("_one").alias("runs"), *_packed_sums())
    low = F.lit((1 << STRIDE) - 1)
    lanes = [F.col(f"e{i}").bitwiseAND(F.lit(MASK)) for i in range(EQUAL_LANES)] + [F.col("runs")]
    lanes += [F.shiftright(f"s{w}_{b}", STRIDE * k).bitwiseAND(low) for w in range(HASHES) for k in range(PACKED) for b in range(STRIDE)]
    return summed.select(*keys, F.array(*lanes).alias("lanes"))


def _numbered(lanes: Column) -> Column:
    return F.transform(lanes, lambda v, i: F.struct(v.alias("v"), i.alias("i")))


def _modulus(i: Column) -> Column:
    return F.when(i <= EQUAL_LANES, F.lit(MASK)).otherwise(F.lit((1 << STRIDE) - 1))


def combined(a: Column, b: Column) -> Column:
    """The fingerprint of the union of two multisets of paragraphs."""
    return F.zip_with(_numbered(a), b, lambda x, y: (x.v + y).bitwiseAND(_modulus(x.i)))


def removed(a: Column, b: Column) -> Column:
    """The fingerprint of a without the paragraphs of b."""
    return F.zip_with(_numbered(a), b, lambda x, y: (x.v - y).bitwiseAND(_modulus(x.i)))


def as_text(lanes: Column) -> Column:
    """Equality lanes as eight hex digits each, then the counts, in base 10."""
    equal = F.array_join(F.transform(F.slice(lanes, 1, EQUAL_LANES), lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")
    return F.concat(equal, F.lit(":"), F.array_join(F.slice(lanes, EQUAL_LANES + 1, SKETCH_LANES + 1), ","))


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1; 1 for equal fingerprints, and 0 where just one of them is of an empty text."""

    def centred(lanes: Column) -> Column:
        runs = F.element_at(lanes, EQUAL_LANES + 1)
        return F.transform(F.slice(lanes, EQUAL_LANES + 2, SKETCH_LANES), lambda x: (2 * x - runs).cast("double"))

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)

    x, y = centred(a), centred(b)
    norm = F.sqrt(dot(x, x) * dot(y, y))
    cosine = F.when(norm > 0, dot(x, y) / norm).otherwise(F.lit(0.0))
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each document beside a copy whose last third is taken from its neighbour in descending doc_id.

    docs needs doc_id and text. The documents are dealt by ranges of doc_id; each range also gets a ghost
    of the first document of the range below it (the lowest wraps round to the highest), so that every
    neighbour is found inside one range and texts are shuffled once. Ties of doc_id go by a hash of the text and
    then by row, and rows without a doc_id come last, so that no repeated or missing id makes a range large.
    """
    rows, n = id_ranges(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    # the first document of each range; as many rows as there are ranges
    tops = saved(rows.groupBy("range").agg(F.max(F.struct(*KEY)).alias("top")))
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("range"))
    whole = Window.partitionBy(F.lit(0)).orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tops = tops.select(F.col("range").alias("r"), "top", F.coalesce(F.lag("range").over(w), F.last("range").over(whole)).alias("to"))
    is_top = (F.col("range") == F.col("r")) & (F.col("_has") == F.col("top._has")) & (F.col("_id") == F.col("top._id")) & (F.col("_tie") == F.col("top._tie"))
    ghosts = rows.join(small(tops, 64), is_top).groupBy("to").agg(F.max(F.struct("doc_id", "text")).alias("m"))
    ghosts = ghosts.select("m.doc_id", "m.text", F.col("to").alias("range"), *[F.lit(0).cast(rows.schema[k].dataType).alias(k) for k in KEY], F.lit(1).alias("ghost"))
    both = rows.withColumn("ghost", F.lit(0)).unionByName(ghosts).repartitionByRange(n, "range")
    order = Window.partitionBy("range").orderBy("ghost", *[F.desc(k) for k in KEY])
    both = both.select("*", F.row_number().over(order).alias("at"), F.lead("text").over(order).alias("after"))
    edited = F.concat(F.expr("left(text, char_length(text) - char_length(text) div 3)"), F.expr("left(after, char_length(text) div 3)"))
    both = both.select("range", "at", "ghost", "doc_id", F.char_length("text").cast("long").alias("n_chars"), "text", F.when(F.col("ghost") == 0, edited).alias("edited"))
    both = both.withColumn("edited_sha256", F.sha2("edited", 256))
    keys = ["range", "at", "kind", "ghost", "doc_id", "n_chars", "edited_sha256"]
    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("body")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("body")))
    bodies = both.select("range", "at", "ghost", "doc_id", "n_chars", "edited_sha256", F.explode(kinds).alias("k"))
    bodies = bodies.select("range", "at", F.col("k.kind").alias("kind"), "ghost", "doc_id", "n_chars", "edited_sha256", F.col("k.body").alias("body")).filter("ghost = 0 or kind = 0")
    prints = fingerprint(bodies, keys, "body")
    by = Window.partitionBy("range").orderBy("at", "kind")
    out = prints.select("*", F.lead("lanes", 1).over(by).alias("edited_lanes"), F.lead("lanes", 2).over(by).alias("next_lanes")).filter("kind = 0 and ghost = 0")
    return out.select("doc_id", "n_chars", "edited_sha256", "lanes", "edited_lanes", "next_lanes")


def op1_fingerprints(docs: DataFrame) -> DataFrame:
    out = edited_fingerprints(docs)
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("lanes")).alias("fingerprint"),
        as_text(F.col("edited_lanes")).alias("edited_fingerprint"),
        likeness(F.col("lanes"), F.col("edited_lanes")).alias("near_edited"),
        likeness(F.col("lanes"), F.col("next_lanes")).alias("near_next"),
    )
