"""Merging the results of overlapping pieces back into one transcript.

results: source_id, idx, seq, start_ms, end_ms (from the piece's start), text, confidence; chunks: source_id,
idx, start_ms, end_ms, overlap_start_ms.
"""

from __future__ import annotations

from difflib import SequenceMatcher

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxweave.functions.text import word_list
from voxweave.shared import saved

#: Words of each side of a boundary that are compared, and the likeness from which they count as the same.
EDGE_WORDS, LIKENESS = 30, 0.82


def shifted(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """Results in the time of the whole source, with their chunk's overlap_start_ms and start (chunk_start_ms); every result's chunk must exist."""
    at = chunks.select("source_id", "idx", F.col("start_ms").alias("chunk_start_ms"), "overlap_start_ms")
    rows = results.join(at, ["source_id", "idx"], "left")
    start = F.when(F.col("chunk_start_ms").isNull(), F.raise_error(F.lit("a result has no chunk")).cast("long")).otherwise(F.col("chunk_start_ms"))
    return rows.withColumn("start_ms", F.col("start_ms") + start).withColumn("end_ms", F.col("end_ms") + start)


def without_start_overlap(moved: DataFrame) -> DataFrame:
    """Drops segments of a later chunk that end within its start overlap."""
    return moved.filter((F.col("idx") == 0) | (F.col("overlap_start_ms") == 0) | (F.col("end_ms") > F.col("chunk_start_ms") + F.col("overlap_start_ms")))


def edge_words(moved: DataFrame, n: int = EDGE_WORDS) -> DataFrame:
    """source_id, idx, head, tail: first and last n words of each chunk, in lower case."""
    words = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda s: word_list(s.text)))
    rows = moved.groupBy("source_id", "idx").agg(words.alias("w"))
    tail = F.slice("w", F.greatest(F.lit(1), F.size("w") - n + 1), n)
    return rows.select("source_id", "idx", F.lower(F.array_join(F.slice("w", 1, n), " ")).alias("head"), F.lower(F.array_join(tail, " ")).alias("tail"))


def accumulated_tails(moved: DataFrame, n: int = EDGE_WORDS) -> DataFrame:
    """source_id, idx, tail: the last n words of all that a source's chunks say up to each one, in lower case.

    A chunk with words has one at least, so no more than n chunks are looked back on.
    """
    rows = edge_words(moved, n).filter("tail <> ''").select("source_id", "idx", F.split("tail", " ").alias("w"))
    back = Window.partitionBy("source_id").orderBy("idx").rowsBetween(-(n - 1), 0)
    rows = rows.withColumn("w", F.flatten(F.collect_list("w").over(back)))
    return rows.select("source_id", "idx", F.array_join(F.slice("w", F.greatest(F.lit(1), F.size("w") - n + 1), n), " ").alias("tail"))


def likeness(a: str, b: str, autojunk: bool = True) -> float:
    return SequenceMatcher(None, a, b, autojunk=autojunk).ratio()


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by the bits of one integer."""
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    every = (1 << len(a)) - 1
    rest = every
    for c in b:
        taken = rest & places.get(c, 0)
        rest = (rest + taken | rest - taken) & every
    return len(a) - rest.bit_count()


def alike(a: str, b: str, autojunk: bool = True) -> bool:
    """Whether the likeness reaches LIKENESS. Matching blocks are a common subsequence, whose longest length is an upper bound, and soon found."""
    if 2 * common_length(a, b) < LIKENESS * (len(a) + len(b)):
        return False
    return likeness(a, b, autojunk) >= LIKENESS


#: Chunks of a source that are decided together.
STRETCH = 64


def chunk_edges(kept: DataFrame, n: int = EDGE_WORDS) -> DataFrame:
    """One row per chunk: source_id, idx, rows, and what the merge compares, in lower case.

    head, whole: its first and last n words; cut: its last n words without the segments that start within its overlap
    (the whole's, if that leaves no segment); cuts: whether a cut drops segments and leaves some.
    """
    late = F.col("start_ms") >= F.col("overlap_end_ms")
    words = lambda when: F.flatten(F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("seq", "text")))), lambda s: word_list(F.lower(s.text))))
    last = lambda w: F.slice(w, F.greatest(F.lit(1), F.size(w) - n + 1), n)
    rows = kept.groupBy("source_id", "idx").agg(words(F.lit(True)).alias("w"), words(late).alias("c"), F.count(F.lit(1)).alias("rows"), F.sum(late.cast("long")).alias("left"))
    left = F.when(F.col("left") > 0, F.col("c")).otherwise(F.col("w"))
    return rows.select("source_id", "idx", "rows", "left", F.slice("w", 1, n).alias("head"), last(F.col("w")).alias("whole"), last(left).alias("cut"), ((F.col("left") > 0) & (F.col("left") < F.col("rows"))).alias("cuts"))


def cut_chunks(edges: DataFrame, autojunk: bool = True, stretch: int = STRETCH, n: int = EDGE_WORDS) -> DataFrame:
    """source_id, idx of the chunks that lose their overlap in the merge.

    What a chunk keeps decides what the next is compared with. After a chunk of n words or more, whole or cut, there are
    just two states: its last words if it was kept whole, or if it was cut. Stretches of chunks end with such a chunk, about
    ``stretch`` apart. Each stretch is decided by itself for both states before it, which makes it a map from state to
    state; the maps of a source, two numbers each, are composed in order, and give each stretch the state that holds.
    """
    closing = (F.size("whole") >= n) & (F.size("cut") >= n) & (F.col("idx") % stretch == stretch - 1)
    before = Window.partitionBy("source_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    # a running sum of one flag per chunk
    ends = edges.select("source_id", "idx", closing.alias("closes")).withColumn("stretch", F.coalesce(F.sum(F.col("closes").cast("int")).over(before), F.lit(0)))
    rows = edges.join(ends, ["source_id", "idx"])
    own = rows.select("source_id", "stretch", "idx", "head", "whole", "cut", "cuts")
    given = rows.filter("closes").select("source_id", (F.col("stretch") + 1).alias("stretch"), F.lit(-1).cast(edges.schema["idx"].dataType).alias("idx"), "head", "whole", "cut", "cuts")
    kind = edges.schema["source_id"].dataType.simpleString()

    def decided(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values("idx")
        given, own = pdf[pdf.idx < 0], pdf[pdf.idx >= 0]
        starts = [(), ()] if given.empty else [tuple(given.whole.iloc[0]), tuple(given.cut.iloc[0])]
        known: dict[tuple[str, str], bool] = {}
        out = []
        for state, tail in enumerate(starts):
            if state and tail == starts[0]:  # both states say the same
                out.append((key[0], key[1], state, *out[0][3:]))
                break
            cut, ended = [], 0
            for idx, head, whole, left, cuts in zip(own.idx, own["head"], own.whole, own.cut, own.cuts):
                pair = (" ".join(tail), " ".join(head))
                if pair not in known:
                    known[pair] = bool(pair[0] and pair[1]) and alike(*pair, autojunk)
                ended = int(known[pair])
                if ended and cuts:
                    cut.append(int(idx))
                tail = (*tail, *(left if ended else whole))[-n:]
            out.append((key[0], key[1], state, ended, cut))
        return pd.DataFrame(out, columns=["source_id", "stretch", "state", "after", "cut"])

    each = saved(own.unionByName(given).groupBy("source_id", "stretch").applyInPandas(decided, f"source_id {kind}, stretch long, state int, after int, cut array<long>"))
    maps = each.groupBy("source_id", "stretch").agg(F.max(F.when(F.col("state") == 0, F.col("after"))).alias("of0"), F.max(F.when(F.col("state") == 1, F.col("after"))).alias("of1"))
    lists = maps.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("stretch", "of0", "of1"))).alias("maps"))
    # the state before each stretch: the composition of all maps before it, from the first state
    states = F.aggregate("maps", F.array(F.lit(0)), lambda acc, m: F.concat(acc, F.array(F.when(F.element_at(acc, -1) == 0, m.of0).otherwise(m.of1))))
    holds = lists.select("source_id", F.posexplode(states).alias("stretch", "state")).withColumn("stretch", F.col("stretch").cast("long"))
    return each.join(holds, ["source_id", "stretch", "state"]).select("source_id", F.explode("cut").alias("idx"))


def reassembled(results: DataFrame, chunks: DataFrame, autojunk: bool = True, stretch: int = STRETCH) -> DataFrame:
    """The merged segments: source_id, seq (from 0), idx, start_ms, end_ms, text, confidence.

    A chunk whose first words are like the last ones merged so far loses the segments that start within its
    overlap, unless that leaves none. Only edges of chunks are compared (see cut_chunks); segments stay where they are,
    and are numbered within their chunk, on top of the rows of the chunks before it.
    """
    kept = saved(without_start_overlap(shifted(results, chunks)).select("source_id", "idx", "seq", "start_ms", "end_ms", "text", "confidence", (F.col("chunk_start_ms") + F.col("overlap_start_ms")).alias("overlap_end_ms")))
    edges = saved(chunk_edges(kept))
    cut = saved(cut_chunks(edges, autojunk, stretch).withColumn("_cut", F.lit(True)))
    before = Window.partitionBy("source_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    sizes = edges.select("source_id", "idx", "rows", "left").join(cut, ["source_id", "idx"], "left").withColumn("n", F.when(F.col("_cut"), F.col("left")).otherwise(F.col("rows")))
    offsets = sizes.select("source_id", "idx", "_cut", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rows = kept.join(offsets, ["source_id", "idx"]).filter(F.col("_cut").isNull() | (F.col("start_ms") >= F.col("overlap_end_ms")))
    place = F.row_number().over(Window.partitionBy("source_id", "idx").orderBy("seq")) - 1
    return rows.select("source_id", (F.col("offset") + place).cast("long").alias("seq"), F.col("idx").cast("long").alias("idx"), "start_ms", "end_ms", "text", F.col("confidence").cast("double").alias("confidence"))


def headers(chunks: DataFrame, languages: DataFrame | None = None) -> DataFrame:
    """source_id, language, duration_ms, source: the end of a source's last chunk, and the language of its first result (languages: source_id, idx, language); es without one."""
    ends = chunks.groupBy("source_id").agg(F.max("end_ms").alias("duration_ms"))
    if languages is None:
        return ends.select("source_id", F.lit("es").alias("language"), "duration_ms", F.col("source_id").cast("string").alias("source"))
    first = languages.groupBy("source_id").agg(F.min_by("language", "idx").alias("language"))
    return ends.join(first, "source_id", "left").select("source_id", F.coalesce("language", F.lit("es")).alias("language"), "duration_ms", F.col("source_id").cast("string").alias("source"))


def matched(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """chunks, if each has a result (source_id, idx), which may have no segments; else an error when it is read."""
    have = results.select("source_id", "idx").distinct().withColumn("_has", F.lit(True))
    rows = chunks.join(have, ["source_id", "idx"], "left")
    return rows.filter(F.when(F.col("_has").isNull(), F.raise_error(F.lit("a chunk has no result")).cast("boolean")).otherwise(F.lit(True))).drop("_has")


def orphans(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """source_id, idx, n_segments of the results without a chunk, for which shifted and the merge fail."""
    return results.join(chunks.select("source_id", "idx"), ["source_id", "idx"], "left_anti").groupBy("source_id", "idx").agg(F.count(F.lit(1)).alias("n_segments"))


def concatenated(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """The merge before words are compared: all kept segments in order."""
    kept = without_start_overlap(shifted(results, chunks))
    order = Window.partitionBy("source_id").orderBy("idx", "seq")
    return kept.select("source_id", (F.row_number().over(order) - 1).cast("long").alias("seq"), "idx", "start_ms", "end_ms", "text")
