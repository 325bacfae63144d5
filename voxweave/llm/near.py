"""N-gram Jaccard join by T-occurrence search.

Two documents link when the Jaccard similarity of their sets of five-word shingles is at least PERCENT / 100.
A document of n shingles can link only with one that holds at least T = ceil(n * PERCENT / 100) of them.
The work is done in steps that each lose no link:

1. *Occurrences.* Every shingle goes to the inverted list of its hash, in blocks of a few bytes an entry. A
   document stays only if at least T of its shingles lie in lists of other documents too. A block of documents
   sends each of its shingles once, however many of them hold it, so a shingle that all documents share has as many
   entries as there are blocks.
2. Equal sets among those that stay become one, and step 1 is done again over the sets, with exact lists.
   It gives each set its shared shingles ordered by the length of their lists, shortest first.
3. *Candidates.* The T - 1 longest lists of a set are left aside; a partner must appear in one of the rest.
   Within each of these lists sets are first paired with a few pivots of like size only.
4. *T-occurrence.* The partners of a pivot are indexed by the pivot's shingles, block by block. Short lists
   are merged by a heap, long ones probed by binary search (DivideSkip), and the partners that reach the
   overlap their sizes require are linked.
5. Linked sets form components. The sets that are connected by lists on which components still meet are dealt
   to blocks of about BLOCK_ENTRIES shingles, with an index each. Within a block, and from each block to those
   after it, a set is searched, as in 4, among the sets that do not yet lie in its component, be it by links of
   before or by those just found. So pairs within a group of copies are never all formed, and every component is
   whole. A set is sent to a block only if it shares such a list with one of its sets, or, where that makes fewer
   rows, to all blocks of its group.

Null and empty texts have no shingles and link with nothing. Rows with equal doc_id, and rows without one, are rows of
their own, however many there are: a set's text is fetched by doc_id and a hash of the text, so each row is met once.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxweave.llm.arrow import mapped
from voxweave.llm.components import components
from voxweave.llm.tables import discard, saved, small

PERCENT = 75
#: Documents and shingles that a block of step 1 holds, and entries that a bucket of lists should hold.
BLOCK_DOCS, BLOCK_SHINGLES, BUCKET_ENTRIES = 4096, 1_000_000, 250_000
#: Partners of one pivot that are searched together.
SEARCH_BLOCK = 256
#: Shingles of the sets of a block in the last search.
BLOCK_ENTRIES = 250_000
#: Rows of one list beyond which it is dealt to several tasks.
HOT_ROWS = 4096
#: In place of a document's number: a shingle that several documents of the block hold.
SEVERAL = 65535


def needed(n, percent: int = PERCENT):
    """The overlap that a document of n shingles needs with any partner: ceil(n * percent / 100)."""
    return -(-n * percent // 100)


class Index:
    """Inverted lists of the shingles of some sets: the numbers of the sets that hold a shingle, ascending."""

    def __init__(self, sets: list[np.ndarray]):
        of = np.repeat(np.arange(len(sets), dtype="i4"), [len(s) for s in sets])
        flat = np.concatenate(sets) if sets else np.zeros(0, "u8")
        order = np.argsort(flat, kind="stable")
        self.flat, self.of, self.n = flat[order], of[order], len(sets)

    def lists(self, query: np.ndarray, wanted: np.ndarray) -> list[np.ndarray]:
        """Of the query's shingles, the lists that are not empty, without the sets that are not wanted (a flag per set)."""
        begins, ends = np.searchsorted(self.flat, query, "left"), np.searchsorted(self.flat, query, "right")
        out = [self.of[a:b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True) if b > a]
        out = [x[wanted[x]] for x in out]
        return [x for x in out if len(x)]


def t_occurrence(query: np.ndarray, index: Index, required: np.ndarray, wanted: np.ndarray, mu: float = 0.01) -> np.ndarray:
    """The wanted sets of the index whose overlap with query reaches what is required of them (DivideSkip)."""
    none = np.zeros(0, "i8")
    if not wanted.any():
        return none
    lists = index.lists(query, wanted)
    lists.sort(key=len)
    least = int(required[wanted].min())
    if len(lists) < least:
        return none
    n_long = min(least - 1, int(least / (mu * math.log2(len(lists[-1]) + 1) + 1)))
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    floor = least - n_long
    # each set number in the short lists, ascending, with how often it occurs: a heap of the lists' heads
    entries = [x.tolist() for x in short]
    heap = [(x[0], k, 0) for k, x in enumerate(entries)]
    heapq.heapify(heap)
    found: list[int] = []
    counts: list[int] = []
    while heap:
        top, times = heap[0][0], 0
        while heap and heap[0][0] == top:
            _, k, i = heap[0]
            times += 1
            if i + 1 < len(entries[k]):
                heapq.heapreplace(heap, (entries[k][i + 1], k, i + 1))
            else:
                heapq.heappop(heap)
        if times >= floor:
            found.append(top)
            counts.append(times)
    total, members = np.array(counts, "i8"), np.array(found, "i8")
    for x in long:
        if len(members):
            spot = np.searchsorted(x, members)
            spot[spot == len(x)] = 0
            total += x[spot] == members
    return members[total >= required[members]] if len(members) else none


def _record(cols, names, kinds):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


ENTRY = "bucket int, src long, kind int, a binary, b binary"


class _Block:
    """Rows of ENTRY for a block of sets: its sets' own rows (kind 0) and its entries of each bucket (kind 1)."""

    def __init__(self, buckets: int, whole: bool):
        self.buckets, self.whole = buckets, whole
        self.sets: list[np.ndarray] = []
        self.heads: list[tuple[int, int, int]] = []
        self.size = 0

    def add(self, hashes: np.ndarray, head: tuple[int, int, int]) -> None:
        self.sets.append(hashes)
        self.heads.append(head)
        self.size += len(hashes)

    def full(self) -> bool:
        return len(self.sets) >= BLOCK_DOCS or self.size >= BLOCK_SHINGLES

    def rows(self, src: int):
        import pyarrow as pa

        heads = np.array(self.heads, "i8")
        flat = np.concatenate(self.sets) if self.sets else np.zeros(0, "u8")
        each, at, back, times = np.unique(flat, return_index=True, return_inverse=True, return_counts=True)
        bucket = _bucket(each, self.buckets)
        order = np.argsort(bucket.astype("u2") if self.buckets < 65536 else bucket, kind="stable")
        bucket = bucket[order]
        # step 1 needs no more than 24 bits: a clash of two shingles only makes a list look longer
        low = each[order].astype("<u8").view("u1").reshape(-1, 8)[:, : 8 if self.whole else 3]
        if self.whole:
            note = times[order].astype("<u4")
        else:
            of = np.repeat(np.arange(len(self.sets)), [len(s) for s in self.sets])
            note = np.where(times > 1, SEVERAL, of[at])[order].astype("<u2")
            # those that several documents here hold are shared, whatever other blocks have
            heads = np.column_stack([heads, np.bincount(of[times[back] > 1], minlength=len(self.sets))])
        here, starts = np.unique(bucket, return_index=True)
        ends = np.append(starts[1:], len(bucket))
        n = len(here) + 1
        spans = list(zip(starts.tolist(), ends.tolist(), strict=True))
        a = [heads.tobytes()] + [low[i:j].tobytes() for i, j in spans]
        b = [flat.tobytes() if self.whole else b""] + [note[i:j].tobytes() for i, j in spans]
        yield _record([[src * 2654435761 % 4294967291 % self.buckets, *here.tolist()], [src] * n, [0] + [1] * len(here), a, b], ["bucket", "src", "kind", "a", "b"], [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()])


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype("u4")


def _blocks(sets, buckets: int, whole: bool):
    """sets yields (hashes, head); blocks are numbered within the task's partition."""
    from pyspark import TaskContext

    src = TaskContext.get().partitionId() << 24
    block = _Block(buckets, whole)
    for hashes, head in sets:
        block.add(hashes, head)
        if block.full():
            yield from block.rows(src)
            src += 1
            block = _Block(buckets, whole)
    if block.sets:
        yield from block.rows(src)


def _lists(batches, whole: bool):
    """Rows of ENTRY, ordered by bucket -> what their blocks need to know of the lists that more than one set shares.

    Step 1: the documents that the block's entries stand for, and how many of each one's are shared. Else: the
    hashes, and the lengths of their lists.
    """
    import pyarrow as pa

    names, kinds = ["src", "kind", "a", "b"], [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    width = 8 if whole else 3

    def bucket(rows):
        if not rows:
            return
        low = np.zeros((sum(len(a) for _, a, _ in rows) // width, 8), "u1")
        low[:, :width] = np.concatenate([np.frombuffer(a, "u1") for _, a, _ in rows]).reshape(-1, width)
        low = low.view("<u8").ravel()
        notes = [np.frombuffer(b, "<u4" if whole else "<u2") for _, _, b in rows]
        weight = np.concatenate(notes).astype("i8")
        if not whole:
            weight = np.where(weight == SEVERAL, 2, 1)
        order = np.argsort(low, kind="stable")
        ordered = low[order]
        starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        sizes = np.empty(len(low), "<u4")
        sizes[order] = np.repeat(np.add.reduceat(weight[order], starts), np.diff(np.append(starts, len(low))))
        at = 0
        out: list[list] = [[], [], [], []]
        for (src, _, _), note in zip(rows, notes, strict=True):
            mine = sizes[at : at + len(note)]
            shared = mine > 1 if whole else (mine > 1) & (note != SEVERAL)
            if shared.any():
                out[0].append(src)
                out[1].append(1)
                if whole:
                    out[2].append(low[at : at + len(note)][shared].tobytes())
                    out[3].append(mine[shared].tobytes())
                else:
                    docs, times = np.unique(note[shared], return_counts=True)
                    out[2].append(docs.tobytes())
                    out[3].append(times.astype("<u4").tobytes())
            at += len(note)
        if out[0]:
            yield _record(out, names, kinds)

    now, rows = None, []
    for batch in batches:
        of, src, kind, a, b = (c.to_pylist() for c in batch.columns)
        for k in range(len(of)):
            if kind[k] == 0:
                yield _record([[src[k]], [0], [a[k]], [b[k]]], names, kinds)
                continue
            if of[k] != now:
                yield from bucket(rows)
                now, rows = of[k], []
            rows.append((src[k], a[k], b[k]))
    yield from bucket(rows)


def _by_src(batches):
    """Groups rows (src, kind, a, b), ordered by src and kind: the block's own row, then what came back to it."""
    now, own, back = None, None, []
    for batch in batches:
        src, kind, a, b = (c.to_pylist() for c in batch.columns)
        for k in range(len(src)):
            if src[k] != now:
                if own:
                    yield (*own, back)
                now, own, back = src[k], None, []
            if kind[k] == 0:
                own = (a[k], b[k])
            else:
                back.append((a[k], b[k]))
    if own:
        yield (*own, back)


def _exchange(entries: DataFrame, whole: bool) -> DataFrame:
    lists = entries.repartition("bucket").sortWithinPartitions("bucket")
    lists = mapped(lists, lambda it: _lists(it, whole), "src long, kind int, a binary, b binary")
    return lists.repartition("src").sortWithinPartitions("src", "kind")


def shared_counts(docs: DataFrame) -> DataFrame:
    """Step 1: doc_id, tie (a hash of the text), n, node (the digest of its set) and shared, the number of its shingles that other rows have too."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(256, size // (6 * BUCKET_ENTRIES))

    def scan(batches):
        from voxweave.llm.shingles import column_sets, set_digest

        def sets():
            for batch in batches:
                ids, ties = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for doc, tie, hashes in zip(ids, ties, column_sets(batch.column(2)), strict=True):
                    yield hashes, (doc or 0, 2 * len(hashes) + (doc is None), set_digest(hashes), tie)

        yield from _blocks(sets(), buckets, False)

    def counted(batches):
        import pyarrow as pa

        for a, _, back in _by_src(batches):
            heads = np.frombuffer(a, "i8").reshape(-1, 5)
            shared = heads[:, 4].copy()
            for of, times in back:
                shared[np.frombuffer(of, "u2")] += np.frombuffer(times, "u4")
            docs = pa.array(heads[:, 0], pa.int64(), mask=heads[:, 1] % 2 == 1)
            yield _record([docs, heads[:, 3], heads[:, 1] // 2, heads[:, 2], shared], ["doc_id", "tie", "n", "node", "shared"], [pa.int64()] * 5)

    return mapped(_exchange(mapped(keyed(docs), scan, ENTRY), False), counted, "doc_id long, tie long, n long, node long, shared long")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, tie (a hash of the text), text."""
    return docs.selectExpr("cast(doc_id as long) as doc_id", "xxhash64(text) as tie", "text")


def set_texts(docs: DataFrame, counts: DataFrame) -> tuple[DataFrame, int]:
    """node, text of one row of each node of counts (doc_id, tie, node), and the number of nodes."""
    each = counts.groupBy("node", "doc_id", "tie").agg(F.count(F.lit(1)).alias("rows"))
    reps = saved(each.groupBy("node").agg(F.min(F.struct("doc_id", "tie", "rows")).alias("rep")).select("node", F.col("rep.doc_id").alias("rep"), F.col("rep.tie").alias("rep_tie"), "rep.rows"))
    found = keyed(docs).join(small(reps, 64), F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("tie") == F.col("rep_tie"))).select("node", "rows", "text")
    if not reps.filter("rows > 1").isEmpty():  # rows that are alike in both stand for one set
        found = found.filter("rows = 1").unionByName(found.filter("rows > 1").dropDuplicates(["node"]))
    return found.select("node", "text"), reps.count()


def shared_sets(docs: DataFrame, counts: DataFrame, percent: int) -> DataFrame:
    """Step 2: one row per distinct set that may have a partner: node, n, its shared shingles by list length, and how many of those to search.

    The last column, ``first``, is n - T + 1 less the shingles that no other set has.
    """
    left = counts.filter((F.col("n") > 0) & (F.col("shared") * 100 >= F.col("n") * percent))
    size = left.agg(F.sum("n")).first()[0] or 0
    buckets = max(64, size // BUCKET_ENTRIES)
    texts, _ = set_texts(docs, left)

    def scan(batches):
        from voxweave.llm.shingles import column_sets

        def sets():
            for batch in batches:
                nodes = batch.column(0).to_pylist()
                for node, hashes in zip(nodes, column_sets(batch.column(1)), strict=True):
                    yield hashes, (node, len(hashes), 0)

        yield from _blocks(sets(), buckets, True)

    def ordered(batches):
        import pyarrow as pa

        for a, whole, back in _by_src(batches):
            heads = np.frombuffer(a, "i8").reshape(-1, 3)
            if not back:
                continue
            flat = np.frombuffer(whole, "u8")
            known = np.concatenate([np.frombuffer(x, "<u8") for x, _ in back])
            length = np.concatenate([np.frombuffer(y, "<u4") for _, y in back])
            by = np.argsort(known)
            known, length = known[by], length[by]
            spot = np.minimum(np.searchsorted(known, flat), len(known) - 1)
            shared = known[spot] == flat
            of = np.repeat(np.arange(len(heads)), heads[:, 1])[shared]
            low, sizes = flat[shared], length[spot[shared]]
            order = np.lexsort((low, sizes, of))
            of, low = of[order], low[order]
            bounds = np.searchsorted(of, np.arange(len(heads) + 1))
            out: list[list] = [[], [], [], []]
            for k, (node, n, _) in enumerate(heads.tolist()):
                mine = low[bounds[k] : bounds[k + 1]]
                t = needed(n, percent)
                if len(mine) >= t:
                    out[0].append(node)
                    out[1].append(n)
                    out[2].append(mine.tobytes())
                    out[3].append(n - t + 1 - (n - len(mine)))
            if out[0]:
                yield _record(out, ["node", "n", "shingles", "first"], [pa.int64(), pa.int64(), pa.binary(), pa.int32()])

    found = _exchange(mapped(texts, scan, ENTRY), True)
    return mapped(found, ordered, "node long, n long, shingles binary, first int")


def search_lists(sets: DataFrame) -> DataFrame:
    """Step 3: one row per set and list that is searched: h, node, n."""

    def listed(batches):
        import pyarrow as pa

        for batch in batches:
            node, n, shingles, first = (c.to_pylist() for c in batch.columns)
            hs = [np.frombuffer(s[: 8 * f], "i8") for s, f in zip(shingles, first, strict=True)]
            counts = [len(h) for h in hs]
            if sum(counts):
                yield _record([np.concatenate(hs), np.repeat(np.array(node, "i8"), counts), np.repeat(np.array(n, "i8"), counts)], ["h", "node", "n"], [pa.int64()] * 3)

    return mapped(sets, listed, "h long, node long, n long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Step 4: the pairs (a, b) whose sets reach the similarity; a is the pivot, whose row meets its partners in blocks."""
    salted = saved(pairs.withColumn("block", F.pmod(F.xxhash64("b"), F.lit(64)).cast("int")))
    pivots = small(salted.select("a", "block").distinct(), 48)
    salted = small(salted, 48)
    own = pivots.join(sets.select(F.col("node").alias("a"), "n", "shingles"), "a").select("a", "block", F.lit(0).alias("kind"), F.col("a").alias("b"), "n", "shingles")
    partners = salted.join(sets.select(F.col("node").alias("b"), "n", "shingles"), "b").select("a", "block", F.lit(1).alias("kind"), "b", "n", "shingles")
    rows = own.unionByName(partners).repartition("a", "block").sortWithinPartitions("a", "block", "kind", "b")

    def searched(batches):
        import pyarrow as pa

        query, n_query, node = None, 0, 0
        sets: list[np.ndarray] = []
        required: list[int] = []
        others: list[int] = []

        def flush():
            got = t_occurrence(query, Index(sets), np.array(required), np.ones(len(sets), bool))
            linked = [others[k] for k in got.tolist()]
            sets.clear(), required.clear(), others.clear()
            return _record([[node] * len(linked), linked], ["a", "b"], [pa.int64()] * 2)

        for batch in batches:
            for a, _, kind, b, n, shingles in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    if others:
                        yield flush()
                    query, n_query, node = np.sort(np.frombuffer(shingles, "u8")), n, a
                else:
                    sets.append(np.frombuffer(shingles, "u8"))
                    # |A and B| >= p / (100 + p) * (|A| + |B|)
                    required.append(max(1, -(-percent * (n + n_query) // (100 + percent))))
                    others.append(b)
                    if len(others) >= SEARCH_BLOCK:
                        yield flush()
        if others:
            yield flush()

    return mapped(rows, searched, "a long, b long")


def met(rows: DataFrame, others: DataFrame, on: list[str], counts: DataFrame, how: str = "inner") -> DataFrame:
    """rows.join(others, on, how), with keys that have more than HOT_ROWS rows dealt to several tasks by node, others' rows to each.

    counts: the keys, and ``rows`` of each; it is read twice.
    """
    hot = counts.filter(F.col("rows") > HOT_ROWS).select(*on, F.ceil(F.col("rows") / HOT_ROWS).cast("int").alias("_parts"))
    if hot.isEmpty():
        return rows.join(others, on, how)
    hot, parts = small(hot, 32), F.coalesce("_parts", F.lit(1))
    left = rows.join(hot, on, "left").withColumn("_part", F.pmod(F.xxhash64(F.lit(1), "node"), parts).cast("int")).drop("_parts")
    right = others.join(hot, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return left.join(right, [*on, "_part"], how).drop("_part")


def _pivot_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Each set of a list with the list's pivots in its band of sizes and the bands beside it."""
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent)).cast("int")
    rows = lists.select("h", "node", "n", band.alias("band"))
    each = saved(rows.groupBy("h", "band").agg(F.min("node").alias("p0"), F.min_by("node", F.xxhash64("node")).alias("p1"), F.count(F.lit(1)).alias("rows")))
    pivots = each.select("h", "band", F.explode(F.array_distinct(F.array("p0", "p1"))).alias("a"))
    pivots = pivots.select("h", F.explode(F.array(F.col("band") - 1, F.col("band"))).alias("band"), "a")
    return met(rows, pivots, ["h", "band"], each).filter("a <> node").select(F.least("a", "node").alias("x"), F.greatest("a", "node").alias("y")).distinct()


def _open(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of lists on which more than one component meets, with their roots."""
    within = lists.join(roots, "node", "left").select("h", "node", "n", F.coalesce("root", "node").alias("root"))
    mixed = saved(within.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("rows")).filter("low <> high").select("h", "rows"))
    return met(within, mixed.select("h"), ["h"], mixed, "left_semi")


def _placed(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """node, group (sets connected by lists of rows), block, blocks of the group, and its sets."""
    least = saved(rows.groupBy("h").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("rows")))
    groups = components(met(rows, least.drop("rows"), ["h"], least).select("a", F.col("node").alias("b")).distinct()).withColumnRenamed("root", "group")
    sized = saved(groups.join(sets.select("node", (F.octet_length("shingles") / 8).alias("entries")), "node"))
    sizes = sized.groupBy("group").agg(F.ceil(F.sum("entries") / BLOCK_ENTRIES).cast("int").alias("blocks"), F.count(F.lit(1)).alias("members"))
    return sized.join(sizes, "group").select("node", "group", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"), "blocks", "members")


def _asked(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """node, group, block: the blocks after its own in which each set of a group of several blocks is to be searched."""
    several = placed.filter("blocks > 1")
    at = saved(rows.select("h", "node").join(several, "node"))
    lists = at.groupBy("h", "group", "blocks", "members").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("block").alias("here"))
    cost = lists.groupBy("group", "blocks", "members").agg(F.sum(F.col("n") * F.col("here")).alias("by_list"))
    by_list = saved(cost.filter(F.col("by_list") < F.col("members") * F.col("blocks")).select("group"))
    later = F.when(F.col("block") + 1 < F.col("blocks"), F.sequence(F.col("block") + 1, F.col("blocks") - 1)).otherwise(F.array().cast("array<int>"))
    every = several.join(by_list, "group", "left_anti").select("node", "group", F.explode(later).alias("block"))
    some = at.join(by_list, "group", "left_semi").select("h", "node", "group", "block")
    meets = some.select("h", "group", F.col("block").alias("to")).distinct()
    listed = some.join(meets, ["h", "group"]).filter("to > block").select("node", "group", F.col("to").alias("block")).distinct()
    return every.unionByName(listed)


def block_links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Step 5's last search: links (a, b) that join the components which sets that share a list of rows (h, node, n, root) make up."""
    placed = saved(_placed(rows, sets))
    known = saved(small(rows.select("node", "root").distinct(), 48).join(sets, "node").select("node", "root", "n", "shingles"))
    members = placed.join(known, "node").select("group", "block", F.lit(0).alias("kind"), "node", "root", "n", "shingles")
    queries = _asked(rows, placed).join(known, "node").select("group", "block", F.lit(1).alias("kind"), "node", "root", "n", "shingles")
    dealt = members.unionByName(queries).repartition("group", "block").sortWithinPartitions("group", "block", "kind", "node")

    def searched(batches):
        key, held = None, []
        block: _SearchBlock | None = None
        for batch in batches:
            out: list[list[int]] = [[], []]
            for group, at, kind, node, root, n, shingles in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (group, at) != key:
                    _within(held, block, percent, out)
                    key, held, block = (group, at), [], None
                if kind == 0:
                    held.append((node, root, n, np.frombuffer(shingles, "u8")))
                elif block := _within(held, block, percent, out):  # a block may be empty
                    block.search(node, root, n, np.frombuffer(shingles, "u8"), out)
            if out[0]:
                yield _links(out)
        out = [[], []]
        _within(held, block, percent, out)
        yield _links(out)

    return mapped(dealt, searched, "a long, b long")


def _links(out: list[list[int]]):
    import pyarrow as pa

    return _record(out, ["a", "b"], [pa.int64()] * 2)


def _within(held: list, block: _SearchBlock | None, percent: int, out: list[list[int]]) -> _SearchBlock | None:
    """The block of the sets held, searched within once when it is made."""
    if block is None and held:
        block = _SearchBlock(held, percent)
        for k, (node, root, n, shingles) in enumerate(held):
            block.search(node, root, n, shingles, out, k + 1)
    return block


class _SearchBlock:
    """Sets with an index, and the components that are known or found here."""

    def __init__(self, held: list, percent: int):
        self.nodes, self.sizes, self.percent = [x[0] for x in held], np.array([x[2] for x in held], "i8"), percent
        self.index = Index([x[3] for x in held])
        self.number: dict[int, int] = {}
        self.root = np.array([self.number.setdefault(x[1], len(self.number)) for x in held], "i8")
        self.now = {k: k for k in range(len(self.number))}

    def search(self, node: int, root: int, n: int, shingles: np.ndarray, out: list[list[int]], first: int = 0) -> None:
        """Adds a link from the set to one set of each component that it links with, among the sets from the first on."""
        mine = self.number.setdefault(root, len(self.number))
        mine = self.now.setdefault(mine, mine)
        wanted = (self.root != mine) & (np.minimum(self.sizes, n) * 100 >= np.maximum(self.sizes, n) * self.percent)
        wanted[:first] = False
        # |A and B| >= p / (100 + p) * (|A| + |B|)
        required = np.maximum(1, -(-self.percent * (n + self.sizes) // (100 + self.percent)))
        for k in t_occurrence(shingles, self.index, required, wanted).tolist():
            other = int(self.root[k])
            if other != mine:
                out[0].append(node)
                out[1].append(self.nodes[k])
                self.root[self.root == other] = mine
                for name, now in self.now.items():
                    if now == other:
                        self.now[name] = mine


def _oriented(pairs: DataFrame) -> DataFrame:
    """Pairs (x, y) with the end that occurs more often as the pivot a."""
    ends = pairs.select(F.col("x").alias("e")).unionByName(pairs.select(F.col("y").alias("e"))).groupBy("e").agg(F.count(F.lit(1)).alias("c"))
    both = pairs.join(ends.select(F.col("e").alias("x"), F.col("c").alias("cx")), "x").join(ends.select(F.col("e").alias("y"), F.col("c").alias("cy")), "y")
    return both.select(F.when(F.col("cx") >= F.col("cy"), F.col("x")).otherwise(F.col("y")).alias("a"), F.when(F.col("cx") >= F.col("cy"), F.col("y")).otherwise(F.col("x")).alias("b"))


def linked(lists: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """node, root of the sets that link with others on any of the lists (h, node, n), which sets (node, n, shingles) decide; root is the component's least node."""
    pairs = saved(_pivot_pairs(lists, percent))
    oriented = saved(_oriented(pairs))
    links = saved(verified(oriented, sets, percent))
    roots = saved(components(links))
    rows = saved(_open(lists, roots))
    if not rows.isEmpty():
        more = saved(block_links(rows, sets, percent))
        if not more.isEmpty():
            before, roots = roots, saved(components(links.unionByName(more)))
            discard(before)
        discard(more)
    discard(pairs, oriented, links, rows)
    return roots.select("node", "root")


def with_components(counts: DataFrame, roots: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of the rows of counts (doc_id, n, node)."""
    lone = counts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = lone.filter("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return lone.join(least, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def near_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id it links with, over any number of links)."""
    counts = saved(shared_counts(docs))
    sets = saved(shared_sets(docs, counts, percent))
    lists = saved(search_lists(sets))
    roots = linked(lists, sets, percent)
    discard(sets, lists)
    return with_components(counts, roots)


def op2_ngram_join(docs: DataFrame) -> DataFrame:
    return near_components(docs)
