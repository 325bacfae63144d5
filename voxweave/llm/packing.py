"""Packing documents into fixed windows by the minimum-bin-slack method.

A document's ids, with an end id, are cut into whole windows and a rest. The rests of a pool of documents
are packed window by window: the longest rest goes in first, then a subset-sum dynamic program over the
remaining lengths, kept as the bits of one integer, finds the multiset of rests that fills the window
closest to its end; its counts are read back from the program's steps and used as often as the pool's
counts allow. Where no multiset fills a window, a rest is cut to fill it. What is left in the last window
of a pool is cut into lengths that are powers of two, which need no padding.

Pools do not span partitions, so nothing is shuffled, and a pool ends with the document that brings it to
``POOL`` documents or ``POOL_IDS`` ids. A window's number is the partition's number times 2**32 plus a count. Null text counts as empty: such a
document is its end id alone. Equal and repeated rows are packed one by one.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame

from voxweave.llm.arrow import mapped
from voxweave.llm.tokens import KEPT_PARTS

POOL, POOL_IDS = 4096, 4_000_000
WINDOW = 1024
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def fill(counts: dict[int, int], room: int, lengths: list[int] | None = None) -> list[tuple[int, int]]:
    """The multiset of lengths, as (length, count), whose sum comes closest to room without passing it; lengths: those that are left, ascending."""
    lengths = sorted(x for x, n in counts.items() if n) if lengths is None else lengths
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for k in range(bisect_right(lengths, room) - 1, -1, -1):
        length = lengths[k]
        left, take = min(counts[length], room // length), 1
        while left:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            take *= 2
        if reach >> room:
            break
    at, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return list(used.items())


def plan(rests: dict[int, list[int]], window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Windows as lists of (document, first id, length) in order; rests has the documents of each rest's length, and is emptied."""
    counts: dict[int, int] = {}
    lengths: list[int] = []
    for length in sorted(x for x, docs in rests.items() if docs):
        counts[length] = len(rests[length])
        lengths.append(length)

    def take(length: int) -> tuple[int, int, int]:
        counts[length] -= 1
        if not counts[length]:
            del counts[length]
            del lengths[bisect_left(lengths, length)]
        return rests[length].pop(), 0, length

    carried: tuple[int, int, int] | None = None
    while lengths or carried:
        whole = carried is None
        first = carried or take(lengths[-1])
        carried = None
        room = window - first[2]
        pattern = fill(counts, room, lengths) if room else []
        slack = room - sum(length * n for length, n in pattern)
        times = 1
        if whole and not slack:  # as often as the counts allow
            need = {first[2]: 1}
            for length, n in pattern:
                need[length] = need.get(length, 0) + n
            times = max(1, min((counts.get(x, 0) + (x == first[2])) // n for x, n in need.items()))
        for k in range(times):
            pieces = [take(first[2]) if k else first]
            pieces += [take(length) for length, n in pattern for _ in range(n)]
            if slack and (at := bisect_right(lengths, slack)) < len(lengths):
                doc, begin, length = take(lengths[at])
                pieces.append((doc, begin, slack))
                carried = (doc, begin + slack, length - slack)
            yield pieces


def in_powers(pieces: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """A part-filled window as windows whose lengths are powers of two."""
    left = sum(p[2] for p in pieces)
    pieces = list(reversed(pieces))
    while left:
        size = room = 1 << (left.bit_length() - 1)
        out = []
        while room:
            doc, begin, length = pieces.pop()
            some = min(room, length)
            out.append((doc, begin, some))
            if some < length:
                pieces.append((doc, begin + some, length - some))
            room -= some
        left -= size
        yield out


def pack_pool(ids: list[bytes], window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Windows over the documents of one pool, given as their little-endian 32-bit ids."""
    rests: dict[int, list[int]] = {}
    tail: dict[int, int] = {}
    for doc, x in enumerate(ids):
        n = len(x) // 4
        for begin in range(0, n - window + 1, window):
            yield [(doc, begin, window)]
        if n % window:
            rests.setdefault(n % window, []).append(doc)
            tail[doc] = n - n % window
    for pieces in plan(rests, window):
        pieces = [(doc, tail[doc] + begin, length) for doc, begin, length in pieces]
        if sum(p[2] for p in pieces) == window:
            yield pieces
        else:
            yield from in_powers(pieces)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, window: int = WINDOW, pool: int = POOL, pool_ids: int = POOL_IDS, with_ids: bool = False, chars: int | None = None, kept: int = KEPT_PARTS) -> DataFrame:
    """One row per piece: where it lies in its document and in its window; with_ids adds the ids themselves, as binary.
    chars: of texts that are encoded at once, kept: parts in each generation of the encoder's cache, for less memory than those of
    tokens take.

    docs needs doc_id and text.
    """

    def packed(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from voxweave.llm.tokens import encoder

        encode = encoder(tokenizer, kept).encode_all
        end = int(end_id).to_bytes(4, "little")
        sequence = TaskContext.get().partitionId() << 32
        keys: list = []
        ids: list[bytes] = []

        def flush():
            nonlocal sequence
            cols: list[list] = [[] for _ in range(8)]
            for pieces in pack_pool(ids, window):
                offset = 0
                for doc, begin, length in pieces:
                    part = ids[doc][4 * begin : 4 * (begin + length)]
                    row = (keys[doc], begin, length, zlib.crc32(part), len(ids[doc]) // 4, sequence, offset, part)
                    for col, x in zip(cols, row, strict=True):
                        col.append(x)
                    offset += length
                sequence += 1
            keys.clear()
            ids.clear()
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
            kinds = [pa.int64()] * 7 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in list(zip(cols, kinds, strict=True))[: 8 if with_ids else 7]], names=names[: 8 if with_ids else 7])

        held = 0
        for batch in batches:
            for key, found in zip(batch.column(0).to_pylist(), encode(batch.column(1), chars), strict=True):
                keys.append(key)
                ids.append(found + end)
                held += len(found) // 4 + 1
                if len(ids) >= pool or held >= pool_ids:
                    yield flush()
                    held = 0
        if ids:
            yield flush()

    schema = SCHEMA + (", ids binary" if with_ids else "")
    return mapped(docs.selectExpr("cast(doc_id as long) as doc_id", "text"), packed, schema, keeps="tokens")


def op3_packing(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
