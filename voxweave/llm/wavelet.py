"""Token ids in a wavelet matrix per shard of documents.

A shard's ids are laid down as one bit-plane per bit of the largest id, from the highest bit. A plane holds
that bit of every id in the plane's order; the next plane's order has the ids with bit 0 first and those
with bit 1 after them, both in the order before. With ranks over the planes a single id, the count of an id
in a prefix, and the place of its k-th occurrence are found in as many steps as there are planes.

File format (little-endian): ``WVM2``, u32 planes, u64 ids, u32 documents, u32 bytes of the directory, the
directory (zlib: a null flag byte per document, i64 doc_ids, u32 lengths), zeros up to a multiple of 8
bytes, then per plane u64 zeros, a u32 per block of 512 bits (and one more) with the ones before it, zeros
up to a multiple of 8 bytes, and the blocks' bits, least significant first. A rank reads one u32 and one
block of its plane, a select searches the u32s and reads one block; nothing is unpacked or rebuilt when a
file is opened.

Files are written by Spark as the ``payload`` column of Parquet files, one row per shard, so that any store
that Spark can write will do and a lost executor leaves no half-written shard.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxweave.llm.arrow import mapped
from voxweave.llm.tables import scratch

MAGIC = b"WVM2"
#: Bits of a block, as a power of two, and the 64-bit words in it.
BLOCK, WORDS = 9, 8
#: Ids after which a shard ends, with the document that reaches them.
SHARD_IDS = 250_000
#: Parts of texts that a worker keeps the ids of, in each of two generations; more than in packing, which shares its workers' memory with other stages.
KEPT_PARTS = 600_000
#: Bytes of text that a task should take at most, where the session's number of shuffle partitions would give it more.
TASK_BYTES = 128 << 20
FILES = "part int, shard long, before long, n_tokens long, payload binary"


class Plane:
    """Packed bits with the ones before each block."""

    def __init__(self, ones: np.ndarray, words: np.ndarray, zeros: int):
        self.ones, self.words, self.zeros = ones, words, zeros

    @classmethod
    def of(cls, bits: np.ndarray) -> Plane:
        packed = np.zeros(((len(bits) >> BLOCK) + 1) << (BLOCK - 3), "u1")
        some = np.packbits(bits, bitorder="little")
        packed[: len(some)] = some
        words = packed.view("<u8")
        each = np.bitwise_count(words).reshape(-1, WORDS).sum(axis=1, dtype="<u4")
        ones = np.concatenate([np.zeros(1, "<u4"), np.cumsum(each, dtype="<u4")])
        return cls(ones, words, len(bits) - int(ones[-1]))

    def bits(self, n: int) -> np.ndarray:
        return np.unpackbits(self.words.view("u1"), count=n, bitorder="little").view(bool)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each of the places."""
        block, word = at >> BLOCK, at >> 6
        out = self.ones[block].astype("i8")
        for k in range(WORDS - 1):
            spot = (block * WORDS) + k
            out += np.where(spot < word, np.bitwise_count(self.words[spot]), 0)
        mask = (np.uint64(1) << (at & 63).astype("u8")) - np.uint64(1)
        return out + np.bitwise_count(self.words[word] & mask)

    def select(self, bit: int, k: int) -> int:
        """The place of the k-th one, or zero, from 0; it must be there."""
        if bit:
            block = bisect_right(self.ones, k) - 1
            left = k - int(self.ones[block])
        else:
            block = bisect_right(range(len(self.ones)), k, key=lambda b: (b << BLOCK) - int(self.ones[b])) - 1
            left = k - ((block << BLOCK) - int(self.ones[block]))
        bits = np.unpackbits(self.words[block * WORDS : (block + 1) * WORDS].view("u1"), bitorder="little")
        return (block << BLOCK) + int(np.flatnonzero(bits == bit)[left])


class WaveletMatrix:
    def __init__(self, planes: list[Plane], n: int, doc_ids: list, lengths: np.ndarray):
        self.planes, self.n, self.doc_ids, self.lengths = planes, n, doc_ids, lengths

    @classmethod
    def build(cls, ids: np.ndarray, doc_ids: list, lengths) -> WaveletMatrix:
        depth = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        now, planes = ids.astype("u2" if depth <= 16 else "u4"), []
        for k in range(depth - 1, -1, -1):
            bit = (now & now.dtype.type(1 << k)) != 0
            planes.append(Plane.of(bit))
            if k:
                now = np.concatenate([np.compress(~bit, now), np.compress(bit, now)])
        return cls(planes, len(ids), list(doc_ids), np.asarray(lengths, dtype="<u4"))

    def to_bytes(self) -> bytes:
        known = np.array([x is not None for x in self.doc_ids], dtype="u1")
        directory = zlib.compress(known.tobytes() + np.array([x or 0 for x in self.doc_ids], dtype="<i8").tobytes() + self.lengths.tobytes(), 1)
        out = [MAGIC, struct.pack("<IQII", len(self.planes), self.n, len(self.doc_ids), len(directory)), directory, bytes(-len(directory) % 8)]
        for plane in self.planes:
            out += [struct.pack("<Q", plane.zeros), plane.ones.tobytes(), bytes(4 * (len(plane.ones) % 2)), plane.words.tobytes()]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        depth, n, docs, size = struct.unpack_from("<IQII", data, 4)
        at = 24
        directory = zlib.decompress(data[at : at + size])
        at += size + -size % 8
        known = directory[:docs]
        found = np.frombuffer(directory, "<i8", docs, docs).tolist()
        lengths = np.frombuffer(directory, "<u4", docs, 9 * docs)
        planes, blocks = [], (n >> BLOCK) + 1
        for _ in range(depth):
            (zeros,) = struct.unpack_from("<Q", data, at)
            ones = np.frombuffer(data, "<u4", blocks + 1, at + 8)
            at += 8 + 4 * (blocks + 1 + (blocks + 1) % 2)
            planes.append(Plane(ones, np.frombuffer(data, "<u8", blocks * WORDS, at), zeros))
            at += 8 * blocks * WORDS
        return cls(planes, n, [x if k else None for x, k in zip(found, known, strict=True)], lengths)

    def decode(self) -> np.ndarray:
        """All ids in order, plane by plane from the lowest."""
        kind = "<u2" if len(self.planes) <= 16 else "<u4"
        now = np.zeros(self.n, dtype=kind)
        for k, plane in enumerate(reversed(self.planes)):
            bit = plane.bits(self.n)
            now[plane.zeros :] |= now.dtype.type(1 << k)
            up = np.empty_like(now)
            up[np.flatnonzero(~bit)] = now[: plane.zeros]
            up[np.flatnonzero(bit)] = now[plane.zeros :]
            now = up
        return now.astype("<u4")

    def access(self, i: int) -> int:
        """The id at place i."""
        value = 0
        for plane in self.planes:
            bit = int(plane.words[i >> 6]) >> (i & 63) & 1
            value = value << 1 | bit
            ones = int(plane.rank(np.array([i]))[0])
            i = plane.zeros + ones if bit else i - ones
        return value

    def _down(self, token: int, at: np.ndarray) -> np.ndarray:
        """Where the prefixes that end at the places end among the ids of the lowest order, for one id."""
        for k, plane in enumerate(self.planes):
            ones = plane.rank(at)
            at = plane.zeros + ones if token >> (len(self.planes) - 1 - k) & 1 else at - ones
        return at

    def counts(self, token: int, ends: np.ndarray) -> np.ndarray:
        """Occurrences of an id among the first ids, for each of the numbers of ids."""
        if token >> len(self.planes):
            return np.zeros(len(ends), "i8")
        found = self._down(token, np.append(0, ends))
        return found[1:] - found[0]

    def count(self, token: int, end: int | None = None) -> int:
        """Occurrences of an id among the first end ids."""
        return int(self.counts(token, np.array([self.n if end is None else end]))[0])

    def find(self, token: int, k: int) -> int:
        """The place of the k-th occurrence of an id, from 0; -1 if there are not as many."""
        if k < 0 or k >= self.count(token):
            return -1
        at = int(self._down(token, np.array([0]))[0]) + k
        for level, plane in enumerate(reversed(self.planes)):
            bit = token >> level & 1
            at = plane.select(bit, at - plane.zeros if bit else at)
        return at


def write_shards(docs: DataFrame, tokenizer: str, path: str, end_id: int = 1) -> None:
    """Encodes docs (doc_id, text), in ascending doc_id, to wavelet matrix files of about SHARD_IDS ids.

    Rows are dealt by ranges of doc_id, and within one doc_id by a hash of the text and by row, so that no
    repeated or missing id makes a range large. Rows without a doc_id come first; null text is empty. A task
    holds one shard at a time; it notes its own number (``part``) and the ids that it wrote before (``before``).
    """

    def built(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from voxweave.llm.tokens import encoder

        encode, end = encoder(tokenizer, KEPT_PARTS).encode_all, int(end_id).to_bytes(4, "little")
        part, number, before = TaskContext.get().partitionId(), 0, 0
        keys: list = []
        parts: list[bytes] = []

        def shard():
            nonlocal number, before
            ids = np.frombuffer(b"".join(parts), "<u4")
            made = WaveletMatrix.build(ids, keys, [len(p) // 4 for p in parts]).to_bytes()
            cols = [pa.array([part], pa.int32()), pa.array([number], pa.int64()), pa.array([before], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([made], pa.binary())]
            number, before = number + 1, before + len(ids)
            keys.clear(), parts.clear()
            return pa.RecordBatch.from_arrays(cols, names=["part", "shard", "before", "n_tokens", "payload"])

        held = 0
        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                keys.append(key)
                parts.append(ids + end)
                held += len(ids) // 4 + 1
                if held >= SHARD_IDS:
                    yield shard()
                    held = 0
        if parts:
            yield shard()

    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "text", "xxhash64(text) as tie", "monotonically_increasing_id() as row")
    order = [F.asc_nulls_first("doc_id"), "tie", "row"]
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    mapped(rows, built, FILES, keeps="tokens").write.option("compression", "none").parquet(path)


def read_shards(spark, path: str, end_id: int = 1) -> DataFrame:
    """One row per document of the files at path: doc_id, start, n_tokens, ids_crc32, n_end_ids (how often the end id occurs in it), part, shard."""

    def opened(batches):
        import pyarrow as pa

        names = ["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32", "n_end_ids"]
        for batch in batches:
            for part, shard, before, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                made = WaveletMatrix.from_bytes(payload)
                ids = made.decode()
                ends = np.cumsum(made.lengths, dtype="i8")
                starts = ends - made.lengths
                crc = [zlib.crc32(ids[a:b].data) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                n_ends = np.diff(made.counts(end_id, np.append(0, ends)))
                cols = [pa.array([part] * len(crc), pa.int32()), pa.array([shard] * len(crc), pa.int64()), pa.array(made.doc_ids, pa.int64()), pa.array(starts + before, pa.int64()), pa.array(made.lengths, pa.int64()), pa.array(crc, pa.int64()), pa.array(n_ends, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    files = spark.read.schema(FILES).parquet(path)
    rows = mapped(files.select("part", "shard", "before", "payload"), opened, "part int, shard long, doc_id long, at long, n_tokens long, ids_crc32 long, n_end_ids long")
    # a row per task of the writer
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "n_end_ids", "part", "shard")


def occurrences(spark, path: str, token: int) -> DataFrame:
    """doc_id, place (in the document's ids) of every occurrence of an id in the files at path, by selects alone."""

    def found(batches):
        import pyarrow as pa

        for batch in batches:
            for payload in batch.column(0).to_pylist():
                made = WaveletMatrix.from_bytes(payload)
                places = np.array([made.find(token, k) for k in range(made.count(token))], "i8")
                starts = np.cumsum(made.lengths, dtype="i8") - made.lengths
                doc = np.searchsorted(starts, places, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array([made.doc_ids[d] for d in doc.tolist()], pa.int64()), pa.array(places - starts[doc], pa.int64())], names=["doc_id", "place"])

    return mapped(spark.read.schema(FILES).parquet(path).select("payload"), found, "doc_id long, place long")


def op6_wavelet(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    path = scratch(docs.sparkSession, "wavelet")
    write_shards(docs, public_tokenizers.path("word_bpe_49k.json"), path)
    return read_shards(docs.sparkSession, path)
