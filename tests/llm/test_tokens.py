"""op3 and op6 against the tokenizers library applied to whole texts."""

import random
import unicodedata
import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm import cases
from voxweave.llm import packing, wavelet
from voxweave.llm.tables import scratch, table

SF = "/root/testdata/sf0.001"


@cache
def library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def whole(name, text, end):
    return np.array([*library(name).encode(text or "", add_special_tokens=False).ids, end], dtype="<u4")


ODD = [
    "a,b c.d² e½. 'tis it's x's. _a_ __ a_b. «é».  x", "tab\there\n\nnew \n line   three", "Σας ΟΔΟΣ. é, ñ!! ¿qué? 中文。 a' b'' c'.", "ﬁ. Ⅷ. ª, ʰ.", "", " ", "  ", "\n", " a", "a ", "a  ", "İstanbul İ", "E\u0301cole É STRASSE ẞ Ǆ ΑΣ. ΟΔΟΣ", "<|ENDOFTEXT|> x", "Don'T can'T",
    "ŞEHRİ. SEVGİ, x", "क़, फ़. ਫ਼!", "<|endoftext|>", "a b<|startoftext|> c", "ﾟ, a\u0301. \u0345,", "a\x1c b \x85 c\xa0 d",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_parts_give_the_ids_of_whole_texts(name):
    from voxweave.llm.tokens import PartEncoder

    made = PartEncoder(public_tokenizers.path(name), kept=5)
    for _ in range(2):
        for text, ids in zip(ODD, made.encode(ODD), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == whole(name, text, 0)[:-1].tolist(), text


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_every_code_point_before_a_mark(name):
    from voxweave.llm.tokens import PartEncoder

    texts = []
    for c in range(0x30000):
        alike = 0x3400 <= c < 0xA000 or 0xAC00 <= c < 0xD7A4 or c >= 0x12000  # of these every 61st
        if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co") and not (alike and c % 61):
            texts += [f"Ab{chr(c)}, {chr(c)}", f"x {chr(c)}{chr(c)}'s{chr(c)} á{chr(c)}. {chr(c)}1"]
    rng = random.Random(11)
    for some in ("ab C,.'s1\n\t ", "aÉéß ñÑ.,'\n İIΣσ", "  \n\n\tA b'", "<|endoftext|> aB", "a\x1c\x1d \x85\xa0b.", "Жж ÁàŸ9.'", "ÅΩẞ\u0345α A"):
        texts += ["".join(rng.choice(some) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    t = Tokenizer.from_file(public_tokenizers.path(name))
    made = PartEncoder(public_tokenizers.path(name), kept=20_000)
    wrong = [text for text, want, got in zip(texts, t.encode_batch(texts, add_special_tokens=False), made.encode(texts), strict=True) if want.ids != np.frombuffer(got, "<u4").tolist()]
    assert not wrong


def check_packing(docs, out):
    texts = {r.doc_id: whole("byte_bpe_50k.json", r.text, 0) for r in docs.collect()}
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in out.collect():
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for doc, ids in texts.items():
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for rs in windows.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding == 0


@pytest.mark.parametrize("extra", [False, True])
def test_packing_cases(spark, extra):
    docs = cases.frame(spark, extra)
    check_packing(docs, packing.op3_packing(docs))


def test_packing_table(spark):
    docs = table(spark, SF, "documents")
    check_packing(docs, packing.op3_packing(docs))


def test_packing_empty_and_repeated(spark):
    assert packing.op3_packing(cases.empty(spark)).count() == 0
    docs = cases.frame(spark)
    twice = docs.union(docs).coalesce(1)
    out = packing.op3_packing(twice)
    assert out.groupBy().sum("length").first()[0] == 2 * sum(len(whole("byte_bpe_50k.json", t, 0)) for t in cases.TEXTS.values())


def test_fill_against_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(5)}
        room = rng.randint(1, 90)
        sums = {0}
        for length, n in counts.items():
            sums = {s + k * length for s in sums for k in range(n + 1)}
        best = max(s for s in sums if s <= room)
        got = packing.fill(counts, room)
        assert sum(length * n for length, n in got) == best
        assert all(n <= counts[length] for length, n in got)


def check_wavelet(docs, out):
    """Rows of one doc_id may come in any order."""
    want = defaultdict(list)
    for r in docs.collect():
        ids = whole("word_bpe_49k.json", r.text, 1)
        want[r.doc_id].append((len(ids), zlib.crc32(ids.tobytes()), int((ids == 1).sum())))
    rows = sorted(out.collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [doc for doc in sorted(want, key=lambda x: (x is not None, x or 0)) for _ in want[doc]]
    start, got = 0, defaultdict(list)
    for r in rows:
        assert r.start == start
        start += r.n_tokens
        got[r.doc_id].append((r.n_tokens, r.ids_crc32, r.n_end_ids))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


@pytest.mark.parametrize("extra", [False, True])
def test_wavelet_cases(spark, extra):
    docs = cases.frame(spark, extra)
    check_wavelet(docs, wavelet.op6_wavelet(docs))


def test_wavelet_table(spark):
    docs = table(spark, SF, "documents")
    check_wavelet(docs, wavelet.op6_wavelet(docs))


def test_wavelet_empty_null_and_repeated(spark):
    assert wavelet.op6_wavelet(cases.empty(spark)).count() == 0
    docs = spark.createDataFrame([(None, "b"), (None, None), (3, "x y"), (3, "x y"), (3, "a")], "doc_id long, text string")
    check_wavelet(docs, wavelet.op6_wavelet(docs))


def test_wavelet_ranks_and_places():
    rng = np.random.default_rng(5)
    for n, top in ((0, 1), (1, 1), (500, 7), (2000, 49000)):
        ids = rng.integers(0, top, n).astype("u4") if n else np.array([], "u4")
        made = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids, [7], [n]).to_bytes())
        assert made.decode().tolist() == ids.tolist()
        for i in range(0, n, 37):
            assert made.access(i) == ids[i]
        for token in set(ids[:20].tolist()) | {top + 1}:
            places = np.flatnonzero(ids == token)
            assert made.count(token) == len(places)
            assert made.count(token, n // 2) == int((places < n // 2).sum())
            for k in {0, len(places) // 2, len(places) - 1, len(places)}:
                assert made.find(token, k) == (places[k] if 0 <= k < len(places) else -1)


def test_files_are_read_without_their_source(spark):
    path = scratch(spark, "wavelet")
    wavelet.write_shards(cases.frame(spark), public_tokenizers.path("word_bpe_49k.json"), path)
    assert wavelet.read_shards(spark, path).count() == len(cases.TEXTS)


def test_one_id_for_many_rows_and_one_far_away(spark, monkeypatch):
    """No range is large because of a repeated, a missing or an outlying id, and shards end by their ids."""
    monkeypatch.setattr(wavelet, "SHARD_IDS", 50)
    rows = [(7, "same text here")] * 300 + [(None, f"text {k}") for k in range(300)] + [(k, "x") for k in range(100)] + [(10**17, "far")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    path = scratch(spark, "wavelet")
    wavelet.write_shards(docs, public_tokenizers.path("word_bpe_49k.json"), path)
    files = spark.read.parquet(path)
    per_part = [r.n for r in files.groupBy("part").agg({"n_tokens": "sum"}).toDF("part", "n").collect()]
    assert len(per_part) == 4 and max(per_part) < 2 * sorted(per_part)[1]
    assert files.agg({"n_tokens": "max"}).first()[0] < 60
    check_wavelet(docs, wavelet.read_shards(spark, path))


def test_occurrences_by_selects(spark):
    path, docs = scratch(spark, "wavelet"), cases.frame(spark)
    wavelet.write_shards(docs, public_tokenizers.path("word_bpe_49k.json"), path)
    want = []
    for r in docs.collect():
        ids = whole("word_bpe_49k.json", r.text, 1)
        want += [(r.doc_id, k) for k in np.flatnonzero(ids == ids[0]).tolist()] if r.doc_id == 7 else []
        token = int(ids[0]) if r.doc_id == 7 else None
        if token is not None:
            chosen = token
    got = wavelet.occurrences(spark, path, chosen).filter("doc_id = 7").collect()
    assert sorted((r.doc_id, r.place) for r in got) == sorted(want)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_long_texts_are_cut_and_joined(name, monkeypatch):
    """A text longer than what is gathered at once, among short ones; and one long run without a space."""
    from voxweave.llm import tokens

    monkeypatch.setattr(tokens, "CHARS", 1000)
    rng = random.Random(3)
    long = " ".join(rng.choice(["Word", "two,", "ñandú", "x\ny", "3.14", "it's"]) for _ in range(3000))
    texts = ["short one", long, "", None, "y" * 5000, "a  b", long + " ", "end"]
    for text, ids in zip(texts, tokens.PartEncoder(public_tokenizers.path(name), kept=4).encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole(name, text, 0)[:-1].tolist()
