"""The secret scan against Python's re and a window computed afresh at every place."""

import hashlib
import math
import random
import re
from collections import Counter

from tests.llm import cases
from voxweave.llm import secret_scan as scan
from voxweave.llm.tables import table

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def entropy(s):
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values())


def extra(text, known):
    out = []
    for m in re.finditer("[A-Za-z0-9+/_=-]+", text):
        if len(m[0]) < scan.WINDOW or re.search(scan.ALLOWED, m[0]):
            continue
        bits = scan.HEX_BITS if re.fullmatch("[0-9a-fA-F]+", m[0]) else scan.TEXT_BITS
        hits = [k for k in range(len(m[0]) - scan.WINDOW + 1) if entropy(m[0][k : k + scan.WINDOW]) >= bits - 1e-9]
        if hits:
            a, b = m.start() + hits[0], m.start() + hits[-1] + scan.WINDOW
            if not any(s <= a and b <= e for s, _, e in known):
                out.append((a, 3, b))
    return out


def shown(spans):
    return ",".join(f"{scan.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def check(df):
    for r, s in df:
        b = base(r or "")
        assert s.base_sha256 == hashlib.sha256(shown(b).encode()).hexdigest(), r
        assert [s.n_assign, s.n_access, s.n_hex] == [sum(k == x for _, k, _ in b) for x in range(3)]
        pieces = [x.split(":") for x in s.piece_spans.split(",") if x]
        assert s.spans == shown(sorted(b + extra(r or "", b) + [(int(x), scan.KINDS.index(k), int(y)) for k, x, y in pieces])), r


def joined(docs):
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    return [(texts[s.doc_id], s) for s in scan.op5_secrets(docs).collect()]


def random_texts(seed, n):
    rng = random.Random(seed)
    pieces = ["password", "PassWd", "secret", "Token", "api_key", "APIKEY", "=", ":", " ", "  ", '"', "'", "abc", "short=1", "AKIA", "AKIAAKIA", "ABCDEFGHIJKL0123", "é", "𝔘", "👍", "\n", "-", "_", "0123456789abcdef"]
    alphabets = ["0123456789abcdef", "ABCDEF0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "aab1"]
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(1, 25)):
            parts.append(rng.choice(pieces) if rng.random() < 0.7 else "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.choice([5, 12, 19, 20, 21, 31, 32, 40, 60]))))
        yield "".join(parts)


def test_random_texts(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(random_texts(7, 400))], "doc_id long, text string").repartition(2)
    check(joined(docs))


def test_table_and_cases(spark):
    check(joined(table(spark, "/root/testdata/sf0.01", "documents")))
    docs = cases.frame(spark, extra=True)
    check(joined(docs))
    assert scan.op5_secrets(docs.union(docs)).count() == 2 * len(cases.TEXTS)
    assert scan.op5_secrets(cases.empty(spark)).count() == 0


def test_redaction(spark):
    text = 'x token = "0123456789abcdef0123456789abcdef01234567" y'
    docs = spark.createDataFrame([(1, text), (2, "plain é"), (3, None)], "doc_id long, text string")
    out = {r.doc_id: r.t for r in scan.scan(docs).select("doc_id", scan.redacted(scan.F.col("text"), scan.F.col("secret_spans")).alias("t")).collect()}
    assert out == {1: 'x [REDACTED]" y', 2: "plain é", 3: None}


def test_very_long_runs_and_many_matches(spark):
    """Neither ends the JVM nor takes time in proportion to the square: a megabyte of joined letters, a run of base64, thousands of matches."""
    rng = random.Random(5)
    draw = lambda some, n: "".join(rng.choice(some) for _ in range(n))
    texts = ["a-" * 500_000, draw("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 60_000), " ".join(draw("0123456789abcdef", 32) for _ in range(20_000)), " ".join(draw("0123456789ABCDEFabcxyz", 24) for _ in range(3_000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    check(joined(docs))
    rows = scan.scan(docs).select("doc_id", "text", "secret_spans", scan.redacted(scan.F.col("text"), scan.F.col("secret_spans")).alias("t")).collect()
    for r in rows:
        at, want = 0, []
        for s in sorted(r.secret_spans, key=lambda s: (s.start, -s.end)):
            if s.start >= at:
                want += [r.text[at : s.start], "[REDACTED]"]
            at = max(at, s.end)
        assert r.t == "".join(want) + r.text[at:]
