"""Secrets that a run joins with other words: found in their own piece, and redacted."""

import random
import re
import string

import pytest

from voxweave.llm import secret_scan as scan

ALPHABETS = {"hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "lower": string.ascii_lowercase + string.digits, "mixed": string.ascii_letters + string.digits}


def values(alphabet, size, n):
    rng = random.Random(f"{alphabet} {size}")
    while n:
        value = "".join(rng.choice(ALPHABETS[alphabet]) for _ in range(size))
        if re.search("[0-9]", value) and re.search("[A-Za-z]", value):
            n -= 1
            yield value


def found_shares(spark, fronts, n=60):
    """Share of values of which at least WINDOW characters in a row are redacted, by alphabet, length and what stands before them."""
    rows = [(f"{a} {size} {front}", f"see {front}{v} there", v) for a in ALPHABETS for size in (20, 24, 32, 40) for front in fronts for v in values(a, size, n)]
    out = scan.scan(spark.createDataFrame(rows, "kind string, text string, value string"))
    out = out.select("kind", (~scan.redacted(scan.F.col("text"), scan.F.col("secret_spans")).contains(scan.F.substring("value", 1, scan.WINDOW))).cast("double").alias("found"))
    return {r.kind: r.share for r in out.groupBy("kind").agg(scan.F.avg("found").alias("share")).collect()}


def test_joined_values(spark):
    shares = found_shares(spark, ["", "key=", "sk_", "path/to/"])
    assert min(shares.values()) >= 0.85, {k: v for k, v in shares.items() if v < 0.85}


def test_values_beside_samples(spark):
    shares = found_shares(spark, ["/sample/", "example_", "dummy=x/"])
    assert min(shares.values()) >= 0.85, {k: v for k, v in shares.items() if v < 0.85}
    key = "q7Rk/Zp2+Lw9Xc4Vb8+Nm1/Ty6Hd3Gf5+Sa0Ju"  # no piece of it is as long as a window
    for text, rest in [(f"/sample/{key}", "/sample"), (f"{key}/sample", "sample")]:
        row = scan.scan(spark.createDataFrame([(text,)], "text string")).select(scan.redacted(scan.F.col("text"), scan.F.col("secret_spans")).alias("t")).first()
        assert rest in row.t and key[:30] not in row.t and "[REDACTED]" in row.t
    long = "example_" + "ab1/" * 20000
    assert scan.scan(spark.createDataFrame([(long,)], "text string")).first().secret_spans == []


@pytest.mark.parametrize("text", ["wJalrXUtnFEMIbPxRfiCYEXAMPLEKEY1", "/sample/dummy_example_placeholder/2024", "see key=internationalization_of_everything", "see sample_0123456789abcdef0123", "see key=20240102030405060708090", "/usr/lib/python3/dist-packages/numpy/core2/include"])
def test_no_secrets(spark, text):
    assert scan.scan(spark.createDataFrame([(text,)], "text string")).first().piece_spans == []


def test_places(spark):
    value = "9f86d081884c7d659a2feaa0c55ad015"[:24]
    row = scan.op5_secrets(spark.createDataFrame([(1, f"é𝔘 key={value.upper()}.")], "doc_id long, text string")).first()
    assert row.spans == row.piece_spans == f"piece:7:{7 + len(value)}"
