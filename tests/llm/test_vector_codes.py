"""Vector codes against a plain version, with awkward rows and components of any size."""

import hashlib
import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from voxweave.llm import vector_codes as vc
from voxweave.llm.tables import table

SCHEMA = "vec_id long, embedding array<double>, label int, code string, error string"


def brute(rows):
    """rows: (vec_id, vector, label) -> sorted (vec_id, code, error, label_error, digest)."""
    rows = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    sizes = Counter(len(r[1]) for r in rows if len(r[1]) % 16 == 0)
    if not sizes:
        return []
    size = min(sizes, key=lambda n: (-sizes[n], n))
    rows = [r for r in rows if len(r[1]) == size]
    exact = lambda x: math.floor(Fraction(x) * 256)
    ints = [[exact(x) for x in v] for _, v, _ in rows]
    w = size // 16
    part = lambda v, p: tuple(v[p * w : p * w + w])
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, rows[k][1]))[:64]
    books = [[part(ints[k], p) for k in order] for p in range(16)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v, p: min((far(part(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(2):
        at = [[near(v, p)[1] for p in range(16)] for v in ints]
        for p in range(16):
            new = list(books[p])
            for k in range(len(new)):
                mine = [part(v, p) for v, a in zip(ints, at) if a[p] == k]
                if mine:
                    new[k] = tuple(sum(c) // len(mine) for c in zip(*mine))
            books[p] = new
    found = [[near(v, p) for p in range(16)] for v in ints]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = Counter()
    for (_, _, label), e in zip(rows, errors):
        by_label[label] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    fits = lambda x: x if x < 2**63 else None
    out = [(r[0], "".join(f"{k:02x}" for _, k in f), fits(e), fits(by_label[r[2]]), digest) for r, f, e in zip(rows, found, errors)]
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(parts)


def vectors(seed, n, width=32, scale=1.0):
    rng = random.Random(seed)
    some = [[rng.gauss(0, scale) for _ in range(width)] for _ in range(12)]
    return [(k * 7 - 50, [x + rng.choice([0, 0, 0.01, 0.3]) * scale for x in rng.choice(some)], rng.choice([1, 2, None])) for k in range(n)]


@pytest.mark.parametrize(("n", "scale"), [(400, 1.0), (20, 1.0), (90, 2.0**30), (70, 1e12), (70, 1e306)])
def test_against_plain(spark, n, scale):
    rows = vectors(n, n, scale=scale)
    assert got(vc.op13_vector_codes(frame(spark, rows))) == brute(rows)


def test_awkward_rows(spark):
    rows = vectors(5, 100)
    rows += [(1, None, 1), (2, [], 1), (3, [1.0] * 31 + [None], 1), (4, [float("nan")] * 32, 1), (5, [float("-inf")] + [0.0] * 31, 2), (6, [1.0] * 16, 2), (7, [1.0] * 33, 2)]
    rows += [(None, [0.5] * 32, None), (None, [0.25] * 32, 3), rows[3], rows[3], (-50, [0.125] * 32, 1)]
    assert got(vc.op13_vector_codes(frame(spark, rows))) == brute(rows)
    assert got(vc.op13_vector_codes(frame(spark, [(1, None, 1), (2, [1.0], 1)]))) == []
    assert got(vc.op13_vector_codes(frame(spark, []))) == []
    same = [(k, [0.5] * 16, 1) for k in range(100)]
    assert got(vc.op13_vector_codes(frame(spark, same))) == brute(same)


def test_table(spark):
    df = table(spark, "/root/testdata/sf0.001", "embeddings")
    assert got(vc.op13_vector_codes(df)) == brute([tuple(r) for r in df.collect()])


def test_partial_distances_keep_every_nearest_entry():
    rng = np.random.default_rng(3)
    for width in (1, 2, 3, 8):
        x, book = rng.integers(-4, 5, (500, width)), rng.integers(-4, 5, (40, width))
        entry, far = vc.nearest(x, book)
        want = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        assert (far == want.min(axis=1)).all() and (entry == want.argmin(axis=1)).all()
