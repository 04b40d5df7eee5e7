"""Hard negatives: exact products, and the whole operator against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from promptgov.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, id string, row int, score string"


@pytest.mark.parametrize("dimension, largest", [(64, 150), (3, 10**6), (1500, 300), (2100, 10**5), (1, 0)])
def test_products(dimension, largest):
    rng = np.random.default_rng(2)
    a, b = (rng.integers(-largest, largest + 1, (n, dimension)) for n in (30, 20))
    a[0], b[0], b[1] = largest, largest, -largest
    primes = H.primes_for(dimension * largest**2, dimension)
    assert math.prod(primes) > 2 * dimension * largest**2
    assert (H.products(H.residues(a, primes), H.residues(b, primes), primes) == a @ b.T).all()


def test_centred():
    x = np.arange(-(1 << 23), 1 << 23, 3)
    for p in (3, 719, 2039):
        c = H.centred(x.astype(np.float32), p).astype(np.int64)
        assert abs(c).max() <= p // 2 and not ((x - c) % p).any()


def plain(rows, positives=5, negatives=3):
    """Vectors of (id, components, label) by the definition."""
    fit = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows
           if None not in (i, v, y) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, v, y) in enumerate(fit):
        if i % 50:
            continue
        score = lambda w: sum(p * q for p, q in zip(v, w, strict=False))  # noqa: B023, E731
        order = sorted((-score(w), j, m) for m, (j, w, z) in enumerate(fit) if z == y and m != n)
        others = sorted((-score(w), j) for j, w, z in fit if z != y)
        for p, j, _ in order[:positives]:
            near = [(q, k) for q, k in others if 50 * -p <= 100 * -q <= 95 * -p]
            out += [(i, j, r, k, -p, -q) for r, (q, k) in enumerate(near[:negatives], 1)]
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, H.hard_negatives(df, F.col("id") % 50 == 0).collect()))


def vectors(n, seed, dimension=8):
    rng = random.Random(seed)
    center = {y: [rng.uniform(-1, 1) for _ in range(dimension)] for y in range(4)}
    out = []
    for i in range(n):
        y = rng.randrange(4)
        near = center[y if rng.random() < 0.6 else rng.randrange(4)]
        out.append((i, [float(np.float32(c + rng.uniform(-0.4, 0.4))) for c in near], y))
    return out


@pytest.mark.parametrize("block", [32 << 20, 300])
def test_definition(spark, monkeypatch, block):
    monkeypatch.setattr(H, "BLOCK_BYTES", block)
    rows = vectors(400, 3)
    rows += [(1000 + i, rows[7][1], rows[7][2]) for i in range(60)] + [(2000 + i, rows[7][1], 1 + rows[7][2]) for i in range(60)]
    expected = plain(rows)
    assert len(expected) > 50 and run(spark, rows) == expected


def test_edges(spark):
    good = vectors(120, 4)
    odd = [(None, good[0][1], 1), (150, None, 1), (200, good[1][1], None), (250, [], 1), (300, [1.0, None], 1),
           (350, [float("nan")] * 8, 1), (400, [float("inf")] * 8, 1), (450, [0.5], 2), (500, [0.25] * 9, 2)]
    assert run(spark, good + odd) == plain(good + odd)
    assert run(spark, []) == [] and run(spark, [(1, [1.0], 1)]) == [] and run(spark, [(50, [1.0], 1)]) == []


def test_too_large(spark):
    with pytest.raises(ValueError):
        run(spark, [(50, [1e9], 1), (51, [1.0], 1)])
