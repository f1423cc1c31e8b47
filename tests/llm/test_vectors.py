"""Whitening and hard negatives against numpy and brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from studybank.llm import blocks, common, negatives, topk, whitening

VECTORS = "vec_id long, embedding array<float>, label int"


def odd_vectors(n=300, d=12, seed=4):
    """Copies, ties, nulls, null and non-finite components, short and empty vectors, repeated and null ids."""
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 1) * (3 - i % 3) + (i % 5) for _ in range(d)], i % 3) for i in range(n)]
    rows += [(n + i, rows[i][1], rows[i][2]) for i in range(20)]
    rows += [(900, None, 1), (901, [1.0, None] + [0.0] * (d - 2), 1), (902, [float("nan")] * d, 1), (903, [float("inf")] * d, 1),
             (904, rows[0][1], None), (None, rows[3][1], 1), (905, rows[5][1][:4], 1), (950, [], 2), (0, rows[0][1], 0), (50, rows[7][1], 1)]
    return rows


def quantised(v):
    return None if v is None or any(x is None or not math.isfinite(x) for x in v) else [
        math.floor(256 * float(np.float32(x))) for x in v]


def test_whitening_against_a_dense_decomposition(spark, monkeypatch):
    common.prepare(spark)
    rows = odd_vectors()
    df = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 AS n", "2 AS component", "3 AS q", "4 AS whitened")
    usable = [(i, q + [0] * (12 - len(q))) for i, v, _ in rows if (q := quantised(v)) is not None]
    x = np.array(sorted({tuple(q) for _, q in usable}))
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    for size in (whitening.BLOCK_BYTES, 8 * 12 * 7):
        monkeypatch.setattr(whitening, "BLOCK_BYTES", size)
        out = whitening.whitened(df.repartition(3)).collect()
        assert len(out) == 4 * len(usable)
        own = {}
        for r in out:
            own.setdefault(r.component, []).append(r)
        for c, got in own.items():
            w, e = vectors[:, c - 1], values[c - 1]
            expected = sorted((-1 if i is None else i, n, int(((n * np.array(q) - s) ** 2).sum()), float((np.array(q) - s / n) @ w / math.sqrt(e)))
                              for i, q in usable)
            sign = np.sign(sum(a[3] * b for a, b in zip(expected, [r.whitened for r in sorted(got, key=lambda r: (-1 if r.vec_id is None else r.vec_id, r.deviation))]))) or 1
            result = sorted((-1 if r.vec_id is None else r.vec_id, r.n, r.deviation, r.whitened * sign) for r in got)
            assert [a[:3] for a in result] == [a[:3] for a in sorted(expected)]
            assert np.allclose(sorted(a[3] for a in result), sorted(a[3] for a in expected), atol=1e-9)
            assert all(r.explained == pytest.approx(e / values.sum(), rel=1e-10) and r.identity_error < 1e-9 for r in got)


@pytest.mark.parametrize("points, values", [
    # the four equal values of a cross: every chain ends at once
    ([[s * (i == j) for j in range(4)] for i in range(4) for s in (1, -1)], [1 / 4] * 4),
    # two equal leading values, then others
    ([[3 * s * (i == j) for j in range(5)] for i in range(2) for s in (1, -1)]
     + [[s * (i == j) * (5 - i) / 2 for j in range(5)] for i in range(2, 5) for s in (1, -1)], None),
    # fewer distinct vectors than components
    ([[1, 2, 3], [4, 5, 6], [4, 5, 6]], [1.0]),
    ([[1, 2, 3]] * 5, []),
    ([[7.0], [8.0], [9.5]], [1.0]),
])
def test_whitening_finds_equal_and_missing_components(spark, points, values):
    common.prepare(spark)
    df = spark.createDataFrame([(i, [float(x) for x in p], 0) for i, p in enumerate(points)], VECTORS)
    x = np.unique(np.floor(256 * np.array(points, dtype=float)), axis=0)
    centred = x - x.mean(axis=0)
    every = np.linalg.eigvalsh(centred.T @ centred / len(x))[::-1]
    expected = [e / every.sum() for e in every[:4] if e > 1e-9 * max(every.sum(), 1)] if values is None else values
    out = whitening.whitened(df).collect()
    got = {r.component: r.explained for r in out}
    assert [got[c] for c in sorted(got)] == pytest.approx(expected, rel=1e-10)
    assert len(out) == len(points) * len(expected) and all(r.identity_error < 1e-9 for r in out)


def test_whitening_of_nothing_and_of_large_numbers(spark):
    common.prepare(spark)
    assert whitening.whitened(spark.createDataFrame([], VECTORS)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, None, 1), (2, [], 1)], VECTORS)).count() == 0
    big = spark.createDataFrame([(i, [1e12 * i, 3.0 * i * i]) for i in range(40)], "vec_id long, embedding array<double>")
    rows = whitening.whitened(big).collect()
    x = [[math.floor(256 * v) for v in (1e12 * i, 3.0 * i * i)] for i in range(40)]
    s = [sum(c) for c in zip(*x)]
    for r in rows:
        exact = sum((40 * a - b) ** 2 for a, b in zip(x[r.vec_id], s))
        assert r.deviation == (exact if exact < 2 ** 63 else None)


def test_strassen_is_exact():
    rng = np.random.default_rng(1)
    for m, k, n in ((1, 1, 1), (65, 64, 200), (129, 131, 67), (300, 256, 128), (0, 70, 80), (70, 0, 80)):
        for top in (10, 2 ** 20, 2 ** 27):
            a, b = rng.integers(-top, top, (m, k)), rng.integers(-top, top, (k, n))
            assert (negatives.strassen(a, b) == a @ b).all()


def mined(rows, positives=5, negatives_=3):
    """Brute force with Python's integers."""
    v = {(i, y, tuple(q)) for i, x, y in rows if i is not None and y is not None and (q := quantised(x)) is not None}
    asked = {}
    for i, y, q in v:
        if i % 50 == 0:
            asked[i] = min(asked.get(i, (q, y)), (q, y))
    out = []
    for a, (q, y) in asked.items():
        scored = [(-sum(s * t for s, t in zip(q, o)), i, z) for i, z, o in v if i != a]
        pos = sorted((s, i) for s, i, z in scored if z == y)[:positives]
        for p, pid in pos:
            fit = sorted((s, i) for s, i, z in scored if z != y and 50 * -p <= 100 * -s <= 95 * -p)[:negatives_]
            out += [(a, pid, r + 1, i, -p, -s) for r, (s, i) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives_against_brute_force(spark, monkeypatch, small):
    common.prepare(spark)
    if small:
        for name, value in (("ANCHOR_BYTES", 300), ("CELL_BYTES", 3000), ("TILE_ANCHORS", 2), ("TILE_ROWS", 16), ("SLAB", 5), ("LEAF", 2)):
            monkeypatch.setattr(negatives, name, value)
    rows = odd_vectors(n=420)
    df = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 AS id", "2 AS q", "3 AS wants", "4 AS anchor_id", "5 AS rank", "6 AS g")
    got = negatives.hard_negatives(df.filter("vec_id % 50 = 0"), df.repartition(3)).collect()
    expected = mined(rows)
    assert len(expected) > 60 and sorted(map(tuple, got)) == expected


def test_hard_negatives_with_ties_hot_copies_and_one_huge_row(spark, monkeypatch):
    common.prepare(spark)
    rng = random.Random(8)
    rows = [(i, [float(rng.randint(-1, 1)) for _ in range(6)], i % 2) for i in range(300)]
    rows += [(7, rows[7][1], 1)] * 500                       # one row many times
    rows += [(100, [rng.random() for _ in range(200_000)], 0), (600, [1.0] * 150_000, 1)]
    df = spark.createDataFrame(rows, VECTORS)
    short = [(i, v[:200_000], y) for i, v, y in rows]
    got = negatives.hard_negatives(df.filter("vec_id % 50 = 0"), df).collect()
    assert sorted(map(tuple, got)) == mined(short)
    found = topk.top_k(df.filter("vec_id <> 7"), df.filter("vec_id in (100, 600)"), 2).collect()
    q = [np.array(quantised(v)) for i, v, _ in rows if i in (100, 600)]
    cross = int(q[-1][:150_000] @ q[-2][:150_000])
    assert {(r.query_id, r.vec_id, r.score) for r in found if r["rank"] == 1} >= {(600, 100, cross), (100, 600, cross)} - (
        set() if len(q) == 2 else {(100, 600, cross)})


def test_empty_tables(spark):
    common.prepare(spark)
    none = spark.createDataFrame([], VECTORS)
    some = spark.createDataFrame([(50, [1.0], 1), (51, [1.0], 1), (52, [0.9], 2)], VECTORS)
    assert negatives.hard_negatives(none, none).count() == 0
    assert negatives.hard_negatives(some.limit(0), some).count() == 0
    assert negatives.hard_negatives(some.filter("vec_id = 50"), some).count() == 1


def test_blocks_are_cut_by_bytes(spark):
    common.prepare(spark)
    df = spark.createDataFrame([(i, [1] * (5000 if i == 3 else 10)) for i in range(50)], "id long, q array<long>").coalesce(1)
    packs = blocks.packed(df, 4, "c", 800).toPandas()
    sizes = [np.frombuffer(x, np.int32) for x in packs["lengths"]]
    assert sum(len(s) for s in sizes) == 50 and all(len(s) == 1 or 8 * s.sum() <= 800 for s in sizes)
