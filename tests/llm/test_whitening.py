"""Whitening against plain numpy on the same fixed-point numbers."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from patronage.llm import whitening
from patronage.llm.queries import QUERIES


def by_eigh(x, most=8):
    """(n, sums, deviations, basis, values, trace) from the covariance itself, in Python numbers where it counts."""
    n, sums = len(x), [sum(int(v) for v in col) for col in x.T]
    wide = [[n * int(v) - s for v, s in zip(row, sums)] for row in x]
    centred = np.array(wide, dtype=object).astype(float) / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:most]
    return n, [sum(v * v for v in row) for row in wide], centred, basis[:, order], values[order], values.sum()


def check(rows, x, ids):
    n, deviations, centred, basis, values, trace = by_eigh(x)
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(got) == len(rows) == n * len(values)
    for k in range(len(values)):
        want = centred @ basis[:, k] / np.sqrt(values[k])
        have = np.array([got[i, k + 1].whitened for i in ids])
        assert min(np.abs(want - have).max(), np.abs(want + have).max()) < 1e-7
        assert abs(got[ids[0], k + 1].explained - values[k] / trace) <= 1e-10 * values[k] / trace
    assert all(got[i, 1].deviation == d and got[i, 1].n == n for i, d in zip(ids, deviations))
    assert max(r.identity_error for r in rows) < 1e-8


def test_query_equals_numpy(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    x = np.floor(1024 * np.array([r.embedding for r in rows], dtype=float)).astype(np.int64) + 100_000
    check(QUERIES["op12_whitening"](spark, folder).collect(), x, [r.vec_id for r in rows])


def test_wide_range_of_variances(spark):
    """Standard deviations from 30 to 30 million: the covariance has a condition of 1e12, its QR factor 1e6."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 8)) * np.logspace(-1.5, 4.5, 8) @ np.linalg.qr(rng.normal(size=(8, 8)))[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = whitening.components_of(df, "embedding", "vec_id").collect()
    whole = np.floor(1024 * x).astype(np.int64) + 100_000
    centred = whole - whole.mean(axis=0)
    s = np.linalg.svd(centred, compute_uv=False)
    share = {r.component: r.explained for r in rows}
    assert np.allclose([share[k + 1] for k in range(8)], s**2 / (s**2).sum(), rtol=1e-8)
    assert rows[0].identity_error < 1e-6


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    base = [(1, [1.0, 2.0, 0.5]), (2, [0.0, 2.0, 1.5]), (2, [0.0, 2.0, 1.5]), (3, [3.0, 2.0, -1.0]), (None, [2.0, 2.0, 0.0])]
    bad = [(7, None), (8, [1.0, nan, 2.0]), (9, [inf, 0.0, 0.0]), (10, [None, 1.0, 2.0]), (11, [])]
    df = spark.createDataFrame(base + bad, "vec_id long, embedding array<double>").withColumns({c: F.lit("own") for c in ("n", "x", "key", "whitened")})
    rows = whitening.components_of(df, "embedding", "vec_id").collect()
    assert {r.vec_id for r in rows} == {1, 2, 3, None} and {r.n for r in rows} == {5}
    assert {r.component for r in rows} == {1, 2}  # the second entry never varies
    assert sum(r.vec_id == 2 for r in rows) == 4 and rows[0].identity_error < 1e-9
    passed = df.select("vec_id", "x", whitening.fixed_point("embedding").alias("v"), "n")
    assert set(whitening.whiten(passed, "v", whitening.fit(passed.where("v is not null"), "v")).columns) == {"vec_id", "x", "v", "n", "deviation", "whitened", "explained"}


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]])
def test_nothing_varies(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert whitening.components_of(df, "embedding", "vec_id").collect() == []


def test_lengths_are_lists_of_their_own(spark):
    df = spark.createDataFrame([(i, [float(i), float(i * i % 7)][: 1 + i % 2]) for i in range(20)], "vec_id long, embedding array<double>")
    rows = whitening.components_of(df, "embedding", "vec_id").collect()
    assert {r.n for r in rows} == {10} and len(rows) == 10 + 20


def test_huge_entries(spark):
    df = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [5.0, 2.0])], "vec_id long, embedding array<double>")
    rows = whitening.components_of(df, "embedding", "vec_id").collect()
    assert {r.deviation for r in rows if r.vec_id == 1} == {None} and len(rows) == 6
