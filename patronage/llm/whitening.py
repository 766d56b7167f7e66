"""Whitening of vectors by shifted Cholesky QR.

The centred rows form a tall matrix X. Each distributed pass sums the Gram matrix of ``X R^-1`` over all rows: the rows are
read, centred and solved against the triangle R found so far, so nothing tall is ever stored. The driver factors the small
Gram matrix (the first one with a shift, which makes it positive whatever the condition of X), multiplies the new factor
onto R and starts the next pass. After three passes ``X = Q R`` holds with Q orthonormal to double precision; the singular
values and right vectors of R are those of X, without the covariance of X, whose condition is the square, being solved.

Vectors come as fixed-point numbers (``fixed_point``): longs, so that sums and squared deviations are exact.

Defined results: vectors that are null, empty, or hold nulls or non-finite entries are dropped; repeated rows and rows with a null
key count and return as often as they come; vectors of different lengths have no common covariance, so each length is a
list of its own; directions without variance are no components, so a single row, equal rows or an empty table give no rows;
equal eigenvalues are numbered as the decomposition gives them. The sign makes the largest entry of a component positive. A deviation beyond the range of a long
is null. Only the named columns are read; others pass through ``whiten`` and lose a name that the result uses.
"""
from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

#: Components that are returned; Gram passes; rows that one matrix product takes; tasks that merge the partial sums.
COMPONENTS, PASSES, ROWS, MERGERS = 8, 3, 4096, 8
#: Entries are cut to this range (of a product that overflows too), so sums of longs hold for any finite entry.
WIDEST = 2.0**53
ROUNDING = 2.0**-53


def fixed_point(vector: Column | str, scale: float = 1024, offset: int = 100_000) -> Column:
    """``floor(scale * c) + offset`` for each entry as a long; null for a vector that is null or holds a null or non-finite entry."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    real = F.transform(vector, lambda c: c.cast("double"))
    sound = F.forall(real, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    cut = lambda c: F.greatest(F.least(c * float(scale), F.lit(WIDEST)), F.lit(-WIDEST))
    return F.when(sound, F.transform(real, lambda c: F.floor(cut(c)).cast("long") + F.lit(offset).cast("long")))


def _by_length(array: pa.Array):
    """(row numbers, matrix of longs) for each length among the vectors, at most ``ROWS`` rows at once."""
    sizes = np.asarray(pc.list_value_length(array).to_numpy(zero_copy_only=False), dtype=np.int64)
    flat = array.flatten().to_numpy(zero_copy_only=False)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        for a in range(0, len(rows), ROWS):
            part = rows[a : a + ROWS]
            yield part, flat[first[part][:, None] + np.arange(d)]


def _gathered(vectors: DataFrame, measure) -> dict:
    """Sums over all rows, by length: ``measure(length, matrix)`` gives a list of arrays. Partial sums merge in a few tasks."""

    def add(total: dict, d: int, part: list) -> None:
        total[d] = [x + y for x, y in zip(total[d], part)] if d in total else part

    def told(total: dict):
        for d, part in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int64()), pa.array([pickle.dumps(part)], pa.binary())], names=["d", "sums"])

    def first(batches):
        total: dict = {}
        for batch in batches:
            for rows, x in _by_length(batch.column(0)):
                add(total, x.shape[1], measure(x.shape[1], x))
        yield from told(total)

    def second(batches):
        total: dict = {}
        for batch in batches:
            for d, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                add(total, d, pickle.loads(part))
        yield from told(total)

    schema, total = "d long, sums binary", {}
    merged = vectors.mapInArrow(first, schema).repartition(MERGERS).mapInArrow(second, schema)
    for d, part in sorted(merged.collect()):
        add(total, d, pickle.loads(bytes(part)))
    return total


def _sums(d: int, x: np.ndarray) -> list:
    """Number of rows and exact sums, as Python numbers (halves of the longs add without overflow)."""
    high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
    return [len(x), high.astype(object) * 2**32 + low.astype(object)]


def _spread(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``n * x - S``, exactly: longs where they fit, else Python numbers."""
    mean = sums // n
    near = (x - mean.astype(np.int64)).astype(np.float64)
    if np.abs(near).max(initial=0) * n < 2.0**61:
        return n * (x - mean.astype(np.int64)) - (sums - n * mean).astype(np.int64)
    return n * x.astype(object) - sums


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return _spread(x, n, sums).astype(np.float64) / n


def _solved(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """``x R^-1`` for an upper triangle R, column by column of R."""
    out = np.empty_like(x)
    for j in range(r.shape[0]):
        out[:, j] = (x[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
    return out


def _factor(gram: np.ndarray, shift: float) -> np.ndarray:
    """The upper Cholesky triangle of ``gram + shift``; the shift grows until the matrix is positive."""
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(len(gram))).T
        except np.linalg.LinAlgError:
            shift = max(10 * shift, len(gram) ** 2 * ROUNDING * max(np.trace(gram), np.finfo(float).tiny))


def fit(vectors: DataFrame, column: str, components: int = COMPONENTS) -> dict:
    """By vector length: n, sums, basis (length x components), eigenvalues, trace. ``column`` holds arrays of longs."""
    only = vectors.select(column)
    models = {d: {"n": n, "sums": sums, "r": None} for d, (n, sums) in _gathered(only, _sums).items()}
    for _ in range(PASSES):

        def gram(d: int, x: np.ndarray) -> list:
            m = models[d]
            q = _centred(x, m["n"], m["sums"])
            q = q if m["r"] is None else _solved(q, m["r"])
            return [q.T @ q]

        for d, (g,) in _gathered(only, gram).items():
            m = models[d]
            if m["r"] is None:
                m["trace"] = float(np.trace(g))
                m["r"] = _factor(g, 11 * (m["n"] * d + d * (d + 1)) * ROUNDING * m["trace"]) if m["trace"] else None
            elif m["trace"]:
                m["r"] = _factor(g, 0.0) @ m["r"]
        if not any(m["trace"] for m in models.values()):
            break
    for d, m in models.items():
        r = m.pop("r")
        if r is None:
            m["basis"], m["values"] = np.zeros((d, 0)), np.zeros(0)
            continue
        _, s, v = np.linalg.svd(r)
        s = s[: int((s > s[0] * max(m["n"], d) * 2 * ROUNDING).sum())][:components]
        basis = v[: len(s)].T
        m["basis"] = basis * np.where(np.take_along_axis(basis, np.abs(basis).argmax(axis=0)[None], 0) < 0, -1.0, 1.0)
        m["values"], m["trace"] = s**2 / m["n"], m["trace"] / m["n"]
    return models


def _whitened(x: np.ndarray, m: dict) -> np.ndarray:
    return _centred(x, m["n"], m["sums"]) @ m["basis"] / np.sqrt(m["values"])


def identity_error(vectors: DataFrame, column: str, models: dict) -> float:
    """The largest absolute entry of (covariance of the whitened rows - identity), summed anew over all rows."""

    def moments(d: int, x: np.ndarray) -> list:
        w = _whitened(x, models[d])
        return [w.T @ w, w.sum(axis=0)]

    worst = 0.0
    for d, (squares, sums) in _gathered(vectors.select(column), moments).items():
        n = models[d]["n"]
        worst = max(worst, float(np.abs(squares / n - np.outer(sums / n, sums / n) - np.eye(len(sums))).max(initial=0)))
    return worst


def _deviations(x: np.ndarray, m: dict) -> list:
    y = _spread(x, m["n"], m["sums"])
    if y.dtype != object and x.shape[1] * float(np.abs(y).max(initial=0)) ** 2 < 2.0**62:
        return (y * y).sum(axis=1).tolist()
    return [int(v) if v < 2**63 else None for v in (sum(int(c) ** 2 for c in row) for row in y)]


RESULT = {"n": LongType(), "deviation": LongType(), "whitened": ArrayType(DoubleType()), "explained": ArrayType(DoubleType())}


def whiten(df: DataFrame, column: str, models: dict) -> DataFrame:
    """Rows of ``df`` with a vector, plus n, deviation, and one entry a component in the arrays whitened and explained."""
    base = df.where(F.size(column) > 0).drop(*(c for c in df.columns if c.lower() in RESULT))
    names = base.columns

    def run(batches):
        for batch in batches:
            out: list = [None] * batch.num_rows
            for rows, x in _by_length(batch.column(names.index(column))):
                m = models[x.shape[1]]
                shares = (m["values"] / m["trace"]).tolist() if m["trace"] else []
                for i, deviation, w in zip(rows.tolist(), _deviations(x, m), _whitened(x, m).tolist()):
                    out[i] = (m["n"], deviation, w, shares)
            made = zip(*out) if out else [[], [], [], []]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(list(v), kind) for v, kind in zip(made, kinds))], names=[*names, *RESULT])

    return base.mapInArrow(run, StructType([*base.schema.fields, *(StructField(k, v) for k, v in RESULT.items())]))


def components_of(df: DataFrame, vector: str, key: str, components: int = COMPONENTS, scale: float = 1024, offset: int = 100_000) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error), one row a vector and component."""
    fixed = df.select(F.col(key).alias("key"), fixed_point(vector, scale, offset).alias("x")).where(F.size("x") > 0)
    models = fit(fixed, "x", components)
    error = identity_error(fixed, "x", models)
    every = whiten(fixed, "x", models).select("key", "n", "deviation", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "value"))
    return every.select(F.col("key").alias(key), (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "value.whitened", "value.explained", F.lit(error).alias("identity_error"))
