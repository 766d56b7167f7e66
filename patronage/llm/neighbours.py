"""Approximate nearest neighbours by several shifted space-filling curves.

Vectors are projected to a few random directions per curve, shifted, cut to a grid and numbered along a Hilbert curve.
Spark range-partitions all rows by (curve, number), which gives every row its place on each curve. A query is compared with
the rows of a window around its own place on every curve; the windows' best rows merge, and the best are scored again
exactly. Inner products become distances by one more coordinate that brings all rows to the same length, while queries
have none in it.

The window is not a constant: on ``SAMPLE`` queries, picked by hash, the true neighbours are found by comparing with all
rows, and the window is the distance on the nearest curve within which the share ``REACH`` of them lies. Data with few
real dimensions give narrow windows; for vectors without such structure no order of the line keeps neighbours together and
the windows honestly grow to a fixed share of all rows.

Defined results: rows with a null id, a null, empty or zero vector, or null or non-finite components take no part; vectors
of other lengths than the commonest one neither; of equal vectors only the ``k`` + 1 smallest ids can be among the nearest,
and only they are entered on the curves; of rows with one id the one whose contents hash is
smallest counts; a query with
fewer than ``k`` candidates gets all of them; other columns are ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from patronage.llm.lattice import matrix
from patronage.llm.shared import settle

CURVES, DIMENSIONS, BITS, SAMPLE, REACH = 4, 8, 6, 64, 0.96
#: Least rows of a zone, zones to a window, and queries that one task holds.
BLOCK, ZONES, QUERIES = 1024, 4, 2048


def hilbert(grid: np.ndarray, bits: int) -> np.ndarray:
    """Numbers along the Hilbert curve of points of a grid with ``bits`` bits per axis (axes * bits at most 62).

    From the coarsest bit down the axes are exchanged or mirrored as the curve turns, which leaves the Gray code of the
    number; undoing the Gray code and interleaving the bits gives the number.
    """
    x = grid.T.astype(np.int64).copy()
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for axis in range(len(x)):
            upper = (x[axis] >> level) & 1 == 1
            swap = np.where(upper, 0, (x[0] ^ x[axis]) & low)
            x[0] ^= np.where(upper, low, swap)
            x[axis] ^= swap
    for axis in range(1, len(x)):
        x[axis] ^= x[axis - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    number = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for axis in x ^ turn:
            number = number << 1 | (axis >> level) & 1
    return number


def numbers(x: np.ndarray, curves: int, dimensions: int, bits: int, seed: int) -> np.ndarray:
    """(rows, curves): numbers on each curve, of vectors no longer than 1."""
    out = np.zeros((len(x), curves), dtype=np.int64)
    r = np.random.default_rng([seed, x.shape[1]])
    for c in range(curves):
        y = x @ r.normal(0, 1, (x.shape[1], dimensions))
        # a projection has a spread of at most 1; +-3 fills half of the grid, and the shift moves it within the rest
        at = (y + 3) / 6 * (1 << (bits - 1)) + r.uniform(0, 1 << (bits - 1), dimensions)
        out[:, c] = hilbert(np.clip(at, 0, (1 << bits) - 1).astype(np.int64), bits)
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best, ties to the smaller id."""
    if len(scores) > k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))][:k]


def _on_curves(curves: int, dimensions: int, bits: int, seed: int, longest: float):
    def run(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, 2048):
                batch = whole.slice(a, 2048)
                x = matrix(batch.column("v")) / longest
                rest = np.sqrt(np.maximum(0.0, 1 - (x * x).sum(axis=1)))
                n = numbers(np.column_stack([x, rest]), curves, dimensions, bits, seed)
                where = np.repeat(np.arange(len(x)), curves)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(where)) for c in ("id", "class")), pa.array(np.tile(np.arange(curves, dtype=np.int32), len(x))), pa.array(n.reshape(-1)), batch.column("v").take(pa.array(where))],
                                                 names=["id", "class", "curve", "number", "v"])

    return run


def _local(batches):
    at = 0
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(at, at + batch.num_rows))], names=[*batch.schema.names, "local"])
        at += batch.num_rows


def _exact(queries: np.ndarray, classes: list, k: int):
    """The best k rows of one partition for each of a few queries."""

    def run(batches):
        held = [(np.zeros(0), np.zeros(0, dtype=np.int64))] * len(queries)
        for batch in batches:
            if not batch.num_rows:
                continue
            scores, ids = queries @ matrix(batch.column("v")).T, batch.column("id").to_numpy()
            for q in range(len(queries)):
                s, i = np.concatenate([held[q][0], scores[q]]), np.concatenate([held[q][1], ids])
                best = _best(s, i, k)
                held[q] = s[best], i[best]
        sizes = [len(s) for s, _ in held]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(classes, dtype=object), sizes), pa.string()), pa.array(np.concatenate([i for _, i in held])), pa.array(np.concatenate([s for s, _ in held]))], names=["class", "id", "score"])

    return run


def _compared(k: int):
    """The best rows of a zone for each of its queries.

    Rows stream past, sorted by zone, queries first; a task holds the queries of one zone and slice and their best rows.
    Twice ``k`` are kept, so that equal vectors at the end of the list do not push out each other's smaller ids.
    """
    names, keep = ["class", "id", "score"], 2 * k

    class Zone:
        def __init__(self):
            self.classes, self.asked, self.best, self.ids = [], [], None, None

        def add(self, part: pa.RecordBatch):
            asks, x, ids = part.column("asks").to_numpy(zero_copy_only=False), matrix(part.column("v")), part.column("id").to_numpy()
            if asks.any():
                self.asked.append(x[asks])
                self.classes += part.column("class").filter(part.column("asks")).to_pylist()
            own, ids = x[~asks], ids[~asks]
            if not self.asked or not len(own):
                return
            if self.best is None:
                self.q = np.concatenate(self.asked)
                self.best, self.ids = np.full((len(self.q), keep), -np.inf), np.full((len(self.q), keep), -1, dtype=np.int64)
            for a in range(0, len(self.q), 256):
                rows = slice(a, a + 256)
                scores = np.concatenate([self.best[rows], self.q[rows] @ own.T], axis=1)
                place = np.argpartition(-scores, keep - 1, axis=1)[:, :keep]
                everyone = np.concatenate([self.ids[rows], np.broadcast_to(ids, (len(scores), len(ids)))], axis=1)
                self.best[rows], self.ids[rows] = np.take_along_axis(scores, place, 1), np.take_along_axis(everyone, place, 1)

        def result(self):
            if self.best is None:
                return None
            q, at = np.nonzero(np.isfinite(self.best))
            classes = pa.array(self.classes, pa.string()).take(pa.array(q))
            return pa.RecordBatch.from_arrays([classes, pa.array(self.ids[q, at]), pa.array(self.best[q, at])], names=names)

    def run(batches):
        zone, now = Zone(), None
        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in ("curve", "zone", "slice")]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in keys], axis=0)) + 1 if batch.num_rows else []
            for a, b in zip([0, *change], [*change, batch.num_rows]):
                if a == b:
                    continue
                key = tuple(c[a] for c in keys)
                if key != now:
                    if (got := zone.result()) is not None:
                        yield got
                    zone, now = Zone(), key
                for at in range(a, b, 2048):
                    zone.add(batch.slice(at, min(2048, b - at)))
        if (got := zone.result()) is not None:
            yield got

    return run


def _top(rows: DataFrame, by: str, k: int) -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.desc("score"), "id")
    return rows.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= k)


def search(vectors: DataFrame, is_query: Column, key: str = "vec_id", column: str = "embedding", k: int = 20, curves: int = CURVES, dimensions: int = DIMENSIONS, bits: int = BITS, sample: int = SAMPLE, reach: float = REACH, block: int = BLOCK, seed: int = 13) -> DataFrame:
    """(query_id, rank, ``key``, score): the ``k`` rows of largest inner product found for each row that ``is_query``."""
    v = F.col(column).cast("array<double>")
    rows = vectors.withColumn("_asks", F.coalesce(is_query, F.lit(False))).select(F.col(key).cast("long").alias("id"), "_asks", v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    largest = F.aggregate("v", F.lit(0.0), lambda acc, x: F.when(x.isNull() | F.isnan(x), F.lit(float("inf"))).otherwise(F.greatest(acc, F.abs(x))))
    rows = rows.withColumn("largest", largest).where((F.col("largest") > 0) & (F.col("largest") < float("inf")))
    norm = F.col("largest") * F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + (x / F.col("largest")) * (x / F.col("largest"))))
    rows = settle(rows.select("id", F.col("_asks").alias("asks"), "v", norm.alias("norm"), F.sha2(F.array_join(F.transform("v", lambda x: (x + 0.0).cast("string")), ","), 256).alias("class")))
    spark = rows.sparkSession
    lengths = rows.groupBy(F.size("v").alias("length")).agg(F.count("*").alias("n"), F.max("norm").alias("longest")).orderBy(F.desc("n"), "length").first()
    if lengths is None:
        return spark.createDataFrame([], f"query_id long, rank int, {key} long, score double")
    by_id = Window.partitionBy("id").orderBy("class", F.desc("asks"))
    rows = rows.where(F.size("v") == lengths["length"]).withColumn("turn", F.row_number().over(by_id)).where("turn = 1").drop("turn")

    # candidates: of equal vectors the k + 1 smallest ids; queries: distinct vectors
    smallest = Window.partitionBy("class").orderBy("id")
    entered = rows.select("id", "class", "v").withColumn("turn", F.row_number().over(smallest)).where(F.col("turn") <= k + 1).drop("turn")
    asking = rows.where("asks").select("id", "class")

    # places on the curves
    on = entered.mapInArrow(_on_curves(curves, dimensions, bits, seed, lengths["longest"]), "id long, class string, curve int, number long, v array<double>")
    tasks = max(curves, spark.sparkContext.defaultParallelism, lengths["n"] * curves // 200_000)
    dealt = on.repartitionByRange(tasks, "curve", "number", "id").sortWithinPartitions("curve", "number", "id").withColumn("part", F.spark_partition_id())
    dealt = settle(dealt.mapInArrow(_local, "id long, class string, curve int, number long, v array<double>, part int, local long"))
    parts = dealt.groupBy("curve", "part").agg(F.count("*").alias("n"), F.min("local").alias("first"))
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).select("curve", "part", "offset")
    placed = settle(dealt.join(offsets, ["curve", "part"]).withColumn("place", F.col("offset") + F.col("local")).select("id", "class", "curve", "place", "v"))
    # a query stands where the first row of its class stands
    first = placed.groupBy("class", "curve").agg(F.min("place").alias("place"))
    asked = asking.select("class").distinct()
    query_places = settle(first.join(asked, "class"))

    # the window, from a sample of queries compared with all rows
    picked = asking.select("class").distinct().orderBy(F.xxhash64("class"), "class").limit(sample)
    chosen = placed.where("curve = 0").join(F.broadcast(picked), "class").groupBy("class").agg(F.min(F.struct("id", "v")).alias("one")).select("class", "one.v").orderBy("class").collect()
    if not chosen:
        return spark.createDataFrame([], f"query_id long, rank int, {key} long, score double")
    queries, names = np.array([r["v"] for r in chosen]), [r["class"] for r in chosen]
    truth = _top(placed.where("curve = 0").select("id", "v").mapInArrow(_exact(queries, names, k + 1), "class string, id long, score double"), "class", k + 1)
    away = truth.select(F.col("class").alias("q"), "id").join(placed.select("id", "curve", "place"), "id")
    away = away.join(query_places.select(F.col("class").alias("q"), "curve", F.col("place").alias("own")), ["q", "curve"])
    nearest = away.groupBy("q", "id").agg(F.min(F.abs(F.col("place") - F.col("own"))).alias("away"))
    window = int(nearest.agg(F.percentile("away", F.lit(reach))).first()[0] + 1)

    # the windows are cut into zones, about ``ZONES`` to a window, and a query visits the zones that its window touches
    heads = placed.where("curve = 0").groupBy("class").agg(F.min(F.struct("id", "v")).alias("one")).select("class", F.col("one.v").alias("v"))
    wide = max(block, -(-2 * window // ZONES))
    share = asked.count() / max(1, lengths["n"])
    groups = max(1, int(np.ceil((2 * window + wide) * share / QUERIES)))
    low, high = F.floor(F.greatest(F.col("place") - window, F.lit(0)) / wide), F.floor((F.col("place") + window) / wide)
    visits = query_places.join(heads, "class").select("class", F.lit(0).cast("long").alias("id"), "curve", F.explode(F.sequence(low, high)).alias("zone"), F.pmod(F.xxhash64("class"), F.lit(groups)).cast("int").alias("slice"), F.lit(True).alias("asks"), "v")
    stay = placed.select("class", "id", "curve", F.floor(F.col("place") / wide).alias("zone"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("slice"), F.lit(False).alias("asks"), "v")
    by = ["curve", "zone", "slice"]
    dealt_out = stay.unionByName(visits).repartition(*by).sortWithinPartitions(*by, F.desc("asks"), "id")
    found = dealt_out.mapInArrow(_compared(k + 1), "class string, id long, score double")

    # merge, score exactly in order of the components, and rank for each query
    merged = _top(found.groupBy("class", "id").agg(F.max("score").alias("score")), "class", 2 * (k + 1)).select("class", "id")
    other = rows.select("id", F.col("v").alias("w"))
    exact = merged.join(other, "id").join(heads, "class")
    exact = exact.select("class", "id", F.aggregate(F.zip_with("v", "w", lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x).alias("score"))
    answers = asking.withColumnRenamed("id", "query_id").join(exact, "class").where("id <> query_id")
    ranked = _top(answers, "query_id", k)
    return ranked.select("query_id", F.col("turn").alias("rank"), F.col("id").alias(key), "score")
