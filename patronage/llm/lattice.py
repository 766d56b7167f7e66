"""Near-duplicate embeddings by lattice hashing.

Vectors are scaled to length 1 and equal ones become one class. Each of several tables projects a class to eight random
directions, shifts and scales, and decodes the nearest point of the E8 lattice; the class is entered in that cell and in
the neighbouring cells towards which it leans most. Members of a cell are compared exactly in double precision, in blocks
of bounded size, and only a spanning set of the links found in a block leaves it. Components are joined from these, and
within each component all pairs are compared in blocks again, so that every vector's links are counted without listing
pairs. A pair at cosine 0.95 shares a cell in some table with a probability of about 0.98, one at 0.98 of over 0.9999.

Defined results: null or zero vectors, and vectors with null or non-finite components, link with nothing; vectors of
different lengths are never compared; repeated rows (also with one id) are vectors of their own and link with each other;
a null id takes part, and a component's id is its smallest id that is not null; other columns are ignored.
"""
from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from patronage.llm.graphs import components
from patronage.llm.shared import settle

TABLES, PROBES, SCALE, THRESHOLD = 6, 4, 1.0, 0.95
#: Members of a cell or component that one task compares with as many others at a time.
BLOCK = 1024


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of 1 or -1, or all of 1/2 with an even number of minus signs."""
    two = [a * np.eye(8)[i] + b * np.eye(8)[j] for i in range(8) for j in range(i + 1, 8) for a in (1, -1) for b in (1, -1)]
    halves = [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(two + halves)


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: round, and where the sum is odd round the worst entry the other way."""
    k = np.rint(x)
    off = x - k
    odd = np.flatnonzero(k.sum(axis=1) % 2)
    worst = np.abs(off[odd]).argmax(axis=1)
    k[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return k


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """E8 is D8 and D8 shifted by one half in all entries; the nearer of both nearest points."""
    a, b = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def cells(unit: np.ndarray, tables: int, probes: int, scale: float, seed: int) -> np.ndarray:
    """(rows, tables, 1 + probes) hashes of the own cell and the probed ones."""
    short, out = minimal_vectors(), np.zeros((len(unit), tables, 1 + probes), dtype=np.int64)
    r = np.random.default_rng([seed, unit.shape[1]])
    odd = np.random.default_rng(seed + 1).integers(1, 1 << 62, size=8, dtype=np.int64) | 1
    for t in range(tables):
        x = unit @ r.normal(0, scale, (unit.shape[1], 8)) + r.uniform(0, 1, 8)
        own = nearest_e8(x)
        lean = np.argsort(-((x - own) @ short.T), axis=1, kind="stable")[:, :probes]
        points = np.concatenate([own[:, None], own[:, None] + short[lean]], axis=1)
        with np.errstate(over="ignore"):
            h = ((2 * points).astype(np.int64) * odd).sum(axis=2) + np.int64(t) * np.int64(0x9E3779B97F4A7C1)
            h ^= h >> 29
            out[:, t] = h * np.int64(0x2545F4914F6CDD1D)
    return out


def scaled(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(key, unit, class): vectors at length 1 with a hash of their contents; both null for those that link with nothing."""
    v = F.col(column).cast("array<double>")
    rows = vectors.select(F.col(key).alias("key"), v.alias("v"))
    # the largest entry is divided out first, so that squares neither overflow nor vanish
    top = F.aggregate("v", F.lit(0.0), lambda acc, x: F.when(x.isNull() | F.isnan(x), F.lit(float("inf"))).otherwise(F.greatest(acc, F.abs(x))))
    rows = rows.withColumn("top", top)
    rows = rows.withColumn("v", F.when((F.col("top") > 0) & (F.col("top") < float("inf")), F.transform("v", lambda x: x / F.col("top"))))
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x)))
    rows = rows.select("key", F.transform("v", lambda x: x / F.col("norm") + 0.0).alias("unit"))
    return rows.withColumn("class", F.sha2(F.array_join(F.transform("unit", lambda x: x.cast("string")), ","), 256))


def in_blocks(members: DataFrame, group: str, block: int = BLOCK) -> DataFrame:
    """Deals the members (group, class, unit, ...) of each group to pairs of blocks; adds low, high and own block number.

    A group of up to ``block`` members is one block. Larger ones are cut by hash, and every pair of blocks becomes a task
    of its own, so a task holds about two blocks at most.
    """
    counts = members.groupBy(group).agg(F.count("*").alias("members")).where("members > 1").withColumn("cuts", F.ceil(F.col("members") / block).cast("int"))
    cut = members.join(counts, group).withColumn("own", F.pmod(F.xxhash64("class"), F.col("cuts")).cast("int"))
    return cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).select(
        "*", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")).drop("members", "cuts", "other")


def matrix(column: pa.ListArray) -> np.ndarray:
    """A list column of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def spanning(linked: np.ndarray) -> list:
    """Pairs of row numbers that connect all rows that ``linked`` connects."""
    out, left = [], linked.any(axis=1)
    while left.any():
        front = [int(left.argmax())]
        left[front[0]] = False
        while front:
            k = front.pop()
            for j in np.flatnonzero(linked[k] & left):
                left[j] = False
                front.append(int(j))
                out.append((k, int(j)))
    return out


def _forest(threshold: float):
    """Spanning links (a, b) among the members of one block pair."""

    def run(group: pa.Table):
        x = matrix(group.column("unit").combine_chunks())
        linked = x @ x.T >= threshold
        np.fill_diagonal(linked, False)
        if not linked.any():
            return None
        a, b = zip(*spanning(linked))
        ids = group.column("class").combine_chunks()
        return {"a": ids.take(pa.array(a)), "b": ids.take(pa.array(b))}

    return run


def _counts(threshold: float):
    """Links per class within one block pair, counted in copies; a block's own pairs only where low = high."""

    def run(group: pa.Table):
        x, n, own = matrix(group.column("unit").combine_chunks()), group.column("copies").to_numpy(), group.column("own").to_numpy()
        low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
        linked = x @ x.T >= threshold
        np.fill_diagonal(linked, False)
        if low != high:
            linked &= own[:, None] != own[None, :]
        return {"class": group.column("class").combine_chunks(), "links": pa.array(linked @ n, pa.int64())}

    return run


def per_group(rows: DataFrame, keys: list, run, schema: str) -> DataFrame:
    """Applies ``run`` to the rows of each group, as an Arrow table; groups are sorted together and streamed past.

    As ``applyInPandas`` would do it, but with small groups at little cost each. A task holds one group at a time.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def stream(batches):
        held: list = []

        def flush():
            got = run(pa.Table.from_batches(held))
            held.clear()
            return got

        now = None
        for batch in batches:
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1 if batch.num_rows else []
            out = []
            for a, b in zip([0, *change], [*change, batch.num_rows]):
                if a == b:
                    continue
                key = tuple(c[a] for c in cols)
                if held and key != now and (got := flush()):
                    out.append(got)
                now = key
                held.append(batch.slice(a, b - a))
            if out:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([o[n] for o in out]) for n in names], names=names)
        if held and (got := flush()):
            yield pa.RecordBatch.from_arrays([got[n] for n in names], names=names)

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(stream, schema)


def near_duplicates(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, threshold: float = THRESHOLD, seed: int = 9) -> DataFrame:
    """(``key``, n_links, component_id, kept), one row per row of ``vectors``."""
    every = settle(scaled(vectors, key, column))
    classes = settle(every.where(F.col("class").isNotNull()).groupBy("class").agg(F.first("unit").alias("unit"), F.count("*").alias("copies")))

    def hashed(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, 2048):
                batch = whole.slice(k, 2048)
                column_ = batch.column("unit")
                flat, offsets = column_.flatten().to_numpy(), column_.offsets.to_numpy()
                offsets = offsets - offsets[0]
                sizes = np.diff(offsets)
                all_cells = np.zeros((batch.num_rows, tables * (1 + probes)), dtype=np.int64)
                for size in np.unique(sizes):
                    rows = np.flatnonzero(sizes == size)
                    x = np.stack([flat[offsets[i] : offsets[i + 1]] for i in rows])
                    all_cells[rows] = cells(x, tables, probes, scale, seed).reshape(len(rows), -1) ^ int(size)
                values = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * all_cells.shape[1]), pa.array(all_cells.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column("class"), column_, values], names=["class", "unit", "cells"])

    placed = classes.select("class", "unit").mapInArrow(hashed, "class string, unit array<double>, cells array<long>")
    entered = placed.select("class", "unit", F.size("unit").alias("length"), F.explode(F.array_distinct("cells")).alias("cell"))
    links = per_group(in_blocks(settle(entered), "cell"), ["cell", "length", "low", "high"], _forest(threshold), "a string, b string").distinct()
    joined = settle(components(links))
    members = classes.join(joined, F.col("class") == F.col("node")).select("component", "class", "unit", "copies")
    counted = per_group(in_blocks(settle(members), "component"), ["component", "low", "high"], _counts(threshold), "class string, links long")
    direct = counted.groupBy("class").agg(F.sum("links").alias("links"))
    group = F.coalesce("component", "class")
    named = classes.select("class", "copies").join(joined.select(F.col("node").alias("class"), "component"), "class", "left").join(direct, "class", "left").withColumn("group", group)
    known = every.select("key", "class").join(named, "class")
    smallest = known.groupBy("group").agg(F.min("key").alias("component_id"))
    linked = known.join(smallest, "group").select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    alone = every.where(F.col("class").isNull()).select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    both = linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("key") == F.col("component_id"), F.lit(False)))
    return both.withColumnRenamed("key", key)
