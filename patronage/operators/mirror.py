"""Incremental mirrors by high-water mark, without queues or locks."""
from pyspark.sql import DataFrame, functions as F


def pending(source: DataFrame, mirror: DataFrame, key: str, full: bool = False) -> DataFrame:
    """Source rows the mirror lacks or holds in an older version."""
    if full:
        return source
    held = mirror.select(key, F.col("source_updated_at").alias("_held"))
    return source.join(held, key, "left").where(F.col("_held").isNull() | (F.col("updated_at") > F.col("_held"))).drop("_held")


def advance(source: DataFrame, mirror: DataFrame, key: str, scrub, full: bool = False) -> DataFrame:
    """The next mirror snapshot. Rows carry the source version they came from, so a row that
    changes after the read stays pending for the next run; vanished rows are pruned."""
    todo = pending(source, mirror, key, full)
    fresh = scrub(todo)
    kept = mirror.join(todo.select(key), key, "left_anti").join(source.select(key), key, "left_semi")
    return kept.unionByName(fresh, allowMissingColumns=True)


def completeness(source: DataFrame, mirror: DataFrame, key: str) -> DataFrame:
    """Counts on both sides, missing and stale rows, and whether the mirror is complete."""
    s = source.select(key, F.col("updated_at").alias("s"))
    m = mirror.select(key, F.col("source_updated_at").alias("m"))
    j = s.withColumn("_s", F.lit(True)).join(m.withColumn("_m", F.lit(True)), key, "full_outer")
    out = j.agg(F.count("_s").alias("source_rows"), F.count("_m").alias("mirror_rows"), F.count_if(F.col("_m").isNull()).alias("missing"),
                F.count_if(F.col("_s").isNull()).alias("orphans"), F.count_if(F.col("s") > F.col("m")).alias("pending"))
    return out.withColumn("ok", (F.col("missing") == 0) & (F.col("orphans") == 0) & (F.col("pending") == 0))
