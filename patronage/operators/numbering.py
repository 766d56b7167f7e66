"""Row numbers inside groups of any size."""
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from patronage.sources.store import settle


def numbered(df: DataFrame, group: list, order: list, to: str) -> DataFrame:
    """``df`` with the place (from 1) of each row in its group by ``order``, which must not have ties.

    Rows are dealt by ranges of (group, order), so a group that holds most of the rows spreads over many tasks. Each task
    numbers its own stretch of a group; the sizes of the stretches before it, a few numbers for each group that spans tasks,
    are added afterwards.
    """
    ranged = settle(df.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id()))
    local = Window.partitionBy(*group, "_range").orderBy(*order)
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy(*group, "_range").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(before)).where("_before is not null")
    offsets = offsets.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_range").alias("_r"), "_before")
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)], F.col("_range") == F.col("_r"))
    placed = ranged.withColumn("_local", F.row_number().over(local)).join(offsets, same, "left")
    return placed.withColumn(to, F.col("_local") + F.coalesce("_before", F.lit(0))).select(*df.columns, to)
