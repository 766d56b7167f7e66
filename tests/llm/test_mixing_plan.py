"""The slots of a mix grow with the words; planned by the few rows they come from, they would be broadcast through the driver."""
import re

from pyspark.sql import functions as F

from patronage.llm import mixing


def test_slots_are_not_broadcast(spark):
    docs = spark.range(200).select("id", F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source")).select(
        F.col("id").alias("key"), "source", (F.col("id") % 7 * 100 + 50).cast("long").alias("size"))
    _, pieces = mixing.mix(docs)
    rows = pieces.count()
    pieces.collect()
    plan = pieces._jdf.queryExecution().executedPlan().toString()
    joins = [x for x in re.findall(r"(\w+Join) ([^\n]*)", plan) if "block_no" in x[1]]
    assert rows and joins and {kind for kind, _ in joins} == {"SortMergeJoin"}
