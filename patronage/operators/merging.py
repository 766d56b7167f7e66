"""Merges of one run that meet: chains, several losers of one winner, losers with two winners, cycles.

Pairs are resolved to connected groups first. Each group has one survivor, then every table is re-keyed once, whatever the
length of its chains, and current opinions are decided again for the survivors alone.
"""
from pyspark.sql import DataFrame, functions as F

from patronage.operators.identity import apply_merges, rekey
from patronage.operators.intents import mark_superseded
from patronage.sources.store import settle


def connected(links: DataFrame) -> DataFrame:
    """(node, label) of undirected links (a, b): the smallest node of each group.

    Every round a node takes the smallest label among its neighbours, and then its label's label, so labels travel twice as
    far each time; rounds grow with the logarithm of the longest chain. Labels are minima, so a node with many links is
    summed up before the shuffle.
    """
    both = settle(links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct())
    labels = settle(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label")))
    while True:
        offers = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("offer"))
        nearer = labels.join(offers, "node").select("node", F.least("label", "offer").alias("label"), F.col("label").alias("was"))
        jump = nearer.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = settle(nearer.join(jump, "label", "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label"), "was"))
        if moved.where("label <> was").isEmpty():
            return moved.select("node", "label")
        labels = moved.select("node", "label")


def resolve_merges(merges: DataFrame) -> DataFrame:
    """(winner_id, loser_id) with one survivor a group: the smallest id that no merge makes a loser, in a cycle the smallest id."""
    pairs = merges.where("winner_id <> loser_id").select(F.col("winner_id").alias("a"), F.col("loser_id").alias("b")).distinct()
    groups = connected(pairs).join(pairs.select(F.col("b").alias("node"), F.lit(True).alias("loses")).distinct(), "node", "left")
    groups = settle(groups.select("node", "label", F.coalesce("loses", F.lit(False)).alias("loses")))
    roots = groups.groupBy("label").agg(F.min(F.struct("loses", "node")).alias("root")).select("label", F.col("root.node").alias("winner_id"))
    return groups.join(roots, "label").where("node <> winner_id").select("winner_id", F.col("node").alias("loser_id"))


def merge_run(customers: DataFrame, merges: DataFrame, children: dict, now: str) -> dict:
    """All tables after a run of merges: ``customers``, every child re-keyed, ``intents`` with the survivors' current rows decided anew, and ``moved``.

    ``children``: tables with a customer_id by name. ``moved`` has a row for each survivor and table: how many rows came.
    """
    final = settle(resolve_merges(merges))
    out = {name: rekey(df, final) for name, df in children.items()}
    to = final.select(F.col("loser_id").alias("customer_id"), "winner_id")
    moved = [df.select("customer_id").join(to, "customer_id").groupBy("winner_id").agg(F.count("*").alias("n")).select("winner_id", F.lit(name).alias("child"), "n") for name, df in children.items()]
    if moved:
        out["moved"] = moved[0]
        for df in moved[1:]:
            out["moved"] = out["moved"].unionByName(df)
    if "intents" in out:
        won = final.select(F.col("winner_id").alias("customer_id")).distinct()
        old = out["intents"]
        if "superseded_at" not in old.columns:
            old = old.withColumn("superseded_at", F.lit(None).cast("timestamp"))
        out["intents"] = mark_superseded(old.join(won, "customer_id", "left_semi").select(*old.columns), now).unionByName(old.join(won, "customer_id", "left_anti").select(*old.columns))
    return out | {"customers": apply_merges(customers, final, now)}
