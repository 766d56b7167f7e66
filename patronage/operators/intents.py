"""Opinions per (customer, course): which one is current, and which machine opinions a person overrules."""
from pyspark.sql import Column, DataFrame, functions as F

PAIR = ["customer_id", "course_code"]


def _rank_struct(*extra) -> Column:
    """Newest first, staff before machine, then confidence, creation and id: all by maximum."""
    return F.struct("observed_at", (F.col("source") == "staff").alias("staff"), "confidence", "created_at", "intent_id", *extra)


def current_intents(df: DataFrame) -> DataFrame:
    """The winner of every (customer, course); a null course is a group of its own.

    One maximum per group instead of a sorted window, so partial aggregates absorb a hot pair.
    """
    rest = [c for c in df.columns if c not in ("observed_at", "confidence", "created_at", "intent_id", *PAIR)]
    live = df.where(F.col("customer_id").isNotNull() & F.col("voided_at").isNull())
    top = live.groupBy(*PAIR).agg(F.max(_rank_struct(F.struct(*rest).alias("rest"))).alias("w"))
    return top.select(*PAIR, "w.observed_at", "w.confidence", "w.created_at", "w.intent_id", "w.rest.*").select(*df.columns)


def mark_superseded(df: DataFrame, now: str) -> DataFrame:
    """Owned non-winners get ``superseded_at``; winners get it cleared. Joins on the unique id."""
    old = F.col("superseded_at") if "superseded_at" in df.columns else F.lit(None).cast("timestamp")
    winners = current_intents(df).select("intent_id", F.lit(True).alias("_won"))
    marked = F.when(F.col("customer_id").isNull(), old).when(F.col("_won"), None).otherwise(
        F.coalesce(old, F.lit(now).cast("timestamp")))
    return df.join(winners, "intent_id", "left").withColumn("superseded_at", marked).drop("_won")


def displayable(df: DataFrame) -> DataFrame:
    """Current rows a report may show."""
    shown = df.where(F.col("superseded_at").isNull() & F.col("status").isin("interested", "hesitant", "not_interested"))
    return current_intents(shown)
