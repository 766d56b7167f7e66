"""Pipeline health and the life of incidents."""
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from patronage.functions.vocabulary import FIXED_LIMITS as L


@dataclass(frozen=True)
class Thresholds:
    queue_minutes: int = 15
    sheet_minutes: int = 30
    mirror_minutes: int = 30
    error_window_minutes: int = 15
    error_spike: int = 10


def _issue(df: DataFrame, code: str, severity: str, count: Column, age: Column | None = None) -> DataFrame:
    n = df.agg(count.cast("long").alias("count"), (age if age is not None else F.lit(None)).cast("long").alias("age_minutes"))
    return n.where("count > 0").select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), "count", "age_minutes")


def evaluate(inbound: DataFrame, customers: DataFrame, purchases: DataFrame, intents: DataFrame, errors: DataFrame, now: str,
             th: Thresholds = Thresholds()) -> DataFrame:
    """Open issues, one row each. Every table is read once by one filtered aggregate per concern.

    ``inbound``: status, received_at, due_at. Synced tables: ``*_dirty``, sync_attempts, updated_at.
    """
    at = F.lit(now).cast("timestamp")
    cut = lambda minutes: F.timestamp_seconds(F.unix_timestamp(at) - minutes * 60)
    minutes = lambda c: F.floor((F.unix_timestamp(at) - F.unix_timestamp(c)) / 60)
    old = lambda rows, c: (F.least(F.count("*"), F.lit(1)), F.greatest(F.lit(0), minutes(F.min(c))))
    parts = [_issue(inbound, "inbound.dead", "critical", F.count_if(F.col("status") == "dead"))]
    stuck = inbound.where(((F.col("status") == "pending") & (F.col("due_at") <= cut(th.queue_minutes)))
                          | ((F.col("status") == "processing") & (F.col("due_at") <= cut(th.queue_minutes)))
                          | ((F.col("status") == "failed") & (F.col("received_at") <= cut(th.queue_minutes))))
    parts.append(_issue(stuck, "inbound.stale", "warning", *old(stuck, "received_at")))
    dead = lambda flag: F.col(flag) & (F.col("sync_attempts") >= L["max_attempts"])
    parts.append(_issue(customers, "sheet.dead", "critical", F.count_if(dead("sheet_dirty"))))
    sheet = customers.where(F.col("sheet_dirty") & (F.col("updated_at") <= cut(th.sheet_minutes)))
    parts.append(_issue(sheet, "sheet.stale", "warning", *old(sheet, "updated_at")))
    slim = [d.select("ai_dirty", "updated_at", F.col("sync_attempts") if "sync_attempts" in d.columns else F.lit(0).alias("sync_attempts"))
            for d in (customers, purchases, intents)]
    synced = reduce(DataFrame.unionByName, slim)
    parts.append(_issue(synced, "ai_mirror.dead", "critical", F.count_if(dead("ai_dirty"))))
    behind = synced.where(F.col("ai_dirty") & (F.col("updated_at") <= cut(th.mirror_minutes)))
    parts.append(_issue(behind, "ai_mirror.stale", "warning", *old(behind, "updated_at")))
    recent = errors.where(F.col("at") >= cut(th.error_window_minutes)).agg(F.count("*").alias("n")).where(F.col("n") >= th.error_spike)
    parts.append(recent.select(F.lit("workflow.error_spike").alias("code"), F.lit("warning").alias("severity"),
                               F.col("n").alias("count"), F.lit(th.error_window_minutes).cast("long").alias("age_minutes")))
    return reduce(DataFrame.unionByName, parts)


def oldest_row(df: DataFrame, at: str, key: str) -> DataFrame:
    return df.agg(F.min(F.struct(at, key)).alias("m")).select(f"m.{key}", f"m.{at}")


def update_incidents(issues: DataFrame, state: DataFrame, now: str) -> DataFrame:
    """Next incident table with an ``action``: reported, still_open, resolved or unchanged."""
    ts = F.lit(now).cast("timestamp")
    new = issues.select("code", F.col("severity").alias("_sev"), F.lit(True).alias("_now"))
    j = state.withColumn("_old", F.lit(True)).join(new, "code", "full_outer")
    seen, was_open = F.coalesce("_now", F.lit(False)), F.coalesce((F.col("status") == "open") & F.col("reported_at").isNotNull(), F.lit(False))
    action = (F.when(seen & was_open, "still_open").when(seen, "reported")
              .when(F.coalesce(F.col("status") == "open", F.lit(False)), "resolved").otherwise("unchanged"))
    j = j.withColumn("action", action)
    is_ = lambda a: F.col("action") == a
    return j.select(
        "code", F.coalesce(F.when(is_("reported"), F.col("_sev")), "severity", "_sev").alias("severity"),
        F.when(seen, "open").when(is_("resolved"), "resolved").otherwise(F.col("status")).alias("status"),
        F.when(is_("reported"), ts).otherwise(F.col("first_seen_at")).alias("first_seen_at"),
        F.when(is_("unchanged"), F.col("last_seen_at")).otherwise(ts).alias("last_seen_at"),
        F.when(is_("reported"), ts).otherwise(F.col("reported_at")).alias("reported_at"),
        F.when(is_("reported"), None).when(is_("resolved"), ts).otherwise(F.col("resolved_at")).alias("resolved_at"),
        (F.coalesce("occurrences", F.lit(0)) + seen.cast("int")).alias("occurrences"), "action")
