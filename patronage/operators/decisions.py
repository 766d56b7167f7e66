"""Staff decisions on links, events and merges: applied only from the state the person saw."""
from pyspark.sql import DataFrame, functions as F


def apply_decisions(table: DataFrame, decisions: DataFrame, key: str, status: str, allowed: dict) -> tuple:
    """Updated table, conflicts and audit rows.

    ``decisions``: key, expected, decision, actor, at. The earliest decision per row wins; one made on
    another state than the stored one, or a step not in ``allowed`` (state -> next states), is a conflict.
    """
    first = decisions.groupBy(key).agg(F.min(F.struct("at", "actor", "expected", "decision")).alias("d")).select(key, "d.*")
    step = F.lit(False)
    for state, targets in allowed.items():
        step = step | ((F.col(status) == state) & F.col("decision").isin(list(targets)))
    j = first.join(table.select(key, status), key, "left")
    good = F.coalesce((F.col("expected") == F.col(status)) & step, F.lit(False))
    judged = j.withColumn("ok", good)
    taken = judged.where("ok")
    updated = table.join(taken.select(key, F.col("decision").alias("_to")), key, "left").withColumn(
        status, F.coalesce("_to", status)).drop("_to")
    conflicts = judged.where("not ok").select(
        key, "expected", F.col(status).alias("found"), "decision", "actor", "at")
    audit = taken.select("actor", F.concat(F.lit("decision."), "decision").alias("action"), F.col(key).alias("target"),
                         F.col("expected").alias("before"), F.col("decision").alias("after"), "at")
    return updated, conflicts, audit


# --- Fixed values: allowed steps ---
LINK_STEPS = {"needs_review": ("confirmed", "rejected"), "auto": ("confirmed", "rejected")}
EVENT_STEPS = {"quarantined": ("rejected",), "pending_identity": ("accepted", "rejected")}


def assign_owners(log: DataFrame, decisions: DataFrame, customers: DataFrame) -> tuple:
    """Owners a person gave to waiting events; only active customers and still ownerless events qualify.

    ``decisions``: partner_id, event_id, owner, at. Returns the updated log and the conflicts.
    """
    key = ["partner_id", "event_id"]
    first = decisions.groupBy(*key).agg(F.min(F.struct("at", "owner")).alias("d")).select(*key, "d.owner")
    live = customers.where("status = 'active'").select(F.col("customer_id").alias("owner"), F.lit(True).alias("_live"))
    waiting = log.where("status = 'pending_identity'").select(*key).distinct().withColumn("_waits", F.lit(True))
    judged = first.join(live, "owner", "left").join(waiting, key, "left")
    taken = judged.where("_live and _waits").select(*key, "owner")
    hit = (F.col("status") == "pending_identity") & F.col("owner").isNotNull()
    out = log.join(taken, key, "left").withColumns({
        "customer_id": F.when(hit, F.col("owner")).otherwise(F.col("customer_id")),
        "reason": F.when(hit, "staff").otherwise(F.col("reason")), "status": F.when(hit, "accepted").otherwise(F.col("status"))})
    return out.select(*log.columns), judged.where("_live is null or _waits is null").select(*key, "owner")
