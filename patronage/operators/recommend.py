"""Follow-up and upsell lists."""
from pyspark.sql import DataFrame, functions as F

from patronage.functions import vocabulary as V
from patronage.functions.courses import clean_code, course_name, next_courses
from patronage.operators.intents import mark_superseded


def course_history(t) -> DataFrame:
    """Owned active partner lines, and old enrolments only across links a person confirmed."""
    active = t.purchases.where("status = 'active' and customer_id is not null").select("purchase_id", "customer_id", "synthetic")
    partner = t.purchase_items.join(active, "purchase_id").select(
        "customer_id", "course_code", "counts_as_seat", "session_start", F.lit("partner").alias("source"), "synthetic")
    confirmed = t.customer_links.where("status = 'confirmed'").select(
        "customer_id", F.col("legacy_person_id").alias("person_id")).distinct()
    legacy = t.legacy_enrollments.join(confirmed, "person_id").select(
        "customer_id", "course_code", "counts_as_seat", "session_start", F.lit("legacy").alias("source"), "synthetic")
    both = partner.unionByName(legacy).withColumn("course_code", clean_code(F.col("course_code")))
    return both.where("course_code <> ''")


def history_summary(history: DataFrame, now: str) -> DataFrame:
    """Per (customer, course): bought at all, and the last finished session. One aggregation feeds both lists."""
    done = F.col("counts_as_seat") & (F.col("session_start") < F.lit(now).cast("date"))
    last = F.struct("session_start", (F.col("source") == "partner").alias("partner"), F.coalesce("synthetic", F.lit(False)).alias("synthetic"))
    return history.groupBy("customer_id", "course_code").agg(F.max(F.when(done, last)).alias("last")).select(
        "customer_id", "course_code", F.col("last.session_start").alias("completed_at"),
        F.when(F.col("last.partner"), "partner").when(~F.col("last.partner"), "legacy").alias("source"),
        F.coalesce("last.synthetic", F.lit(False)).alias("synthetic"))


def _names(customers: DataFrame) -> DataFrame:
    return customers.where("status = 'active'").select(
        "customer_id", F.coalesce("display_name", "line_display_name", "customer_id").alias("customer_name"), "consent_marketing")


def follow_ups(intents: DataFrame, customers: DataFrame, bought: DataFrame) -> DataFrame:
    """Hesitant current opinions of reachable customers about a course they have not bought."""
    live = intents.where("status = 'hesitant' and voided_at is null and superseded_at is null "
                         "and customer_id is not null and course_code is not null")
    live = live.withColumn("course_code", clean_code(F.col("course_code"))).where("course_code <> ''")
    newest = live.groupBy("customer_id", "course_code").agg(
        F.max(F.struct("observed_at", "intent_id", "hesitation_reason", "confidence")).alias("i"))
    who = _names(customers).where("consent_marketing")
    reason = F.col("i.hesitation_reason")
    action = (F.when(reason == "budget", V.ACTION_BUDGET).when(reason.isin("timing_conflict", "not_ready"), V.ACTION_NEXT_ROUND)
              .otherwise(V.ACTION_GENERAL))
    out = newest.join(bought.select("customer_id", "course_code"), ["customer_id", "course_code"], "left_anti").join(who, "customer_id")
    return out.select(
        F.concat_ws(":", F.lit("follow_up"), "customer_id", "course_code").alias("reco_id"), "customer_id", "customer_name",
        "course_code", course_name(F.col("course_code")).alias("course_name"), reason.alias("hesitation_reason"),
        F.col("i.confidence").alias("confidence"), action.alias("suggested_action"), F.col("i.observed_at").alias("observed_at"))


def upsells(summary: DataFrame, customers: DataFrame) -> DataFrame:
    """Next ladder courses after a finished one, minus what the customer already bought."""
    done = summary.where("completed_at is not null")
    nxt = done.select("customer_id", F.col("course_code").alias("completed_course_code"), "completed_at", "source", "synthetic",
                      F.explode(next_courses(F.col("course_code"))).alias("course_code"))
    open_ = nxt.join(summary.select("customer_id", "course_code"), ["customer_id", "course_code"], "left_anti")
    latest = open_.groupBy("customer_id", "course_code").agg(F.min_by(
        F.struct("completed_course_code", "completed_at", "source", "synthetic"),
        F.struct(-F.unix_date("completed_at"), F.col("completed_course_code"))).alias("r"))
    return latest.join(_names(customers), "customer_id").select(
        F.concat_ws(":", F.lit("upsell"), "customer_id", "course_code").alias("reco_id"), "customer_id", "customer_name",
        "r.completed_course_code", course_name(F.col("r.completed_course_code")).alias("completed_course_name"),
        "course_code", course_name(F.col("course_code")).alias("course_name"), "r.completed_at", "r.source", "r.synthetic")


def opportunities(t, reviews: DataFrame, now: str) -> tuple:
    """Both lists without recommendations a person has already decided."""
    summary = history_summary(course_history(t), now)
    seen = reviews.select("reco_id").distinct()
    follow = follow_ups(mark_superseded(t.intents, now), t.customers, summary).join(seen, "reco_id", "left_anti")
    up = upsells(summary, t.customers).join(seen, "reco_id", "left_anti")
    return follow.orderBy(F.desc("observed_at"), "reco_id"), up.orderBy(F.desc("completed_at"), "reco_id")


def review_log(decisions: DataFrame) -> DataFrame:
    """First valid decision per recommendation wins."""
    ok = F.col("reco_id").rlike(r"^(follow_up|upsell):[^:]+:[A-Z]+$") & F.col("status").isin("accepted", "dismissed")
    return decisions.where(ok).groupBy("reco_id").agg(F.min(F.struct("at", "actor", "status")).alias("d")).select("reco_id", "d.*")
