"""The six business metrics as single declarative plans.

Money is summed on payments and never joined to items; seats are counted on items only.
"""
from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from patronage.functions import vocabulary as V
from patronage.functions.courses import course_name
from patronage.functions.dates import day_range, period_key, previous_range

METRICS = ("revenue", "seats", "people", "new_vs_returning", "channel_mix", "intent_funnel")
GROUPS = ("course", "month", "week", "day", "saleRep", "channel", "adOrOrganic")
PERIODS = ("month", "week", "day")
SOURCES = ("legacy", "partner")


@dataclass(frozen=True)
class AnalyticsQuery:
    metric: str
    start: str
    end: str
    group_by: str | None = None
    course_codes: tuple = ()
    sources: tuple = SOURCES
    include_synthetic: bool = False
    min_confidence: float = 0.6
    hesitation_reason: str | None = None
    compat: bool = False  # True keeps the one-day-early start of the original range rule

    def __post_init__(self):
        if self.metric not in METRICS:
            raise ValueError(f"unknown metric {self.metric!r}")
        if self.group_by is not None and self.group_by not in GROUPS:
            raise ValueError(f"unknown group {self.group_by!r}")
        if not set(self.sources) <= set(SOURCES):
            raise ValueError(f"unknown source in {self.sources!r}")
        if not 0 <= self.min_confidence <= 1:
            raise ValueError("min_confidence must lie in 0..1")
        if dt.date.fromisoformat(self.start) > dt.date.fromisoformat(self.end):
            raise ValueError("start is after end")

    @property
    def current(self):
        return day_range(self.start, self.end, self.compat)

    @property
    def previous(self):
        return previous_range(self.start, self.end, self.compat)


def _real(df: DataFrame, q: AnalyticsQuery) -> DataFrame:
    if q.include_synthetic or "synthetic" not in df.columns:
        return df
    return df.where(~F.coalesce(F.col("synthetic"), F.lit(False)))


def _flag(df: DataFrame) -> Column:
    return F.coalesce(F.col("synthetic"), F.lit(False)) if "synthetic" in df.columns else F.lit(False)


def payment_rows(t, q: AnalyticsQuery) -> DataFrame:
    """Live payments of the chosen sources: day, amount, sale_rep, synthetic, person, legacy_person."""
    parts = []
    if "legacy" in q.sources:
        p = _real(t.legacy_payments, q)
        parts.append(p.select(
            F.col("paid_at").alias("day"), "amount", "sale_rep", _flag(p).alias("synthetic"),
            F.lit(None).cast("string").alias("person"), F.col("person_id").alias("legacy_person")))
    if "partner" in q.sources:
        p = _real(t.purchases.where(~F.col("status").eqNullSafe("voided")), q)
        parts.append(p.select(
            F.col("paid_at").alias("day"), "amount", "sale_rep", _flag(p).alias("synthetic"),
            F.coalesce(F.concat(F.lit("cus:"), "customer_id"), F.concat(F.lit("pur:"), "purchase_id")).alias("person"),
            F.lit(None).cast("string").alias("legacy_person")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def seat_rows(t, q: AnalyticsQuery, with_person: bool) -> DataFrame:
    """Sold seats: day, course_code, synthetic and, when asked, the person columns."""
    keep = F.col("counts_as_seat")
    if q.course_codes:
        keep = keep & F.col("course_code").isin(*q.course_codes)
    parts = []
    if "legacy" in q.sources:
        e = _real(t.legacy_enrollments.where(keep), q)
        person = [F.lit(None).cast("string").alias("person"), F.col("person_id").alias("legacy_person")]
        parts.append(e.select(F.col("session_start").alias("day"), "course_code", _flag(e).alias("synthetic"),
                              *(person if with_person else [])))
    if "partner" in q.sources:
        e = _real((t.owned_items if with_person else t.purchase_items).where(keep), q)
        person = []
        if with_person:
            person = [F.coalesce(F.concat(F.lit("cus:"), "customer_id"), F.concat(F.lit("pit:"), "item_id")).alias("person"),
                      F.lit(None).cast("string").alias("legacy_person")]
        parts.append(e.select(F.col("session_start").alias("day"), "course_code", _flag(e).alias("synthetic"), *person))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def person_links(t) -> DataFrame:
    """One customer per legacy person: confirmed before auto, then score, then customer id."""
    usable = t.customer_links.where(F.col("status").isin("auto", "confirmed"))
    order = F.struct((F.col("status") != "confirmed").alias("a"), (-F.col("score")).alias("b"), F.col("customer_id").alias("c"))
    return usable.groupBy(F.col("legacy_person_id").alias("legacy_person")).agg(
        F.concat(F.lit("cus:"), F.min_by("customer_id", order)).alias("linked"))


def unify(rows: DataFrame, t) -> DataFrame:
    """Add ``person_key``. Callers reduce rows per person first, so no hot person reaches this join."""
    joined = rows.join(person_links(t), "legacy_person", "left")
    return joined.withColumn("person_key", F.coalesce(
        "person", "linked", F.concat(F.lit("lgp:"), "legacy_person"))).drop("person", "legacy_person", "linked")


def group_key(q: AnalyticsQuery, has_course: bool, has_rep: bool) -> Column:
    if q.group_by == "course" and has_course:
        return F.coalesce(F.col("course_code"), F.lit("UNKNOWN"))
    if q.group_by == "course":
        return F.lit(V.LABEL_TOTAL if not has_rep else "UNKNOWN")
    if q.group_by == "saleRep":
        return F.coalesce(F.col("sale_rep"), F.lit(V.LABEL_NO_REP)) if has_rep else F.lit(V.LABEL_NO_REP)
    if q.group_by in PERIODS:
        return F.coalesce(period_key(F.col("day"), q.group_by), F.lit(V.LABEL_NO_DATE))
    return F.lit(V.LABEL_TOTAL)


def _between(bounds) -> Column:
    return F.col("day").between(F.lit(bounds[0]), F.lit(bounds[1]))


def _derive(rows: DataFrame, q: AnalyticsQuery, previous: bool = False) -> DataFrame:
    """Label, share of total (4 places) and change, ordered by value."""
    # Only finished groups (periods, courses, reps) meet here, so the total costs no second scan.
    total = F.sum("value").over(Window.partitionBy(F.lit(0)))
    share = F.when(total > 0, F.floor(F.col("value").cast("double") / total.cast("double") * 10000 + 0.5) / 10000)
    label = course_name(F.col("key")) if q.group_by == "course" else F.col("key")
    named = F.when(F.col("key") == "new", V.LABEL_NEW).when(F.col("key") == "returning", V.LABEL_RETURNING)
    out = rows.select(
        "key", (named if q.metric == "new_vs_returning" else label).alias("label"), "value",
        F.coalesce(share, F.lit(0.0)).alias("share"),
        *([(F.col("value") - F.col("before")).alias("delta")] if previous else []))
    return out.orderBy(F.desc("value"), "key")


def _measured(rows: DataFrame, q: AnalyticsQuery, key: Column, amount: Column) -> DataFrame:
    """Current and previous period in one scan and one aggregation."""
    with_delta = q.group_by is not None
    now = _between(q.current)
    scope = now
    if with_delta:
        scope = F.col("day").between(F.lit(min(q.previous[0], q.current[0])), F.lit(q.current[1]))
    zero = F.lit(0).cast("decimal(18,2)") if q.metric == "revenue" else F.lit(0).cast("long")
    agg = [F.sum(F.when(now, amount).otherwise(zero)).alias("value"), F.count_if(now).alias("n")]
    if with_delta:
        agg.append(F.sum(F.when(_between(q.previous), amount).otherwise(zero)).alias("before"))
    scoped = rows.where(scope).withColumn("key", key)
    return _derive(scoped.groupBy("key").agg(*agg).where("n > 0"), q, with_delta)


def revenue(t, q: AnalyticsQuery) -> DataFrame:
    # One payment may cover several courses, so a split by course collapses to the total.
    key = F.lit(V.LABEL_TOTAL) if q.group_by == "course" else group_key(q, False, True)
    amount = F.coalesce(F.col("amount"), F.lit(0).cast("decimal(18,2)"))
    return _measured(payment_rows(t, q).select("day", "amount", "sale_rep"), q, key, amount)


def seats(t, q: AnalyticsQuery) -> DataFrame:
    return _measured(seat_rows(t, q, False).select("day", "course_code"), q, group_key(q, True, False), F.lit(1).cast("long"))


def people(t, q: AnalyticsQuery) -> DataFrame:
    """Distinct people; without a group both seats and payments count, grouped only seats do."""
    s = seat_rows(t, q, True).where(_between(q.current))
    if q.group_by is None:
        p = payment_rows(t, q).where(_between(q.current))
        both = s.select("person", "legacy_person").unionByName(p.select("person", "legacy_person")).distinct()
        counted = unify(both, t).agg(F.count_distinct("person_key").alias("value"))
        return _derive(counted.select(F.lit(V.LABEL_TOTAL).alias("key"), "value"), q)
    keyed = s.select(group_key(q, True, False).alias("key"), "person", "legacy_person").distinct()
    return _derive(unify(keyed, t).groupBy("key").agg(F.count_distinct("person_key").alias("value")), q)


def new_vs_returning(t, q: AnalyticsQuery) -> DataFrame:
    lo, hi = q.current
    first = F.min("day").alias("first_day")
    seen = F.max(F.col("day") >= F.lit(lo)).alias("in_range")
    rows = payment_rows(t, q).where(F.col("day") <= F.lit(hi))
    per_person = unify(rows.groupBy("person", "legacy_person").agg(first, seen), t)
    merged = per_person.groupBy("person_key").agg(F.min("first_day").alias("first_day"), F.max("in_range").alias("in_range"))
    back = F.col("first_day") < F.lit(dt.date.fromisoformat(q.start))
    counts = merged.where("in_range").agg(F.count_if(~back).alias("new"), F.count_if(back).alias("returning"))
    return _derive(counts.unpivot([], ["new", "returning"], "key", "value"), q)


def channel_mix(t, q: AnalyticsQuery) -> DataFrame:
    if q.group_by == "adOrOrganic":
        key = (F.when(F.col("lead_ad_or_organic").isNull() & F.col("lead_pending").isNull(), V.LABEL_NOT_AD)
               .when(F.col("lead_pending"), V.LABEL_AD_PENDING)
               .otherwise(F.coalesce(F.col("lead_ad_or_organic"), F.lit("unknown"))))
    else:
        key = F.coalesce(F.col("heard_from"), F.lit(V.LABEL_NO_CHANNEL))
    rows = t.customers.where("status = 'active'").groupBy(key.alias("key")).agg(F.count("*").alias("value"))
    return _derive(rows, q)


def live_intents(t, q: AnalyticsQuery) -> DataFrame:
    df = t.intents
    if "superseded_at" in df.columns:
        df = df.where("superseded_at is null")
    df = df.where(F.col("voided_at").isNull() & ~F.coalesce(F.col("below_threshold"), F.lit(False))
                  & (F.col("confidence") >= q.min_confidence))
    if q.course_codes:
        df = df.where(F.col("course_code").isin(*q.course_codes))
    if q.hesitation_reason:
        df = df.where(F.col("hesitation_reason") == q.hesitation_reason)
    return df


def intent_funnel(t, q: AnalyticsQuery) -> DataFrame:
    key = F.concat(F.col("status"), F.coalesce(F.concat(F.lit("/"), F.col("hesitation_reason")), F.lit("")))
    return _derive(live_intents(t, q).groupBy(key.alias("key")).agg(F.count("*").alias("value")), q)


PLANS = {"revenue": revenue, "seats": seats, "people": people, "new_vs_returning": new_vs_returning,
         "channel_mix": channel_mix, "intent_funnel": intent_funnel}


def run_analytics(t, q: AnalyticsQuery) -> DataFrame:
    """Rows of one metric: key, label, value, share and, where it applies, delta."""
    return PLANS[q.metric](t, q)


def analytics_meta(t, q: AnalyticsQuery) -> DataFrame:
    """One row: rows scanned, synthetic flag, estimate flag, warnings."""
    none = F.lit(None).cast("string")
    if q.metric in ("channel_mix", "intent_funnel"):
        rows = (t.customers.where("status = 'active'") if q.metric == "channel_mix" else live_intents(t, q))
        pending = F.coalesce(F.max("lead_pending"), F.lit(False)) if q.metric == "channel_mix" else F.lit(False)
        models = F.array_sort(F.collect_set("model")) if q.metric == "intent_funnel" else F.array().cast("array<string>")
        stats = rows.agg(F.count("*").alias("rows_scanned"), F.lit(False).alias("contains_synthetic"),
                         F.lit(False).alias("null_amount"), pending.alias("pending"), models.alias("models"))
    else:
        parts = []
        if q.metric in ("revenue", "people", "new_vs_returning"):
            hi = F.col("day") <= F.lit(q.current[1])
            keep = hi if q.metric == "new_vs_returning" else _between(q.current)
            parts.append(payment_rows(t, q).where(keep).select("synthetic", F.col("amount").isNull().alias("no_amount")))
        if q.metric in ("seats", "people"):
            parts.append(seat_rows(t, q, False).where(_between(q.current)).select("synthetic", F.lit(False).alias("no_amount")))
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        stats = rows.agg(F.count("*").alias("rows_scanned"), F.coalesce(F.max("synthetic"), F.lit(False)).alias("contains_synthetic"),
                         F.coalesce(F.max("no_amount"), F.lit(False)).alias("null_amount"),
                         F.lit(False).alias("pending"), F.array().cast("array<string>").alias("models"))
    estimate = F.lit(q.metric == "intent_funnel")
    supported = {"revenue": ("month", "week", "day", "saleRep", "course"), "seats": ("course", "month", "week", "day"),
                 "people": ("course", "month", "week", "day"), "channel_mix": ("channel", "adOrOrganic")}
    ignored = q.group_by is not None and q.group_by not in supported.get(q.metric, ())
    warnings = F.filter(F.array(
        F.when(F.lit(q.metric == "revenue" and q.group_by == "course"), "revenue_has_no_course_split").otherwise(none),
        F.when(F.lit(q.metric == "revenue") & F.col("null_amount"), "null_amounts_not_counted").otherwise(none),
        F.when(F.col("pending"), "attribution_pending").otherwise(none),
        F.when(estimate, F.concat(F.lit(f"estimate_confidence_ge_{q.min_confidence}:"), F.concat_ws(",", "models"))).otherwise(none),
        F.when(F.col("contains_synthetic"), "contains_synthetic").otherwise(none),
        F.when(F.lit(not q.include_synthetic), "synthetic_excluded").otherwise(none),
        F.when(F.lit(ignored), "group_ignored").otherwise(none),
    ), lambda w: w.isNotNull())
    return stats.select(
        F.lit(q.metric).alias("metric"), F.lit(q.start).alias("from"), F.lit(q.end).alias("to"),
        F.lit("Asia/Bangkok").alias("timezone"), F.array(*[F.lit(s) for s in q.sources]).alias("sources_used"),
        "rows_scanned", "contains_synthetic", estimate.alias("is_estimate"), warnings.alias("warnings"))


def with_metric(q: AnalyticsQuery, **changes) -> AnalyticsQuery:
    return replace(q, **changes)
