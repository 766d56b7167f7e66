"""Inbound chat events: landing, triage, folding into customers, retries, quotas and retention."""
from pyspark.sql import Column, DataFrame, Window, functions as F

from patronage.functions.text import SECRET_KEY, redact_text
from patronage.functions.vocabulary import FIXED_LIMITS as L
from patronage.operators.numbering import numbered

SUPPORTED = ["follow", "unfollow", "message"]
BODY_JSON = ("destination string, events array<struct<webhookEventId:string, type:string, timestamp:bigint, source:struct<type:string,userId:string>, "
             "message:struct<id:string,type:string>>>")


def land_webhooks(raw: DataFrame) -> DataFrame:
    """Webhook bodies to inbound rows. The schema keeps only id and type of a message, so its content
    is dropped before anything is stored. Events without an id get destination:timestamp:index."""
    b = raw.select("received_at", F.from_json("raw", BODY_JSON).alias("b")).select("received_at", "b.destination", F.posexplode("b.events").alias("i", "e"))
    made = F.concat_ws(":", "destination", F.col("e.timestamp").cast("string"), F.col("i").cast("string"))
    return b.select(
        F.coalesce("e.webhookEventId", made).alias("event_id"), F.lit("line").alias("provider"), F.col("destination").alias("channel_id"),
        F.col("e.type").alias("event_type"), F.when(F.col("e.source.type") == "user", F.col("e.source.userId")).alias("line_user_id"),
        F.when(F.col("e.type") == "message", F.col("e.message.type")).alias("message_type"), F.timestamp_millis("e.timestamp").alias("occurred_at"), "received_at")


def enqueue(new: DataFrame, stored: DataFrame) -> DataFrame:
    """First arrival per (event, provider) that is not stored yet."""
    key = ["event_id", "provider"]
    rest = [c for c in new.columns if c not in (*key, "received_at")]
    first = new.groupBy(*key).agg(F.min(F.struct("received_at", *rest)).alias("r")).select(*key, "r.*").select(*new.columns)
    return first.join(stored.select(*key), key, "left_anti")


def enqueue_report(new: DataFrame, accepted: DataFrame) -> DataFrame:
    a = accepted.agg(F.count("*").alias("n")).scalar()
    return new.agg(F.count("*").alias("total")).select(a.alias("accepted"), (F.col("total") - a).alias("duplicated"))


def triage(events: DataFrame, identities: DataFrame, customers: DataFrame) -> DataFrame:
    """Route of each event: fail, done or process, why, and whether the profile must be fetched."""
    key = ["provider", "channel_id", "line_user_id"]
    named = (identities.withColumnRenamed("external_id", "line_user_id").join(
        customers.where("line_display_name is not null").select("customer_id"), "customer_id", "left_semi")
        .select(*key).distinct().withColumn("_named", F.lit(True)))
    skip = (F.when(F.col("channel_id").isNull(), "noChannelId").when(F.col("line_user_id").isNull(), "notUserEvent")
            .when(~F.col("event_type").isin(SUPPORTED), "unsupportedType"))
    j = events.withColumn("skipped", skip).join(named, key, "left")
    route = F.when(F.col("skipped") == "noChannelId", "fail").when(F.col("skipped").isNotNull(), "done").otherwise("process")
    return j.withColumns({"route": route, "needs_profile": (route == "process") & F.col("_named").isNull()}).drop("_named")


def first_arrivals(events: DataFrame) -> DataFrame:
    """One row per (event, provider): the first to arrive, whatever the order of the input rows."""
    order = [c for c in ("received_at", "seq") if c in events.columns]
    rest = [c for c in events.columns if c not in ("event_id", "provider", *order)]
    g = events.groupBy("event_id", "provider").agg(F.min(F.struct(*order, *rest)).alias("_r"))
    return g.select("event_id", "provider", "_r.*").select(*events.columns)


def fold_customers(events: DataFrame) -> DataFrame:
    """Per chat user: first/last contact, first message, tags, milestones and the status the last
    follow or unfollow leaves, with its time. All aggregates commute, so late events land in the right place."""
    e = first_arrivals(events.where(F.col("event_type").isin(SUPPORTED) & F.col("line_user_id").isNotNull()))
    is_ = lambda k: F.col("event_type") == k
    at = F.col("occurred_at")
    g = e.groupBy("line_user_id").agg(
        F.min(at).alias("first_interaction_at"), F.max(at).alias("last_interaction_at"),
        F.min(F.when(is_("message"), at)).alias("first_message_at"),
        F.count_if(is_("follow") | is_("unfollow")).alias("_marks"), F.max(is_("follow")).alias("_followed"),
        F.max(F.when(~is_("message"), F.struct(at, "event_id", is_("unfollow").alias("left")))).alias("_last"),
        F.max(is_("unfollow")).alias("_ever_left"))
    msg = F.col("first_message_at").isNotNull()
    return g.select(
        "line_user_id", "first_interaction_at", "last_interaction_at", "first_message_at",
        F.filter(F.array(F.when(F.col("_followed"), "line-follower"), F.when(msg, "engaged")), lambda x: x.isNotNull()).alias("tags"),
        (F.col("_marks") + msg.cast("int")).alias("milestones"),
        F.when(F.col("_last.left"), "inactive").when(F.col("_last").isNotNull() & F.col("_ever_left"), "lead")
        .when(F.col("_last").isNotNull(), "followed").alias("status_change"),
        F.col("_last.occurred_at").alias("last_mark_at"), F.col("_last.event_id").alias("last_mark_id"))


def merge_fold(customers: DataFrame, fold: DataFrame, owner: DataFrame) -> DataFrame:
    """Customers after a fold; ``owner`` maps line_user_id to customer_id. The display name is never touched.

    Writes first and last contact, first message, tags, sources, milestones, status and dirty flags; columns that
    ``customers`` lacks start empty. Chat users without an owner become new customers whose id is a hash of theirs.
    With several chat ids the latest mark of all counts, and who ever left any of them comes back as a lead.
    """
    empty = {"tags": "array<string>", "sources": "array<string>", "first_message_at": "timestamp", "last_interaction_at": "timestamp", "milestones": "bigint"}
    for c, kind in empty.items():
        if c not in customers.columns:
            customers = customers.withColumn(c, F.lit(None).cast(kind))
    new_id = F.concat(F.lit("cus_"), F.left(F.sha2(F.concat(F.lit("line|"), F.col("line_user_id")), 256), F.lit(26)))
    f = fold.join(owner, "line_user_id", "left").withColumn("customer_id", F.coalesce("customer_id", new_id)).groupBy("customer_id").agg(
        F.min("first_interaction_at").alias("_f"), F.max("last_interaction_at").alias("_l"), F.min("first_message_at").alias("_m"),
        F.array_distinct(F.flatten(F.collect_set("tags"))).alias("_t"), F.sum("milestones").alias("_n"),
        F.max(F.when(F.col("status_change").isNotNull(), F.struct("last_mark_at", "last_mark_id", "status_change")))["status_change"].alias("_s"),
        F.max(F.col("status_change").isin("lead", "inactive")).alias("_left"))
    j = customers.withColumn("_old", F.lit(True)).join(f, "customer_id", "full")
    touched, fresh = F.col("_f").isNotNull(), F.col("_old").isNull()
    back = (F.col("_s") == "lead") | ((F.col("_s") == "followed") & (F.coalesce("_left", F.lit(False)) | (F.col("customer_status") == "inactive")))
    status = F.when(F.col("_s") == "inactive", "inactive").when(back | fresh, "lead").otherwise(F.col("customer_status"))
    none = F.array().cast("array<string>")
    text = lambda c, *more: F.sort_array(F.array_union(F.coalesce(c, none), *more))
    out = {"status": F.coalesce("status", F.lit("active")), "source_channel": F.when(fresh, "line").otherwise(F.col("source_channel")),
           "customer_status": status, "first_interaction_at": F.least("first_interaction_at", "_f"),
           "last_interaction_at": F.greatest("last_interaction_at", "_l"), "first_message_at": F.least("first_message_at", "_m"),
           "tags": text("tags", F.coalesce("_t", none)), "sources": F.when(touched, text("sources", F.array(F.lit("line")))).otherwise(F.coalesce("sources", none)),
           "milestones": F.coalesce("milestones", F.lit(0)) + F.coalesce("_n", F.lit(0)), "updated_at": F.greatest("updated_at", "_l")}
    out |= {c: F.coalesce(F.col(c) | touched, touched) for c in ("sheet_dirty", "ai_dirty") if c in customers.columns}
    return j.withColumns(out).select(*customers.columns)


def milestones(events: DataFrame, stored: DataFrame) -> DataFrame:
    """Follow, unfollow and first-message rows not logged before, one per source event."""
    e = first_arrivals(events.where(F.col("event_type").isin(SUPPORTED) & F.col("line_user_id").isNotNull()))
    marks = e.where("event_type <> 'message'").select("line_user_id", F.col("event_type").alias("type"), "occurred_at", F.col("event_id").alias("source_event_id"))
    first = e.where("event_type = 'message'").groupBy("line_user_id").agg(F.min(F.struct("occurred_at", "event_id")).alias("m")).select(
        "line_user_id", F.lit("first_message").alias("type"), "m.occurred_at", F.col("m.event_id").alias("source_event_id"))
    one = marks.unionByName(first).groupBy("source_event_id").agg(F.min(F.struct("occurred_at", "line_user_id", "type")).alias("_r"))
    one = one.select("_r.line_user_id", "_r.type", "_r.occurred_at", "source_event_id")
    return one.join(stored.select("source_event_id"), "source_event_id", "left_anti")


def retry_policy(failures: DataFrame) -> DataFrame:
    """Failure log (event_id, provider, failed_at, error) to attempts, state and the next try."""
    g = failures.groupBy("event_id", "provider").agg(F.count("*").alias("attempts"), F.max(F.struct("failed_at", "error")).alias("l"))
    wait = F.least(F.lit(L["backoff_base_s"]) * F.pow(F.lit(2), F.col("attempts") - 1), F.lit(L["backoff_cap_s"])).cast("int")
    dead = F.col("attempts") >= L["max_attempts"]
    return g.select("event_id", "provider", "attempts", F.when(dead, "dead").otherwise("pending").alias("status"), wait.alias("backoff_s"),
                    F.when(~dead, F.timestamp_seconds(F.unix_timestamp("l.failed_at") + wait)).alias("next_attempt_at"),
                    redact_text(F.col("l.error")).alias("last_error"))


def retain(df: DataFrame, at: str, now: str, days: int | None = None, years: int | None = None) -> DataFrame:
    keep = f"INTERVAL {days} DAYS" if days else f"INTERVAL {years} YEARS"
    return df.where(F.col(at) > F.expr(f"TIMESTAMP '{now}' - {keep}"))


def quota(log: DataFrame, key: str, at: str, limit: int, window_s: int) -> DataFrame:
    """Fixed-window quota over a request log: n-th call in the window, allowed, remaining, retry-after."""
    second = F.unix_timestamp(at)
    out = numbered(log.withColumn("window_start", (F.floor(second / window_s) * window_s).cast("long")), [key, "window_start"], [at, "event_id"], "n")
    left = F.greatest(F.lit(1), (F.col("window_start") + window_s) - second)
    return out.withColumns({"allowed": F.col("n") <= limit, "remaining": F.greatest(F.lit(0), F.lit(limit) - F.col("n")), "retry_after_s": left.cast("int")})


def queue_stats(events: DataFrame, provider: str | None = None) -> DataFrame:
    rows = events if provider is None else events.where(F.col("provider") == provider)
    return rows.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "processing", "done", "failed", "dead")])


def sync_stats(df: DataFrame, dirty: str, attempts: str = "sync_attempts", locked: Column | None = None) -> DataFrame:
    lock = F.lit(False) if locked is None else locked
    return df.agg(F.count_if(dirty).alias("dirty"), F.count_if(F.col(dirty) & lock).alias("locked"),
                  F.count_if(F.col(dirty) & (F.col(attempts) >= L["max_attempts"])).alias("stuck"))


def dead_letters(events: DataFrame, provider: str, limit: int = 50) -> DataFrame:
    return events.where((F.col("status") == "dead") & (F.col("provider") == provider)).orderBy(F.desc("received_at"), "event_id").limit(limit)


# --- Fixed values: extra patterns of workflow error payloads ---
WORKFLOW_PATTERNS = [(r"(?i)Bearer +[A-Za-z0-9._~+/=-]+", "Bearer [REDACTED]"), (r"(?<![A-Za-z0-9_])U[0-9a-f]{32}(?![A-Za-z0-9_])", "[LINE_USER_ID]")]


def redact_workflow(c: Column) -> Column:
    for pattern, mark in WORKFLOW_PATTERNS:
        c = F.regexp_replace(c, pattern, mark)
    return redact_text(c)


def workflow_errors(log: DataFrame) -> DataFrame:
    """Error payloads (map column ``payload``) as redacted audit rows."""
    clean = F.transform_values("payload", lambda k, v: F.when(k.rlike(SECRET_KEY), "[REDACTED]").otherwise(redact_workflow(v)))
    return log.select(F.lit("workflow.error").alias("action"), "at", clean.alias("payload"))

