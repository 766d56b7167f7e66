"""Named queries that run the streams over the available files and return the maintained tables."""
from pyspark.sql import functions as F

from patronage.catalog import query
from patronage.catalog.customers import CUR, VERDICT_SQL
from patronage.catalog.linkage import KEY
from patronage.operators import scrub as S
from patronage.sources.bindings import StreamTables
from patronage.streaming import jobs as J


def streamed(t, table="events"):
    return StreamTables(t.spark, t.folder, table)


@query("stream_ingest", """SELECT CASE WHEN seq % 7 <> 0 THEN 'w' || seq ELSE 'chan_0:' || (1700000000000 + seq * 1000) || ':0' END AS event_id, 'message' AS event_type FROM webhook_raw
    UNION ALL SELECT 'chan_0:' || (1700000000000 + seq * 1000) || ':1', 'follow' FROM webhook_raw""")
def stream_ingest(t):
    w = J.workspace(t.spark, "ingest")
    J.drain(J.ingest(streamed(t).webhook_raw, f"{w}/out", f"{w}/cp"))
    return t.spark.read.parquet(f"{w}/out").select("event_id", "event_type")


@query("stream_fold_contacts", """SELECT line_user_id, strftime(min(occurred_at), '%Y-%m-%d %H:%M:%S') AS first_at, strftime(max(occurred_at), '%Y-%m-%d %H:%M:%S') AS last_at,
    strftime(min(occurred_at) FILTER (event_type = 'message'), '%Y-%m-%d %H:%M:%S') AS first_message FROM inbound WHERE event_type <> 'postback' AND line_user_id IS NOT NULL GROUP BY 1""")
def stream_fold(t):
    w = J.workspace(t.spark, "fold")
    empty = t.spark.createDataFrame([], "line_user_id string, first_interaction_at timestamp, last_interaction_at timestamp, first_message_at timestamp")
    snaps = J.ChangeRows(empty, f"{w}/rows", ["line_user_id"])
    J.drain(J.fold_contacts(streamed(t).inbound, snaps, f"{w}/cp"))
    day = lambda c, n: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(n)
    return snaps.latest().select("line_user_id", day("first_interaction_at", "first_at"), day("last_interaction_at", "last_at"), day("first_message_at", "first_message"))


@query("stream_current_intents", f"WITH {CUR} SELECT customer_id, course_code, intent_id FROM cur")
def stream_current(t):
    w = J.workspace(t.spark, "current")
    snaps = J.ChangeRows(t.intents.limit(0), f"{w}/rows", ["customer_id", "course_code"])
    J.drain(J.keep_current_intents(streamed(t).intents, snaps, f"{w}/cp"))
    return snaps.latest().select("customer_id", "course_code", "intent_id")


@query("stream_staff_lock", VERDICT_SQL)
def stream_lock(t):
    w = J.workspace(t.spark, "lock")
    J.drain(J.staff_lock(streamed(t).intents, f"{w}/out", f"{w}/cp"))
    loose = t.intents.where("customer_id is null and voided_at is null").select("intent_id", F.lit(None).cast("string").alias("rejection"))
    return t.spark.read.schema(J.VERDICT).parquet(f"{w}/out").select("intent_id", "rejection").unionByName(loose)


@query("stream_request_counts", """SELECT user_id, strftime(to_timestamp(CAST(floor(epoch(ts)) AS BIGINT) // 3600 * 3600), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n, greatest(0, count(*) - 2) AS refused FROM events GROUP BY 1, 2""")
def stream_quota(t):
    log = streamed(t).events.select("user_id", F.col("ts").cast("timestamp").alias("at"))
    out = J.run_to_table(J.request_counts(log, "user_id", "at", 2, "1 hour"), "quota", ["window_start", "user_id"])
    return out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query("stream_error_spikes", """WITH e AS (SELECT CAST(floor(epoch(ts)) AS BIGINT) // 3600 AS h FROM events WHERE event_type = 'error'), w AS (SELECT unnest([h, h - 1, h - 2]) AS s FROM e)
    SELECT strftime(to_timestamp(s * 3600), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n FROM w GROUP BY s HAVING count(*) >= 10""")
def stream_spikes(t):
    log = streamed(t).events.where("event_type = 'error'").select(F.col("ts").cast("timestamp").alias("at"))
    out = J.run_to_table(J.error_spikes(log, "at", 10, "3 hours", "1 hour"), "spikes", ["window_start"])
    return out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query("stream_mirror", "SELECT customer_id, strftime(updated_at, '%Y-%m-%d') AS source_day, left(phone, 0) || right(phone, 4) AS tail FROM customers")
def stream_mirror(t):
    w = J.workspace(t.spark, "mirror")
    scrub = lambda d: S.scrub_customers(d, KEY)
    snaps = J.ChangeRows(scrub(t.customers.limit(0)), f"{w}/rows", ["customer_id"])
    J.drain(J.mirror(streamed(t, "customer").customers, snaps, "customer_id", scrub, f"{w}/cp"))
    return snaps.latest().select("customer_id", F.date_format("source_updated_at", "yyyy-MM-dd").alias("source_day"), F.right("phone", F.lit(4)).alias("tail"))
