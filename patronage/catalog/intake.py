"""Named queries for chat events, leads and posts."""
from pyspark.sql import functions as F

from patronage.catalog import query
from patronage.functions import vocabulary as V
from patronage.functions.courses import COURSES
from patronage.operators import events as E, leads as D, posts as O

NAME = "CASE key WHEN 'UNMAPPED' THEN '%s' " % V.UNMAPPED_POST_LABEL + " ".join(f"WHEN '{k}' THEN '{n}'" for k, n, _, _ in COURSES) + " ELSE key END"
TS = "yyyy-MM-dd HH:mm:ss"


def ts(c):
    return F.date_format(c, TS).alias(c)


@query("land_webhooks", """SELECT CASE WHEN seq % 7 <> 0 THEN 'w' || seq ELSE 'chan_0:' || (1700000000000 + seq * 1000) || ':0' END AS event_id, 'message' AS event_type,
    CASE WHEN seq % 9 <> 0 THEN 'U' || user_id END AS line_user_id, 'text' AS message_type FROM webhook_raw JOIN events ON event_id = seq
    UNION ALL SELECT 'chan_0:' || (1700000000000 + seq * 1000) || ':1', 'follow', 'U' || user_id, NULL FROM webhook_raw JOIN events ON event_id = seq""")
def land_webhooks(t):
    return E.land_webhooks(t.webhook_raw).select("event_id", "event_type", "line_user_id", "message_type")


ENQ = """a AS (SELECT event_id, provider, arg_min(seq, (received_at, seq)) AS seq FROM inbound WHERE seq % 2 = 1 GROUP BY 1, 2),
  st AS (SELECT event_id, provider FROM inbound WHERE seq % 2 = 0), acc AS (SELECT a.* FROM a ANTI JOIN st ON st.event_id = a.event_id AND st.provider = a.provider)"""


def _queue(t):
    new = t.inbound.where("seq % 2 = 1").select("event_id", "provider", "received_at", "seq")
    return new, E.enqueue(new, t.inbound.where("seq % 2 = 0"))


@query("enqueue_events", f"WITH {ENQ} SELECT event_id, provider, seq FROM acc")
def enqueue(t):
    return _queue(t)[1].select("event_id", "provider", "seq")


@query("enqueue_report", f"WITH {ENQ} SELECT (SELECT count(*) FROM acc) AS accepted, (SELECT count(*) FROM inbound WHERE seq % 2 = 1) - (SELECT count(*) FROM acc) AS duplicated")
def enqueue_report(t):
    return E.enqueue_report(*_queue(t))


@query("triage_events", """WITH nm AS (SELECT DISTINCT provider, channel_id, external_id FROM identities i JOIN customers c ON c.customer_id = i.customer_id WHERE line_display_name IS NOT NULL),
    s AS (SELECT *, CASE WHEN channel_id IS NULL THEN 'noChannelId' WHEN line_user_id IS NULL THEN 'notUserEvent' WHEN event_type = 'postback' THEN 'unsupportedType' END AS skipped FROM inbound)
    SELECT seq, skipped, CASE WHEN skipped = 'noChannelId' THEN 'fail' WHEN skipped IS NOT NULL THEN 'done' ELSE 'process' END AS route, skipped IS NULL AND nm.external_id IS NULL AS needs_profile
    FROM s LEFT JOIN nm ON nm.provider = s.provider AND nm.channel_id = s.channel_id AND nm.external_id = s.line_user_id""")
def triage(t):
    return E.triage(t.inbound, t.identities, t.customers).select("seq", "skipped", "route", "needs_profile")


FOLD = """d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id, provider ORDER BY received_at, seq) AS rn FROM inbound WHERE event_type <> 'postback' AND line_user_id IS NOT NULL) WHERE rn = 1),
  fo AS (SELECT line_user_id, min(occurred_at) AS f, max(occurred_at) AS l, min(occurred_at) FILTER (event_type = 'message') AS m, count(*) FILTER (event_type <> 'message') AS marks,
    bool_or(event_type = 'follow') AS fol, bool_or(event_type = 'unfollow') AS ever, arg_max(event_type, (occurred_at, event_id)) FILTER (event_type <> 'message') AS last,
    max(occurred_at) FILTER (event_type <> 'message') AS last_at, arg_max(event_id, (occurred_at, event_id)) FILTER (event_type <> 'message') AS last_id FROM d GROUP BY 1)"""


@query("fold_chat_events", f"""WITH {FOLD} SELECT line_user_id, strftime(f, '%Y-%m-%d %H:%M:%S') AS first_interaction_at, strftime(l, '%Y-%m-%d %H:%M:%S') AS last_interaction_at,
    strftime(m, '%Y-%m-%d %H:%M:%S') AS first_message_at, array_to_string(list_filter([CASE WHEN fol THEN 'line-follower' END, CASE WHEN m IS NOT NULL THEN 'engaged' END], lambda x: x IS NOT NULL), ',') AS tags,
    marks + (m IS NOT NULL)::INT AS milestones, CASE WHEN last = 'unfollow' THEN 'inactive' WHEN last IS NOT NULL AND ever THEN 'lead' WHEN last IS NOT NULL THEN 'followed' END AS status_change FROM fo""")
def fold_chat(t):
    return E.fold_customers(t.inbound).select("line_user_id", ts("first_interaction_at"), ts("last_interaction_at"), ts("first_message_at"),
                                              F.concat_ws(",", "tags").alias("tags"), "milestones", "status_change")


@query("merge_chat_fold", f"""WITH {FOLD}, ow AS (SELECT 'U' || c_custkey AS uid, customer_id AS oid FROM customers WHERE c_custkey % 6 <> 4 AND c_custkey % 10 <> 3
      UNION ALL SELECT 'U' || c_custkey, 'cus_' || (c_custkey - 1) FROM customers WHERE c_custkey % 10 = 3),
    fc AS (SELECT coalesce(oid, 'cus_' || left(sha256('line|' || line_user_id), 26)) AS fid, min(f) AS f, max(l) AS l, min(m) AS m, max(fol) AS fol, sum(marks + (m IS NOT NULL)::INT) AS n,
      bool_or(last IS NOT NULL AND ever) AS ever, arg_max(last, (last_at, last_id)) FILTER (last IS NOT NULL) AS last FROM fo LEFT JOIN ow ON uid = line_user_id GROUP BY 1),
    j AS (SELECT coalesce(customer_id, fid) AS customer_id, customer_id IS NULL AS fresh, fid IS NOT NULL AS hit, status AS st, customer_status AS cs, first_interaction_at AS f0, sheet_dirty AS sd, fc.* FROM customers FULL JOIN fc ON fid = customer_id)
    SELECT customer_id, coalesce(st, 'active') AS status, CASE WHEN last = 'unfollow' THEN 'inactive' WHEN fresh OR (last IS NOT NULL AND (ever OR cs = 'inactive')) THEN 'lead' ELSE cs END AS customer_status,
      strftime(least(coalesce(f0, f), coalesce(f, f0)), '%Y-%m-%d %H:%M:%S') AS first_interaction_at, strftime(l, '%Y-%m-%d %H:%M:%S') AS last_interaction_at, strftime(m, '%Y-%m-%d %H:%M:%S') AS first_message_at,
      array_to_string([x FOR x IN [CASE WHEN m IS NOT NULL THEN 'engaged' END, CASE WHEN fol THEN 'line-follower' END] IF x IS NOT NULL], ',') AS tags,
      CASE WHEN hit THEN 'line' ELSE '' END AS sources, CAST(coalesce(n, 0) AS BIGINT) AS milestones, coalesce(sd, FALSE) OR hit AS sheet_dirty FROM j""")
def merge_fold(t):
    k = F.col("c_custkey")
    user = F.concat(F.lit("U"), k.cast("string")).alias("line_user_id")
    owner = t.customers.where("c_custkey % 6 <> 4 and c_custkey % 10 <> 3").select(user, "customer_id").unionByName(
        t.customers.where("c_custkey % 10 = 3").select(user, F.concat(F.lit("cus_"), (k - 1).cast("string")).alias("customer_id")))
    merged = E.merge_fold(t.customers, E.fold_customers(t.inbound), owner)
    return merged.select("customer_id", "status", "customer_status", ts("first_interaction_at"), ts("last_interaction_at"), ts("first_message_at"),
                         F.concat_ws(",", "tags").alias("tags"), F.concat_ws(",", "sources").alias("sources"), "milestones", "sheet_dirty")


@query("milestone_log", f"""WITH {FOLD}, m AS (SELECT event_id AS source_event_id, event_type AS type, occurred_at, line_user_id FROM d WHERE event_type <> 'message'
    UNION ALL SELECT arg_min(event_id, (occurred_at, event_id)), 'first_message', min(occurred_at), line_user_id FROM d WHERE event_type = 'message' GROUP BY line_user_id)
    SELECT source_event_id, arg_min(type, (occurred_at, line_user_id, type)) AS type FROM m
    WHERE source_event_id NOT IN (SELECT event_id FROM inbound WHERE seq % 3 = 0) GROUP BY 1""")
def milestone_log(t):
    stored = t.inbound.where("seq % 3 = 0").select(F.col("event_id").alias("source_event_id"))
    return E.milestones(t.inbound, stored).select("source_event_id", "type")


@query("retry_policy", """WITH f AS (SELECT 'evt_' || (event_id % 400) AS event_id, max(ts) AS last_at, count(*) AS attempts FROM events WHERE event_type = 'error' GROUP BY 1)
    SELECT event_id, attempts, CASE WHEN attempts >= 5 THEN 'dead' ELSE 'pending' END AS status, CAST(least(30 * pow(2, attempts - 1), 1800) AS INT) AS backoff_s,
    CASE WHEN attempts < 5 THEN strftime(date_trunc('second', last_at) + to_seconds(CAST(least(30 * pow(2, attempts - 1), 1800) AS INT)), '%Y-%m-%d %H:%M:%S') END AS next_attempt_at FROM f""")
def retry(t):
    log = t.events.where("event_type = 'error'").select(
        F.concat(F.lit("evt_"), (F.col("event_id") % 400).cast("string")).alias("event_id"), F.lit("line").alias("provider"),
        F.col("ts").cast("timestamp").alias("failed_at"), F.lit("call 0812345678").alias("error"))
    return E.retry_policy(log).select("event_id", "attempts", "status", "backoff_s", ts("next_attempt_at"))


@query("retention_inbound", "SELECT seq FROM inbound WHERE received_at > TIMESTAMP '2024-02-15 00:00:00' - INTERVAL 30 DAY")
def retention(t):
    return E.retain(t.inbound, "received_at", "2024-02-15 00:00:00", days=30).select("seq")


@query("request_quota", """WITH w AS (SELECT *, epoch(ts)::BIGINT // 3600 * 3600 AS ws FROM (SELECT event_id, user_id, date_trunc('second', ts) AS ts FROM events)),
    n AS (SELECT *, row_number() OVER (PARTITION BY user_id, ws ORDER BY ts, event_id) AS n FROM w)
    SELECT event_id, n, n <= 2 AS allowed, greatest(0, 2 - n) AS remaining, CAST(greatest(1, ws + 3600 - epoch(ts)::BIGINT) AS INT) AS retry_after_s FROM n""")
def request_quota(t):
    log = t.events.select("event_id", "user_id", F.date_trunc("second", F.col("ts").cast("timestamp")).alias("at"))
    return E.quota(log, "user_id", "at", 2, 3600).select("event_id", "n", "allowed", "remaining", "retry_after_s")


@query("queue_stats", """SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'processing') AS processing, count(*) FILTER (status = 'done') AS done,
    count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'dead') AS dead FROM inbound WHERE provider = 'line'""")
def queue_stats(t):
    return E.queue_stats(t.inbound, "line")


@query("sync_stats", "SELECT count(*) FILTER (ai_dirty) AS dirty, 0 AS locked, count(*) FILTER (ai_dirty AND sync_attempts >= 5) AS stuck FROM customers")
def sync_stats(t):
    return E.sync_stats(t.customers, "ai_dirty")


@query("dead_letters", "SELECT seq FROM inbound WHERE status = 'dead' AND provider = 'line' ORDER BY received_at DESC, event_id LIMIT 50")
def dead_letters(t):
    return E.dead_letters(t.inbound, "line").select("seq")


@query("workflow_errors", """SELECT event_id, 'workflow.error' AS action, 'Bearer [REDACTED] for [LINE_USER_ID] ' || event_id AS message, '[REDACTED]' AS apiToken FROM events WHERE event_type = 'error'""")
def workflow_errors(t):
    msg = F.concat(F.lit("Bearer abc.def for U0123456789abcdef0123456789abcdef "), F.col("event_id").cast("string"))
    log = t.events.where("event_type = 'error'").select(F.col("ts").alias("at"), F.create_map(
        F.lit("message"), msg, F.lit("apiToken"), F.lit("zzz"), F.lit("id"), F.col("event_id").cast("string")).alias("payload"))
    p = F.col("payload")
    return E.workflow_errors(log).select(p["id"].cast("long").alias("event_id"), "action", p["message"].alias("message"), p["apiToken"].alias("apiToken"))


# ---- leads ----------------------------------------------------------------------------------

def details(t):
    pair = lambda n, c: F.struct(F.lit(n).alias("name"), F.array(F.col(c)).alias("values"))
    data = F.filter(F.array(pair("Full Name", "full_name"), pair("first_name", "first_name"), pair("Phone", "phone_text"), pair("email", "email_text"),
                            pair("Agree", "agree"), pair("Favourite colour", "first_name")), lambda f: f["values"][0].isNotNull())
    return t.lead_feed.where("k % 7 <> 0").select("k", "leadgen_id", data.alias("field_data"))


@query("lead_notifications", "SELECT leadgen_id, coalesce(page_id, entry_id) AS page_id, form_id, ad_id, 1700000000 + k AS created FROM lead_feed WHERE kind = 'leadgen'")
def lead_notifications(t):
    return D.notifications(t.lead_raw).select("leadgen_id", "page_id", "form_id", "ad_id", F.unix_timestamp("created_time").alias("created"))


@query("lead_page_scope", "SELECT count(*) AS rejected FROM lead_feed WHERE kind = 'leadgen' AND coalesce(page_id, entry_id) <> 'page_1'")
def lead_page_scope(t):
    return D.page_scope(D.notifications(t.lead_raw), "page_1")[1]


PHONE = "CASE WHEN substr(phone_text, 2, 1) BETWEEN '2' AND '9' THEN '+66' || substr(phone_text, 2) END"


@query("map_leads", f"""SELECT leadgen_id, coalesce(replace(full_name, '  ', ' '), first_name) AS display_name, {PHONE} AS phone, lower(email_text) AS email,
    agree = 'Yes' AS consent_data, coalesce(agree, '') <> 'Yes' AS needs_consent, 'Favourite colour' AS ignored FROM lead_feed WHERE k % 7 <> 0""")
def map_leads(t):
    return D.map_leads(details(t), "Agree").select("leadgen_id", "display_name", "phone", "email", "consent_data", "needs_consent",
                                                   F.concat_ws(",", "ignored_fields").alias("ignored"))


MAPPED = """mm AS (SELECT match_on, match_value, min(struct_pack(a := campaign_name, b := course_code, c := ad_or_organic)) AS m FROM lead_mappings GROUP BY 1, 2),
  nt AS (SELECT k, leadgen_id, coalesce(page_id, entry_id) AS page_id, form_id, ad_id FROM lead_feed WHERE kind = 'leadgen'),
  pk AS (SELECT nt.*, coalesce(a.m, f.m, p.m) AS m FROM nt LEFT JOIN mm a ON a.match_on = 'adId' AND a.match_value = ad_id
    LEFT JOIN mm f ON f.match_on = 'formId' AND f.match_value = form_id LEFT JOIN mm p ON p.match_on = 'pageId' AND p.match_value = page_id)"""


@query("lead_attribution", f"WITH {MAPPED} SELECT leadgen_id, m.b AS course_code, m.a AS campaign_name, coalesce(m.c, 'unknown') AS ad_or_organic, m IS NULL AS attribution_pending FROM pk")
def lead_attribution(t):
    return D.pick_mapping(D.notifications(t.lead_raw), t.lead_mappings).select("leadgen_id", "course_code", "campaign_name", "ad_or_organic", "attribution_pending")


LEADS = f"""{MAPPED}, ld AS (SELECT k, {PHONE} AS phone, lower(email_text) AS email, agree FROM lead_feed WHERE k % 7 <> 0),
  hit AS (SELECT ld.k, min(customer_id) AS cand FROM ld JOIN customers c ON status = 'active' AND (c.phone = ld.phone OR c.email = ld.email) GROUP BY 1),
  fl AS (SELECT pk.leadgen_id, CASE WHEN ld.k IS NULL THEN 'failed' ELSE 'created' END AS result, cand AS pending_merge, coalesce(agree, '') <> 'Yes' AS needs_consent, m IS NULL AS pend
    FROM pk LEFT JOIN ld ON ld.k = pk.k LEFT JOIN hit ON hit.k = pk.k)"""


def _folded(t):
    none = t.customers.limit(0).select(F.col("customer_id").alias("a"), F.col("customer_id").alias("b"))
    return D.fold_leads(D.notifications(t.lead_raw), details(t).drop("k"), t.lead_mappings, t.customers, none, "Agree")


@query("fold_leads", f"WITH {LEADS} SELECT leadgen_id, result, pending_merge FROM fl")
def fold_leads(t):
    return _folded(t).select("leadgen_id", "result", "pending_merge")


@query("lead_report", f"""WITH {LEADS} SELECT count(*) FILTER (result = 'created') AS created, 0 AS updated, count(*) FILTER (result = 'failed') AS failed,
    count(*) FILTER (result <> 'failed' AND pending_merge IS NOT NULL) AS pending_merge, count(*) FILTER (result <> 'failed' AND needs_consent) AS needs_consent,
    count(*) FILTER (result <> 'failed' AND pend) AS attribution_pending FROM fl""")
def lead_report(t):
    return D.lead_report(_folded(t))


@query("mapping_refused", "SELECT count(*) AS refused FROM lead_mappings WHERE course_code = 'NOPE'")
def mapping_refused(t):
    from patronage.sources.store import mapping_upsert
    return mapping_upsert(t.lead_mappings.where("match_on = 'adId'"), t.lead_mappings)[1].agg(F.count("*").alias("refused"))


# ---- posts ----------------------------------------------------------------------------------

def tagged(t):
    """Posts of the test tables with their hashtags read and one ad id each."""
    return O.read_hashtags(t.posts).withColumn("ad_ids", F.array("ad_id"))


def landed(t):
    prev = t.posts.select("post_id", "reach", F.array("ad_id").alias("ad_ids"))
    return O.land_posts(t.post_raw.select("post_json", "insight_json"), prev)


@query("land_posts", """SELECT 'post_' || r.page_id AS post_id, CASE r.page_id % 6 WHEN 0 THEN 'INNER' WHEN 1 THEN 'COMMU' WHEN 4 THEN 'DEEPIN' WHEN 5 THEN 'INNERCAMP' END AS course_code,
    r.page_id % 6 IN (2, 3, 4) AS unmapped, greatest(0, p.reactions - 50) AS reactions, r.page_id % 23 AS shares, CASE WHEN r.page_id % 4 = 0 THEN r.page_id ELSE p.reach END AS reach
    FROM post_raw r JOIN posts p ON p.page_id = r.page_id WHERE r.page_id % 17 <> 0 AND r.page_id % 19 <> 0""")
def land_posts(t):
    return landed(t).where("valid").select("post_id", "course_code", "unmapped", "reactions", "shares", "reach")


@query("post_landing_report", """SELECT count(*) AS fetched, count(*) FILTER (page_id % 17 <> 0 AND page_id % 19 <> 0) AS stored, count(*) FILTER (page_id % 17 = 0 OR page_id % 19 = 0) AS invalid,
    count(*) FILTER (page_id % 17 <> 0 AND page_id % 19 <> 0 AND page_id % 4 <> 0) AS missing_insights FROM post_raw""")
def landing_report(t):
    return O.landing_report(landed(t))


TAG = """tg AS (SELECT *, CASE page_id % 6 WHEN 0 THEN 'INNER' WHEN 1 THEN 'COMMU' WHEN 4 THEN 'DEEPIN' WHEN 5 THEN 'INNERCAMP' END AS course_code, page_id % 6 IN (2, 3, 4, 5) AS unmapped, page_id % 6 = 2 AS ambiguous FROM posts),
  rg AS (SELECT * FROM tg WHERE created_time BETWEEN TIMESTAMP '2024-01-31 17:00:00' AND TIMESTAMP '2024-06-30 16:59:59.999')"""


@query("post_hashtags", f"WITH {TAG} SELECT post_id, course_code, unmapped, ambiguous FROM tg")
def post_hashtags(t):
    return tagged(t).select("post_id", "course_code", "unmapped", "ambiguous")


AV = lambda c: f"floor(CAST({c} AS DOUBLE) / post_count * 100 + 0.5) / 100 AS {c}_avg"


@query("post_analytics", f"""WITH {TAG}, g AS (SELECT coalesce(course_code, 'UNMAPPED') AS key, count(*) AS post_count, sum(reactions) AS reactions, sum(comments) AS comments, sum(shares) AS shares,
    sum(reactions + comments + shares) AS engagement, sum(reach) AS reach FROM rg GROUP BY 1)
    SELECT *, {NAME} AS label, {', '.join(AV(c) for c in ('reactions', 'comments', 'shares', 'engagement', 'reach'))} FROM g""")
def post_analytics(t):
    return O.post_analytics(tagged(t), "2024-02-01", "2024-06-30")


@query("post_summary", f"""WITH {TAG}, e AS (SELECT max(s) AS m FROM (SELECT sum(reactions + comments + shares) AS s FROM rg GROUP BY coalesce(course_code, '')))
    SELECT count(*) AS total_posts, count(*) FILTER (NOT unmapped AND course_code IS NOT NULL) AS mapped_posts, count(*) FILTER (unmapped) AS unmapped_posts,
    sum(reactions + comments + shares) AS total_engagement, sum(reach) AS total_reach, greatest(1, (SELECT m FROM e)) AS chart_max_engagement, bool_or(synthetic) AS contains_synthetic FROM rg""")
def post_summary(t):
    return O.post_summary(tagged(t), "2024-02-01", "2024-06-30")


ATTR = f"""{TAG}, ra AS (SELECT ad_id, arg_max(struct_pack(p := post_id, c := course_code, l := permalink), (created_time, post_id)) AS x FROM tg GROUP BY 1),
  fb AS (SELECT match_value AS ad_id, min(struct_pack(a := campaign_name, b := course_code)) AS f FROM lead_mappings WHERE match_on = 'adId' GROUP BY 1),
  wt AS (SELECT customer_id, lead_ad_id, lead_ad_id IS NULL OR lead_ad_or_organic = 'organic' AS org, x, f, coalesce(x.c, f.b) AS co FROM customers
    LEFT JOIN ra ON ra.ad_id = lead_ad_id LEFT JOIN fb ON fb.ad_id = lead_ad_id WHERE lead_pending AND source_channel = 'facebook_lead'),
  att AS (SELECT customer_id, CASE WHEN org THEN 'skipped_organic' WHEN co IS NOT NULL AND co <> 'NOPE' THEN 'resolved' ELSE 'unresolved' END AS status, org, co, x, f FROM wt)"""


def _attributed(t):
    extra = t.posts.select(F.concat(F.lit("ad_"), (F.col("page_id") + 1000).cast("string")).alias("ad_id"), "post_id")
    return O.attribute_leads(t.customers, tagged(t), extra, t.lead_mappings)


@query("attribute_leads", f"""WITH {ATTR} SELECT customer_id, status, CASE WHEN status = 'resolved' THEN co END AS course_code,
    CASE WHEN status = 'resolved' THEN CASE WHEN x.c IS NOT NULL THEN 'post' ELSE 'fallback' END END AS source, CASE WHEN NOT org THEN x.p END AS post_id FROM att""")
def attribute_leads(t):
    return _attributed(t).select("customer_id", "status", "course_code", "source", "post_id")


@query("attribution_report", f"""WITH {ATTR} SELECT count(*) AS considered, count(*) FILTER (status = 'resolved') AS resolved, count(*) FILTER (status = 'unresolved') AS unresolved,
    count(*) FILTER (status = 'skipped_organic') AS organic_skipped, count(*) FILTER (status = 'resolved' AND x.c IS NOT NULL) AS by_post, count(*) FILTER (status = 'resolved' AND x.c IS NULL) AS by_fallback FROM att""")
def attribution_report(t):
    return O.attribution_report(_attributed(t))


@query("apply_attribution", f"""WITH {ATTR} SELECT c.customer_id, CASE WHEN att.status = 'resolved' THEN FALSE ELSE lead_pending END AS lead_pending,
    CASE WHEN att.status = 'resolved' THEN 'ad' ELSE lead_ad_or_organic END AS lead_ad_or_organic FROM customers c LEFT JOIN att ON att.customer_id = c.customer_id""")
def apply_attribution(t):
    return O.apply_attribution(t.customers, _attributed(t)).select("customer_id", "lead_pending", "lead_ad_or_organic")


@query("marketing_leads", f"""WITH {ATTR} SELECT customer_id, CASE WHEN status = 'erased' THEN '' ELSE coalesce(display_name, line_display_name, '') END AS name, CASE WHEN status = 'erased' THEN '' ELSE coalesce(phone, '') END AS phone,
    CASE WHEN ra.ad_id IS NULL THEN '' ELSE trim(split_part(p.message, chr(10), 1)) || ' | ' || p.permalink END AS post, strftime(first_interaction_at, '%Y-%m-%d') AS day
    FROM customers LEFT JOIN ra ON ra.ad_id = lead_ad_id LEFT JOIN posts p ON p.post_id = ra.x.p WHERE source_channel = 'facebook_lead'""")
def marketing_leads(t):
    return O.marketing_leads(t.customers, tagged(t)).select("customer_id", "name", "phone", "post", "day")


@query("marketing_posts", f"""WITH {TAG} SELECT post_id, coalesce(course_code, '') AS course, strftime(created_time, '%Y-%m-%d') AS day, reactions + comments + shares AS engagement, reach,
    CASE WHEN unmapped THEN '{V.UNMAPPED_POST_MARK}' ELSE '' END AS mark FROM tg""")
def marketing_posts(t):
    return O.marketing_posts(tagged(t)).select("post_id", "course", "day", "engagement", "reach", "mark")


@query("marketing_counts", f"""WITH {TAG} SELECT (SELECT count(*) FROM customers) AS customers, (SELECT count(*) FROM customers WHERE source_channel = 'facebook_lead') AS leads,
    count(*) AS posts, count(*) FILTER (unmapped) AS unmapped_posts FROM tg""")
def marketing_counts(t):
    return O.marketing_counts(t.customers, tagged(t))
