"""Named queries for contact columns, form rules, snapshots, mirrors, health and the answer audit."""
from pyspark.sql import functions as F

from patronage.catalog import query
from patronage.functions import dates as DT, text as T
from patronage.functions.hashing import hmac_sha256
from patronage.operators import answers as A, identity as N, mirror as M, monitor as H, quality as Q, scrub as S
from patronage.plans.analytics import AnalyticsQuery, analytics_meta, run_analytics
from patronage.sources import store

KEY = "test-pepper"


# ---- contact and date columns over whole tables ---------------------------------------------

SPELL = ["'+66 8' || d", "'08' || d", "' 08' || d || ' '", "'668' || d", "'8' || d", "'+1 415' || d", "'07'", "'08-' || d"]
PHONE_SQL = "CASE c_custkey % 8 " + " ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(SPELL)) + " END"


@query("normalize_phones", f"""WITH p AS (SELECT c_custkey, lpad(CAST(c_custkey AS STRING), 8, '0') AS d FROM customer), s AS (SELECT c_custkey, d, {PHONE_SQL} AS raw FROM p)
    SELECT c_custkey, raw, CASE WHEN c_custkey % 8 IN (0, 1, 2, 3, 4, 7) THEN '+668' || d END AS phone, CASE WHEN c_custkey % 8 IN (0, 1, 2, 3, 4, 7) THEN '08x-xxx-' || right(d, 4) ELSE '' END AS masked FROM s""")
def normalize_phones(t):
    p = t.customer.select("c_custkey", F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("d")).withColumn("raw", F.expr(PHONE_SQL))
    phone = T.normalize_phone(F.col("raw"))
    return p.select("c_custkey", "raw", phone.alias("phone")).withColumn("masked", F.when(F.col("phone").isNull(), "").otherwise(T.mask_phone(F.col("phone"))))


@query("normalize_emails", """WITH s AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN ' User' || c_custkey || '@Example.COM ' WHEN 1 THEN 'a' || c_custkey || '@x' WHEN 2 THEN 'two words@x.com'
      WHEN 3 THEN 'u@' || c_custkey || '.co.th' ELSE repeat('x', 250) || '@x.com' END AS raw FROM customer)
    SELECT c_custkey, CASE WHEN c_custkey % 5 IN (0, 3) THEN lower(trim(raw)) END AS email, CASE WHEN c_custkey % 5 = 0 THEN 'us***@example.com' WHEN c_custkey % 5 = 3 THEN 'u***@' || c_custkey || '.co.th' ELSE '' END AS masked FROM s""")
def normalize_emails(t):
    raw = F.expr("""CASE c_custkey % 5 WHEN 0 THEN ' User' || c_custkey || '@Example.COM ' WHEN 1 THEN 'a' || c_custkey || '@x' WHEN 2 THEN 'two words@x.com'
      WHEN 3 THEN 'u@' || c_custkey || '.co.th' ELSE repeat('x', 250) || '@x.com' END""")
    e = t.customer.select("c_custkey", T.normalize_email(raw).alias("email"))
    return e.withColumn("masked", T.mask_email(F.col("email")))


@query("normalize_names", """SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'สมชาย ' || c_custkey WHEN 1 THEN 'John ' || c_custkey WHEN 2 THEN 'ake ' || c_custkey WHEN 3 THEN 'É ' || c_custkey WHEN 4 THEN 'Ms' ELSE NULL END AS name FROM customer""")
def normalize_names(t):
    raw = F.expr(r"""CASE c_custkey % 6 WHEN 0 THEN ' นาย  สมชาย ' || c_custkey WHEN 1 THEN 'MR. John ' || c_custkey WHEN 2 THEN 'Drake ' || c_custkey WHEN 3 THEN 'É ' || c_custkey WHEN 4 THEN 'Ms' ELSE ' x ' END""")
    return t.customer.select("c_custkey", T.normalize_name(raw).alias("name"))


@query("birth_years_and_bands", """WITH b AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 1950 + c_custkey % 70 ELSE 2440 + c_custkey % 160 END AS y FROM customer),
    n AS (SELECT c_custkey, CASE WHEN y < 2400 AND y > 1900 THEN y + 543 ELSE y END AS be FROM b), k AS (SELECT c_custkey, CASE WHEN be BETWEEN 2450 AND 2564 THEN be END AS be FROM n)
    SELECT c_custkey, be, 2569 - be AS age, CASE WHEN 2569 - be BETWEEN 10 AND 119 THEN CAST((2569 - be) // 10 * 10 AS STRING) || '-' || CAST((2569 - be) // 10 * 10 + 9 AS STRING) END AS band FROM k""")
def birth_years(t):
    y = F.expr("CASE WHEN c_custkey % 3 = 0 THEN 1950 + c_custkey % 70 ELSE 2440 + c_custkey % 160 END").cast("string")
    k = t.customer.select("c_custkey", T.birth_year_be(y, 2026).alias("be")).withColumn("age", T.age_from_be(F.col("be"), 2026))
    return k.withColumn("band", T.age_band(F.col("age")))


@query("event_period_keys", """WITH l AS (SELECT event_id, CAST(ts + INTERVAL 7 HOUR AS DATE) AS d FROM events) SELECT event_id, strftime(d, '%Y-%m-%d') AS day,
    strftime(date_trunc('week', d), '%Y-%m-%d') AS week, strftime(d, '%Y-%m') AS month FROM l""")
def period_keys(t):
    d = DT.local_date(F.col("ts").cast("timestamp"))
    return t.events.select("event_id", *[DT.period_key(d, u).alias(u) for u in ("day", "week", "month")])


@query("keyed_hash_documents", f"""SELECT doc_id, sha256(unhex('{bytes(b ^ 0x5C for b in KEY.encode().ljust(64, b"\0")).hex()}') ||
    unhex(sha256(unhex('{bytes(b ^ 0x36 for b in KEY.encode().ljust(64, b"\0")).hex()}') || encode(text)))) AS h FROM documents""")
def keyed_hash(t):
    return t.documents.select("doc_id", hmac_sha256(F.col("text"), KEY).alias("h"))


@query("sheet_ranges", """WITH RECURSIVE i AS (SELECT c_custkey, c_custkey AS i, '' AS letters FROM customer
      UNION ALL SELECT c_custkey, i // 26 - 1, chr(CAST(65 + i % 26 AS INT)) || letters FROM i WHERE i >= 0)
    SELECT c_custkey, letters FROM i WHERE i < 0""")
def sheet_ranges(t):
    return t.customer.select("c_custkey", T.column_letter(F.col("c_custkey")).alias("letters"))


# ---- forms ----------------------------------------------------------------------------------

RULES = [
    Q.Rule("fullNameTh", "text", required=True, max_length=200), Q.Rule("nickname", "text", min_length=2), Q.Rule("phone", "tel", required=True),
    Q.Rule("heardFrom", "select", options=("friend", "ad")), Q.Rule("interests", "checkbox", required=True, min_items=1, max_items=2, options=("a", "b", "c")),
    Q.Rule("birthYear", "number", min=1900, max=2600), Q.Rule("consentDataProcessing", "consent", required=True),
    Q.Rule("other", "text", required=True, visible_if=("heardFrom", "eq", "radio")), Q.Rule("banner", "image")]
BAD = """bad AS (SELECT event_id, unnest([CASE WHEN event_id % 5 = 0 THEN 'fullNameTh/required' END, CASE WHEN event_id % 4 = 0 THEN 'nickname/min_length' END,
    CASE WHEN event_id % 3 <> 0 AND event_id % 7 = 0 THEN 'phone/phone' END,
    CASE WHEN event_id % 3 = 0 THEN 'phone/required' END,
    CASE WHEN event_id % 3 = 2 THEN 'heardFrom/option' END, CASE WHEN event_id % 4 = 0 THEN 'interests/min_items' END, CASE WHEN event_id % 4 = 3 THEN 'interests/max_items' END,
    CASE WHEN event_id % 4 = 2 THEN 'interests/option' END, CASE WHEN event_id % 4 = 0 THEN 'interests/required' END, CASE WHEN event_id % 6 = 0 THEN 'consentDataProcessing/required' END,
    CASE WHEN event_id % 3 = 2 THEN 'other/required' END, CASE WHEN event_id % 8 = 0 THEN 'isAdmin/unknown' END]) AS v FROM submissions)"""


@query("form_violations", f"WITH {BAD} SELECT event_id, split_part(v, '/', 1) AS field, split_part(v, '/', 2) AS code FROM bad WHERE v IS NOT NULL")
def form_violations(t):
    return Q.violations(t.submissions, RULES, "event_id")


@query("form_normalized", """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '' ELSE 'Name ' || event_id END AS full_name, '2535' AS birth_year FROM submissions""")
def form_normalized(t):
    n = Q.normalize_answers(t.submissions, RULES, 2026)
    return n.select("event_id", F.col("normal")["fullNameTh"].alias("full_name"), F.col("normal")["birthYear"].alias("birth_year"))


@query("form_answer_summary", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN '1 characters' WHEN 1 THEN '4 characters' END AS nickname, CASE event_id % 4 WHEN 0 THEN '0 items' WHEN 1 THEN '1 items' WHEN 2 THEN '2 items' ELSE '3 items' END AS interests,
    CASE WHEN event_id % 6 = 0 THEN '5 characters' ELSE 'ticked' END AS consent FROM submissions""")
def form_summary(t):
    n = Q.normalize_answers(t.submissions, RULES, 2026).withColumn("s", Q.summarize_answers(F.col("normal")))
    return n.select("event_id", F.col("s")["nickname"].alias("nickname"), F.col("s")["interests"].alias("interests"), F.col("s")["consentDataProcessing"].alias("consent"))


SCHEMAS = """sc AS (SELECT 'form-' || (event_id % 50) AS form_id, CAST(event_id // 50 AS INT) AS version, ts AS published_at,
    CASE WHEN event_id % 3 = 0 THEN 'published' ELSE 'archived' END AS status FROM events WHERE event_type = 'signup')"""


def _schemas(t):
    """Form versions read off the sign-up events."""
    return t.events.where("event_type = 'signup'").select(
        F.concat(F.lit("form-"), (F.col("event_id") % 50).cast("string")).alias("form_id"), F.floor(F.col("event_id") / 50).cast("int").alias("version"),
        F.col("ts").alias("published_at"), F.when(F.col("event_id") % 3 == 0, "published").otherwise("archived").alias("status"))


@query("form_version_conflicts", f"""WITH {SCHEMAS}, su AS (SELECT event_id, 'form-' || (event_id % 50) AS form_id, CAST(event_id // 50 AS INT) AS version FROM events)
    SELECT event_id, CASE WHEN status IS NULL THEN 'unknown' WHEN status = 'published' THEN 'ok' ELSE 'conflict' END AS version_state
    FROM su LEFT JOIN sc ON sc.form_id = su.form_id AND sc.version = su.version""")
def form_versions(t):
    sub = t.submissions.withColumns({"form_id": F.concat(F.lit("form-"), (F.col("event_id") % 50).cast("string")), "version": F.floor(F.col("event_id") / 50).cast("int")})
    return Q.version_conflicts(sub, _schemas(t)).select("event_id", "version_state")


@query("published_form", f"WITH {SCHEMAS} SELECT form_id, arg_max(version, (published_at, version)) AS version FROM sc WHERE status = 'published' GROUP BY 1")
def published_form(t):
    return Q.published(_schemas(t))


FIRSTS = f"""{BAD}, fs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY idempotency_key ORDER BY "at", submission_id) AS rn FROM submissions
    WHERE event_id NOT IN (SELECT event_id FROM bad WHERE v IS NOT NULL)) WHERE rn = 1)"""


def _revised(t):
    stored = t.customers.where("c_custkey % 2 = 0").select("customer_id", (F.col("c_custkey") % 5).cast("int").alias("revision"))
    return Q.number_revisions(Q.first_submissions(Q.valid_submissions(t.submissions, RULES)), stored)


REV = f"""{FIRSTS}, rv AS (SELECT fs.*, CAST(coalesce(CASE WHEN CAST(substr(customer_id, 5) AS BIGINT) % 2 = 0 AND CAST(substr(customer_id, 5) AS BIGINT) < (SELECT count(*) FROM customer)
    THEN CAST(substr(customer_id, 5) AS BIGINT) % 5 END, 0) + row_number() OVER (PARTITION BY customer_id ORDER BY "at", submission_id) AS INT) AS revision FROM fs)"""


@query("form_revisions", f"WITH {REV} SELECT submission_id, customer_id, revision FROM rv")
def form_revisions(t):
    return _revised(t).select("submission_id", "customer_id", "revision")


@query("form_write_back", f"""WITH {REV}, nm AS (SELECT customer_id, arg_max('Name ' || event_id, revision) AS n, arg_max('nick', revision) AS k, arg_max('ad', revision) AS h, max("at") AS sat,
      arg_max('+668' || lpad(CAST(event_id AS STRING), 8, '0'), revision) AS ph, count(*) AS subs FROM rv GROUP BY 1),
    o AS (SELECT customer_id AS oid, phone AS op FROM customers WHERE status = 'active' AND phone IS NOT NULL),
    cf AS (SELECT nm.customer_id, min(oid) AS cand FROM nm JOIN o ON op = ph AND oid <> nm.customer_id GROUP BY 1)
    SELECT c.customer_id, coalesce(n, display_name) AS display_name, coalesce(k, nickname) AS nickname, coalesce(h, heard_from) AS heard_from, coalesce(ph, phone) AS phone,
      CASE WHEN n IS NOT NULL THEN 2535 ELSE birth_year END AS birth_year, consent_data OR n IS NOT NULL AS consent_data, CASE WHEN n IS NOT NULL THEN FALSE ELSE consent_marketing END AS consent_marketing,
      CASE WHEN n IS NOT NULL THEN 'form-completed' ELSE '' END AS tags, coalesce(subs, 0) AS form_submits, cand AS pending_merge, sheet_dirty OR n IS NOT NULL AS sheet_dirty, ai_dirty OR n IS NOT NULL AS ai_dirty,
      strftime(greatest(coalesce(form_submitted_at, sat), coalesce(sat, form_submitted_at)), '%Y-%m-%d %H:%M:%S') AS form_submitted_at
    FROM customers c LEFT JOIN nm ON nm.customer_id = c.customer_id LEFT JOIN cf ON cf.customer_id = c.customer_id""")
def form_write_back(t):
    valid = Q.normalize_answers(_revised(t), RULES, 2026)
    claims = valid.groupBy("customer_id").agg(F.max_by(F.col("normal")["phone"], "revision").alias("phone"))
    conflicts = N.contact_conflicts(claims, t.customers, t.spark.createDataFrame([], "a string, b string"))
    written = Q.write_back(t.customers, valid, "2026-01-01", conflicts)
    return written.select("customer_id", "display_name", "nickname", "heard_from", "phone", "birth_year", "consent_data", "consent_marketing", F.concat_ws(",", "tags").alias("tags"),
                          "form_submits", "pending_merge", "sheet_dirty", "ai_dirty", F.date_format("form_submitted_at", "yyyy-MM-dd HH:mm:ss").alias("form_submitted_at"))


@query("current_answers", f"""WITH {REV}, nm AS (SELECT customer_id, arg_max(event_id, revision) AS e FROM rv GROUP BY 1)
    SELECT c.customer_id, CASE WHEN e IS NULL THEN display_name ELSE 'Name ' || e END AS full_name FROM customers c LEFT JOIN nm ON nm.customer_id = c.customer_id""")
def current_answers(t):
    profiles = Q.normalize_answers(_revised(t), RULES, 2026).select(
        "customer_id", "revision", F.col("normal").alias("answers"))
    stored = t.customers.select("customer_id", F.create_map(F.lit("fullNameTh"), F.col("display_name")).alias("fields"))
    return Q.current_answers(stored, profiles).select("customer_id", F.col("answers")["fullNameTh"].alias("full_name"))


@query("cap_client_meta", """SELECT event_id, least(256, 1 + event_id % 400) AS a_len, 256 AS b_len, least(256, length(props)) AS c_len FROM events""")
def cap_meta(t):
    keys = F.array(F.lit("a"), F.lit("b"), F.lit("k" * 41), F.lit("c"))
    meta = F.create_map(F.lit("a"), F.repeat(F.lit("x"), (1 + F.col("event_id") % 400).cast("int")), F.lit("b"), F.repeat(F.lit("y"), F.lit(1000)),
                        F.lit("k" * 41), F.col("props"), F.lit("c"), F.col("props"))
    capped = t.events.select("event_id", Q.cap_meta(keys, meta).alias("m"))
    return capped.select("event_id", *[F.length(F.col("m")[k]).alias(f"{k}_len") for k in "abc"])


# ---- snapshots and mirrors ------------------------------------------------------------------

@query("snapshot_upsert", "SELECT purchase_id, CASE WHEN ai_dirty THEN 'new' ELSE status END AS status FROM purchases")
def snapshot_upsert(t):
    old = t.purchases.select("purchase_id", "status")
    return store.upsert(old, t.purchases.where("ai_dirty").select("purchase_id", F.lit("new").alias("status")), ["purchase_id"])


@query("replace_child_rows", "SELECT p.purchase_id, CASE WHEN ai_dirty THEN 'fresh' ELSE i.course_code END AS course_code FROM purchases p JOIN purchase_items i ON i.purchase_id = p.purchase_id")
def replace_children(t):
    changed = t.purchases.where("ai_dirty").select("purchase_id")
    items = t.purchase_items.select("purchase_id", "course_code")
    fresh = items.join(changed, "purchase_id", "left_semi").withColumn("course_code", F.lit("fresh"))
    return store.replace_children(items.join(t.purchases.select("purchase_id"), "purchase_id", "left_semi"), fresh, changed, "purchase_id")


@query("mirror_prune", "SELECT (SELECT count(*) FROM customers WHERE c_custkey % 3 <> 0) AS kept, (SELECT count(*) FROM customers WHERE c_custkey % 3 = 0) AS removed")
def mirror_prune(t):
    kept, gone = store.prune(t.customers.select("customer_id"), t.customers.where("c_custkey % 3 <> 0"), "customer_id")
    return kept.agg(F.count("*").alias("kept")).withColumn("removed", gone.agg(F.count("*")).scalar())


def _mirror(t):
    """A mirror that misses some customers, holds old versions of others and keeps two that are gone."""
    m = t.customers.where("c_custkey % 7 <> 0").withColumn(
        "updated_at", F.when(F.col("c_custkey") % 5 == 0, F.col("updated_at") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("updated_at")))
    ghost = t.customers.where("c_custkey in (1, 2)").withColumn("customer_id", F.concat(F.lit("gone_"), "customer_id"))
    return S.scrub_customers(m.unionByName(ghost), KEY)


@query("mirror_pending", "SELECT customer_id FROM customers WHERE c_custkey % 7 = 0 OR c_custkey % 5 = 0")
def mirror_pending(t):
    return M.pending(t.customers, _mirror(t), "customer_id").select("customer_id")


@query("mirror_advance", "SELECT customer_id, strftime(updated_at, '%Y-%m-%d') AS source_day FROM customers")
def mirror_advance(t):
    nxt = M.advance(t.customers, _mirror(t), "customer_id", lambda d: S.scrub_customers(d, KEY))
    return nxt.select("customer_id", F.date_format("source_updated_at", "yyyy-MM-dd").alias("source_day"))


@query("mirror_full_resync", "SELECT count(*) AS n FROM customers")
def mirror_full(t):
    return M.advance(t.customers, _mirror(t), "customer_id", lambda d: S.scrub_customers(d, KEY), full=True).agg(F.count("*").alias("n"))


@query("mirror_completeness", """SELECT count(*) AS source_rows, count(*) FILTER (c_custkey % 7 <> 0) + 2 AS mirror_rows, count(*) FILTER (c_custkey % 7 = 0) AS missing, 2 AS orphans,
    count(*) FILTER (c_custkey % 7 <> 0 AND c_custkey % 5 = 0) AS pending, FALSE AS ok FROM customers""")
def mirror_completeness(t):
    return M.completeness(t.customers, _mirror(t), "customer_id")


# ---- health ---------------------------------------------------------------------------------

NOW = "2024-02-01 00:00:00"


def issues(t):
    inbound = t.inbound.select("status", "received_at", F.col("received_at").alias("due_at"))
    errors = t.events.where("event_type = 'error'").select(F.col("ts").cast("timestamp").alias("at"))
    return H.evaluate(inbound, t.customers, t.purchases, t.intents, errors, NOW, H.Thresholds(error_window_minutes=1440 * 8))


HEALTH = f"""n AS (SELECT TIMESTAMP '{NOW}' AS now),
  ai AS (SELECT ai_dirty, updated_at, sync_attempts FROM customers UNION ALL SELECT ai_dirty, updated_at, 0 FROM purchases UNION ALL SELECT ai_dirty, updated_at, sync_attempts FROM intents),
  iss AS (SELECT 'inbound.dead' AS code, 'critical' AS severity, count(*) AS count, NULL::BIGINT AS age_minutes FROM inbound WHERE status = 'dead'
    UNION ALL SELECT 'inbound.stale', 'warning', least(1, count(*)), date_diff('second', date_trunc('second', min(received_at)), max(now)) // 60 FROM inbound, n WHERE status IN ('pending', 'processing', 'failed') AND received_at <= now - INTERVAL 15 MINUTE
    UNION ALL SELECT 'sheet.dead', 'critical', count(*), NULL FROM customers WHERE sheet_dirty AND sync_attempts >= 5
    UNION ALL SELECT 'sheet.stale', 'warning', least(1, count(*)), date_diff('second', min(updated_at), max(now)) // 60 FROM customers, n WHERE sheet_dirty AND updated_at <= now - INTERVAL 30 MINUTE
    UNION ALL SELECT 'ai_mirror.dead', 'critical', count(*), NULL FROM ai WHERE ai_dirty AND sync_attempts >= 5
    UNION ALL SELECT 'ai_mirror.stale', 'warning', least(1, count(*)), date_diff('second', min(updated_at), max(now)) // 60 FROM ai, n WHERE ai_dirty AND updated_at <= now - INTERVAL 30 MINUTE
    UNION ALL SELECT 'workflow.error_spike', 'warning', count(*), 11520 FROM events, n WHERE event_type = 'error' AND ts >= now - INTERVAL 8 DAY HAVING count(*) >= 10),
  op AS (SELECT * FROM iss WHERE count > 0)"""


@query("health_issues", f"WITH {HEALTH} SELECT * FROM op")
def health(t):
    return issues(t)


STATES = [("inbound.dead", "open"), ("sheet.dead", "resolved"), ("never.seen", "open"), ("old.closed", "resolved")]


def _state(t):
    """An incident table derived from the event log: counts as occurrences."""
    n = t.events.agg(F.count("*").alias("n"))
    rows = F.array(*[F.struct(F.lit(c).alias("code"), F.lit(s).alias("status")) for c, s in STATES])
    at = F.lit("2024-01-15 00:00:00").cast("timestamp")
    return n.select(F.explode(rows).alias("r"), "n").select("r.code", F.lit("critical").alias("severity"), "r.status", at.alias("first_seen_at"), at.alias("last_seen_at"),
                                                            at.alias("reported_at"), F.when(F.col("r.status") == "resolved", at).alias("resolved_at"), F.col("n").cast("int").alias("occurrences"))


@query("incident_lifecycle", f"""WITH {HEALTH}, st AS (SELECT code, status, (SELECT count(*) FROM events) AS occ FROM (VALUES {', '.join(str(s) for s in STATES)}) v(code, status))
    SELECT coalesce(st.code, op.code) AS code, CASE WHEN op.code IS NOT NULL THEN 'open' ELSE 'resolved' END AS status, CASE WHEN op.code IS NOT NULL AND st.status = 'open' THEN 'still_open'
      WHEN op.code IS NOT NULL THEN 'reported' WHEN st.status = 'open' THEN 'resolved' ELSE 'unchanged' END AS action, coalesce(occ, 0) + (op.code IS NOT NULL)::INT AS occurrences
    FROM st FULL JOIN op ON op.code = st.code""")
def incidents(t):
    return H.update_incidents(issues(t), _state(t), NOW).select("code", "status", "action", "occurrences")


@query("oldest_dirty_customer", "SELECT customer_id FROM customers WHERE sheet_dirty ORDER BY updated_at, customer_id LIMIT 1")
def oldest_dirty(t):
    return H.oldest_row(t.customers.where("sheet_dirty"), "updated_at", "customer_id").select("customer_id")


# ---- answers --------------------------------------------------------------------------------

@query("audit_answers", """WITH o AS (SELECT o_orderkey AS k, CAST(o_totalprice AS DECIMAL(18,2)) AS a FROM orders),
    x AS (SELECT k, CAST(k + 3000 AS STRING) AS tok, a FROM o),
    al AS (SELECT *, list_concat([rtrim(rtrim(CAST(a AS STRING), '0'), '.'), CAST(floor(a + 0.5) AS BIGINT)::STRING, CAST(round(a, 1) AS DECIMAL(18,1))::STRING, CAST(a AS STRING)], ['0.25', '0', '0.3', '25', '25.0', '25.00', '1', '1.0', '1.00', '100', '100.0', '100.00',
      CAST(k % 50 + 2 AS STRING)]) AS ok FROM x)
    SELECT k, CASE WHEN list_contains(ok, tok) OR contains('1997-03', tok) OR contains('1997-01-01 1997-12-31', tok) THEN '' ELSE tok END AS invented FROM al""")
def audit(t):
    o = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").cast("decimal(18,2)").alias("a"))
    row = F.struct(F.lit("1997-03").alias("key"), F.lit("1997-03").alias("label"), F.col("a").cast("double").alias("value"), F.lit(0.25).alias("share"), F.lit(None).cast("double").alias("delta"))
    text = F.concat(F.lit("In 1997 sales were "), F.col("a").cast("string"), F.lit(" (25%) and "), (F.col("k") + 3000).cast("string"))
    ins = o.select("k", F.array(row).alias("rows"), F.col("a").cast("double").alias("total"), (F.col("k") % 50 + 2).alias("rows_scanned"),
                   F.lit("1997-01-01").alias("start"), F.lit("1997-12-31").alias("end"), text.alias("answer"))
    return A.audit_answers(ins).select("k", F.concat_ws(",", "invented").alias("invented"))


@query("insight_audit_row", """WITH g AS (SELECT status || coalesce('/' || hesitation_reason, '') AS key, count(*) AS v FROM intents WHERE voided_at IS NULL AND NOT below_threshold AND confidence >= 0.6 GROUP BY 1)
    SELECT 'intent_funnel' AS metric, count(*) AS groups, CAST(sum(v) AS DOUBLE) AS total, CAST(sum(v) AS BIGINT) AS rows_scanned, '7.77' AS invented FROM g""")
def insight(t):
    q = AnalyticsQuery("intent_funnel", start="1997-01-01", end="1997-12-31")
    row = A.insight_rows(run_analytics(t, q), analytics_meta(t, q), "How many?", "It was 7.77 in 1997")
    return A.audit_answers(row).select("metric", F.size("rows").alias("groups"), "total", "rows_scanned", F.concat_ws(",", "invented").alias("invented"))
