"""Named queries for opinions, recommendations, reports and profiles."""
from pyspark.sql import functions as F

from patronage.catalog import query
from patronage.functions import vocabulary as V
from patronage.functions.courses import COURSES
from patronage.operators import intents as I, precedence, recommend as R
from patronage.plans import reports as P

NOW = "1999-06-30"
STAMP = "2024-06-30 00:00:00"
NAME = lambda c: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{n}'" for k, n, _, _ in COURSES) + f" ELSE {c} END"
CUR = """cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_id, course_code ORDER BY observed_at DESC,
    CASE WHEN source = 'staff' THEN 0 ELSE 1 END, confidence DESC, created_at DESC, intent_id DESC) AS rn FROM intents
    WHERE customer_id IS NOT NULL AND voided_at IS NULL) WHERE rn = 1)"""


@query("current_intents", f"WITH {CUR} SELECT customer_id, course_code, intent_id, status FROM cur")
def current(t):
    return I.current_intents(t.intents).select("customer_id", "course_code", "intent_id", "status")


@query("mark_superseded", f"""WITH {CUR} SELECT i.intent_id, i.customer_id IS NOT NULL AND cur.intent_id IS NULL AS superseded
    FROM intents i LEFT JOIN cur ON i.intent_id = cur.intent_id""")
def superseded(t):
    return I.mark_superseded(t.intents, STAMP).select("intent_id", F.col("superseded_at").isNotNull().alias("superseded"))


VERDICT_SQL = """WITH RECURSIVE ordered AS (SELECT *, row_number() OVER (PARTITION BY customer_id, course_code ORDER BY created_at, intent_id) AS n
      FROM intents WHERE customer_id IS NOT NULL AND voided_at IS NULL),
    f AS (SELECT customer_id, course_code, 0::BIGINT AS n, NULL::STRING AS intent_id, NULL::STRING AS rejection,
        NULL::TIMESTAMP AS c_obs, FALSE AS c_staff, 0.0::DOUBLE AS c_conf, NULL::TIMESTAMP AS c_created, NULL::STRING AS c_id, FALSE AS c_sticky
      FROM (SELECT DISTINCT customer_id, course_code FROM ordered)
      UNION ALL SELECT customer_id, course_code, n, intent_id, rejection, CASE WHEN win THEN observed_at ELSE c_obs END,
        CASE WHEN win THEN source = 'staff' ELSE c_staff END, CASE WHEN win THEN confidence ELSE c_conf END,
        CASE WHEN win THEN created_at ELSE c_created END, CASE WHEN win THEN intent_id ELSE c_id END,
        CASE WHEN win THEN lock_kind = 'sticky' ELSE c_sticky END
      FROM (SELECT *, rejection IS NULL AND (c_obs IS NULL OR observed_at > c_obs OR (observed_at = c_obs AND
          (source = 'staff')::INT > c_staff::INT) OR (observed_at = c_obs AND (source = 'staff') = c_staff
          AND (confidence > c_conf OR (confidence = c_conf AND (created_at > c_created OR (created_at = c_created AND intent_id > c_id)))))) AS win
        FROM (SELECT f.c_obs, f.c_staff, f.c_conf, f.c_created, f.c_id, f.c_sticky, o.*, CASE WHEN o.source = 'ai' AND f.c_staff AND f.c_sticky THEN 'staff_sticky'
            WHEN o.source = 'ai' AND f.c_staff AND o.observed_at <= f.c_obs THEN 'staff_decided' END AS rejection
          FROM f JOIN ordered o ON o.customer_id = f.customer_id AND o.course_code IS NOT DISTINCT FROM f.course_code AND o.n = f.n + 1)))
    SELECT intent_id, rejection FROM f WHERE n > 0
    UNION ALL SELECT intent_id, NULL FROM intents WHERE customer_id IS NULL AND voided_at IS NULL"""


@query("staff_verdicts", VERDICT_SQL)
def verdicts(t):
    return precedence.staff_verdicts(t.intents.where("voided_at is null")).select("intent_id", "rejection")


HIST = """h AS (SELECT p.customer_id, course_code, counts_as_seat, session_start, 'partner' AS source, synthetic FROM purchase_items i
      JOIN purchases p ON i.purchase_id = p.purchase_id WHERE status = 'active' AND p.customer_id IS NOT NULL
    UNION ALL SELECT customer_id, course_code, counts_as_seat, session_start, 'legacy', synthetic FROM legacy_enrollments e
      JOIN (SELECT DISTINCT customer_id, legacy_person_id FROM customer_links WHERE status = 'confirmed') k ON e.person_id = k.legacy_person_id),
  bought AS (SELECT DISTINCT customer_id, course_code FROM h)"""
REVIEWED = "rv AS (SELECT DISTINCT 'upsell:' || customer_id || ':COMMU' AS reco_id FROM customers WHERE c_custkey % 2 = 0)"


def _reviews(t):
    return t.customers.where("c_custkey % 2 = 0").select(F.concat_ws(":", F.lit("upsell"), "customer_id", F.lit("COMMU")).alias("reco_id"))


@query("follow_up_recommendations", f"""WITH {CUR}, {HIST} SELECT 'follow_up:' || cur.customer_id || ':' || cur.course_code AS reco_id,
    cur.course_code, {NAME('cur.course_code')} AS course_name, coalesce(c.display_name, c.line_display_name, c.customer_id) AS customer_name,
    hesitation_reason, CASE WHEN hesitation_reason = 'budget' THEN '{V.ACTION_BUDGET}'
      WHEN hesitation_reason IN ('timing_conflict', 'not_ready') THEN '{V.ACTION_NEXT_ROUND}' ELSE '{V.ACTION_GENERAL}' END AS suggested_action
    FROM cur JOIN customers c ON cur.customer_id = c.customer_id LEFT JOIN bought b ON b.customer_id = cur.customer_id AND b.course_code = cur.course_code
    WHERE cur.status = 'hesitant' AND cur.course_code IS NOT NULL AND c.status = 'active' AND consent_marketing AND b.customer_id IS NULL""")
def follow(t):
    return R.opportunities(t, _reviews(t), NOW)[0].select(
        "reco_id", "course_code", "course_name", "customer_name", "hesitation_reason", "suggested_action")


LADDER = "(VALUES ('INNER','COMMU'), ('INNER','DEEPIN'), ('INNER','INNERCAMP'), ('COMMU','PRESENT'), ('PRESENT','TTRT')) AS ladder(code, nxt)"


@query("upsell_recommendations", f"""WITH {HIST}, {REVIEWED}, done AS (SELECT customer_id, course_code, max(session_start) AS completed_at
      FROM h WHERE counts_as_seat AND session_start < DATE '{NOW}' GROUP BY 1, 2),
    cand AS (SELECT d.customer_id, nxt, d.course_code, completed_at, row_number() OVER (PARTITION BY d.customer_id, nxt ORDER BY completed_at DESC, d.course_code) AS rn
      FROM done d JOIN {LADDER} ON d.course_code = code LEFT JOIN bought b ON b.customer_id = d.customer_id AND b.course_code = nxt WHERE b.customer_id IS NULL)
    SELECT 'upsell:' || cand.customer_id || ':' || nxt AS reco_id, cand.course_code AS completed_course_code, nxt AS course_code, completed_at
    FROM cand JOIN customers c ON c.customer_id = cand.customer_id WHERE rn = 1 AND c.status = 'active'
      AND 'upsell:' || cand.customer_id || ':' || nxt NOT IN (SELECT reco_id FROM rv)""")
def upsell(t):
    return R.opportunities(t, _reviews(t), NOW)[1].select("reco_id", "completed_course_code", "course_code", "completed_at")


@query("recommendation_review_log", """SELECT reco_id, min(ts) AS at FROM (SELECT 'upsell:cus_' || CAST(user_id AS STRING) || CASE WHEN event_id % 9 = 0 THEN '' ELSE ':COMMU' END AS reco_id,
    strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, event_type FROM events) WHERE reco_id LIKE '%:COMMU' AND event_type IN ('click', 'view') GROUP BY 1""")
def review_log(t):
    d = t.events.select(
        F.concat(F.lit("upsell:cus_"), "user_id", F.when(F.col("event_id") % 9 == 0, "").otherwise(":COMMU")).alias("reco_id"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), F.lit("staff").alias("actor"),
        F.expr("CASE event_type WHEN 'click' THEN 'accepted' WHEN 'view' THEN 'dismissed' ELSE event_type END").alias("status"))
    return R.review_log(d).select("reco_id", "at")


SALES = """bills AS (SELECT * FROM purchases WHERE status = 'active' AND customer_id IS NOT NULL),
  paid AS (SELECT customer_id, sum(coalesce(amount, 0)) AS total, max(coalesce(CAST(paid_at AS TIMESTAMP), created_at)) AS last_at FROM bills GROUP BY 1),
  ln AS (SELECT b.customer_id, count(CASE WHEN counts_as_seat THEN 1 END) AS seats, string_agg(DISTINCT course_code, ', ' ORDER BY course_code) AS courses
    FROM purchase_items i JOIN bills b ON i.purchase_id = b.purchase_id GROUP BY 1),
  k AS (SELECT DISTINCT customer_id, legacy_person_id FROM customer_links WHERE status = 'confirmed'),
  old AS (SELECT k.customer_id, sum(coalesce(amount, 0)) AS old_paid, TRUE AS linked FROM k LEFT JOIN legacy_payments l ON l.person_id = k.legacy_person_id GROUP BY 1),
  oldp AS (SELECT k.customer_id, count(l.person_id) AS n FROM k LEFT JOIN legacy_payments l ON l.person_id = k.legacy_person_id GROUP BY 1),
  sr AS (SELECT c.customer_id, coalesce(display_name, line_display_name, nickname) AS name, CASE WHEN linked THEN 'returning' ELSE 'new' END AS kind,
    customer_status, strftime(last_at, '%Y-%m-%d') AS last_activity, total, coalesce(seats, 0) AS seats, coalesce(courses, '') AS courses,
    CASE WHEN n > 0 THEN old_paid END AS old_paid
    FROM customers c JOIN paid ON paid.customer_id = c.customer_id LEFT JOIN ln ON ln.customer_id = c.customer_id
    LEFT JOIN old ON old.customer_id = c.customer_id LEFT JOIN oldp ON oldp.customer_id = c.customer_id)"""


@query("sales_report", f"WITH {SALES} SELECT customer_id, name, kind, customer_status, last_activity, total, seats, courses, old_paid FROM sr")
def sales(t):
    return P.sales_report(t).select("customer_id", "name", "kind", "customer_status", F.date_format("last_activity", "yyyy-MM-dd").alias("last_activity"),
                                    F.col("new_purchase_total").alias("total"), F.col("new_seat_count").alias("seats"),
                                    F.concat_ws(", ", "courses").alias("courses"), F.col("legacy_total_paid").alias("old_paid"))


@query("sales_summary", f"""WITH {SALES} SELECT count(*) AS total_customers, count(CASE WHEN kind = 'new' THEN 1 END) AS new_count,
    count(CASE WHEN kind = 'returning' THEN 1 END) AS returning_count, sum(total) AS revenue, sum(seats) AS seat_count FROM sr""")
def sales_summary(t):
    return P.sales_summary(P.sales_report(t))


@query("sales_summary_1997", """WITH b AS (SELECT * FROM purchases JOIN (SELECT customer_id AS cid FROM customers) ON cid = customer_id
      WHERE status = 'active' AND paid_at BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'),
    k AS (SELECT DISTINCT customer_id FROM customer_links WHERE status = 'confirmed')
    SELECT count(DISTINCT b.customer_id) AS total_customers, count(DISTINCT CASE WHEN k.customer_id IS NULL THEN b.customer_id END) AS new_count,
    count(DISTINCT k.customer_id) AS returning_count, sum(coalesce(amount, 0)) AS revenue,
    (SELECT count(*) FROM purchase_items i JOIN b ON i.purchase_id = b.purchase_id WHERE counts_as_seat) AS seat_count
    FROM b LEFT JOIN k ON b.customer_id = k.customer_id""")
def sales_summary_range(t):
    return P.sales_summary(P.sales_report(t, "1997-01-01", "1997-12-31"))


def _trim(c):
    return f"rtrim(rtrim(CAST({c} AS STRING), '0'), '.')"


@query("sales_sheet", f"""WITH {SALES}, tot AS (SELECT count(*) AS n, count(CASE WHEN kind = 'new' THEN 1 END) AS a, count(CASE WHEN kind = 'returning' THEN 1 END) AS b,
      sum(total) AS rev, sum(seats) AS st FROM sr)
    SELECT 0 AS section, 'สรุป' AS c1, 'ลูกค้ารวม ' || n || ' คน' AS c2, '🆕 ใหม่ ' || a || ' คน' AS c3, '🔁 กลับมาซื้อ ' || b || ' คน' AS c4,
      'ยอดใหม่ ' || {_trim('rev')} || ' บาท' AS c5, 'ที่นั่ง ' || st AS c6 FROM tot
    UNION ALL SELECT 1, {', '.join(f"'{h}'" for h in V.SALES_HEADERS)}
    UNION ALL SELECT 2, coalesce(name, ''), CASE WHEN kind = 'returning' THEN '{V.KIND_RETURNING_LABEL}' ELSE '{V.KIND_NEW_LABEL}' END, courses,
      {_trim('total')}, coalesce({_trim('old_paid')}, ''), last_activity FROM sr""")
def sales_sheet(t):
    return P.sales_sheet(P.sales_report(t)).drop("sort_at", "sort_id")


DISP = CUR.replace("voided_at IS NULL)", "voided_at IS NULL)") + ", disp AS (SELECT * FROM cur WHERE status IN ('interested', 'hesitant', 'not_interested'))"


def _case(c, pairs):
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + " END"


@query("intent_sheet", f"""WITH {DISP} SELECT 2 AS section, CASE WHEN c.status = 'erased' THEN '' ELSE coalesce(display_name, line_display_name, nickname, '') END AS c1,
    coalesce(course_code, '') AS c2, {_case('disp.status', V.INTENT_STATUS_LABELS)} AS c3, coalesce({_case('hesitation_reason', V.INTENT_REASON_LABELS)}, '') AS c4,
    regexp_replace(rtrim(rtrim(printf('%.2f', floor(confidence * 10000 + 0.5) / 100), '0'), '.'), '^$', '0') || '%' AS c5,
    CASE WHEN source = 'staff' THEN '{V.SOURCE_STAFF_LABEL}' ELSE 'AI' END AS c6, strftime(observed_at, '%Y-%m-%d') AS c7
    FROM disp LEFT JOIN customers c ON c.customer_id = disp.customer_id""")
def intent_sheet(t):
    return P.intent_sheet(I.displayable(I.mark_superseded(t.intents, STAMP)), t.customers).drop("sort_at", "sort_id")


@query("intent_summary", f"""WITH {DISP} SELECT count(CASE WHEN status = 'interested' THEN 1 END) AS interested,
    count(CASE WHEN status = 'hesitant' THEN 1 END) AS hesitant, count(CASE WHEN status = 'not_interested' THEN 1 END) AS not_interested FROM disp""")
def intent_summary(t):
    return P.intent_summary(I.displayable(I.mark_superseded(t.intents, STAMP)))


PURCH = """pu AS (SELECT customer_id, 'partner' AS source, purchase_id AS payment_id, paid_at, amount FROM purchases WHERE status = 'active' AND customer_id IS NOT NULL
    UNION ALL SELECT k.customer_id, 'legacy', payment_id, paid_at, amount FROM legacy_payments l
      JOIN (SELECT DISTINCT customer_id, legacy_person_id FROM customer_links WHERE status = 'confirmed') k ON k.legacy_person_id = l.person_id),
  li AS (SELECT purchase_id AS payment_id, course_code, counts_as_seat FROM purchase_items UNION ALL SELECT payment_id, course_code, counts_as_seat FROM legacy_enrollments)"""


@query("customer_purchases", f"""WITH {PURCH} SELECT customer_id, source, pu.payment_id, paid_at, amount, count(li.payment_id) AS lines,
    count(CASE WHEN counts_as_seat THEN 1 END) AS seats FROM pu LEFT JOIN li ON li.payment_id = pu.payment_id GROUP BY 1, 2, 3, 4, 5""")
def customer_purchases(t):
    return P.customer_purchases(t).select("customer_id", "source", "payment_id", "paid_at", "amount", F.size("courses").alias("lines"),
                                          F.size(F.filter("courses", lambda c: c["counts_as_seat"])).alias("seats"))


@query("customer_profiles", f"""WITH {PURCH}, tot AS (SELECT customer_id, sum(coalesce(amount, 0)) AS total_paid, count(*) AS payment_count, min(paid_at) AS f, max(paid_at) AS l FROM pu GROUP BY 1),
    ls AS (SELECT customer_id, count(CASE WHEN counts_as_seat THEN 1 END) AS seats, string_agg(DISTINCT course_code, ',' ORDER BY course_code) AS codes
      FROM pu JOIN li ON li.payment_id = pu.payment_id GROUP BY 1),
    lk AS (SELECT customer_id, count(DISTINCT CASE WHEN status = 'confirmed' THEN legacy_person_id END) AS linked, bool_or(status IN ('auto', 'needs_review')) AS un FROM customer_links GROUP BY 1)
    SELECT c.customer_id, CASE WHEN status <> 'erased' THEN coalesce(display_name, line_display_name) END AS display_name,
      CASE WHEN status <> 'erased' THEN phone END AS phone, CASE WHEN status <> 'erased' THEN email END AS email,
      CASE WHEN status <> 'erased' THEN heard_from END AS heard_from, customer_status, status, coalesce(total_paid, 0) AS total_paid,
      coalesce(payment_count, 0) AS payment_count, coalesce(seats, 0) AS seat_count, f AS first_paid_at, l AS last_paid_at,
      coalesce(codes, '') AS course_codes, coalesce(linked, 0) AS linked_people, coalesce(un, FALSE) AS has_unconfirmed_links
    FROM customers c LEFT JOIN tot ON tot.customer_id = c.customer_id LEFT JOIN ls ON ls.customer_id = c.customer_id LEFT JOIN lk ON lk.customer_id = c.customer_id""")
def customer_profiles(t):
    return P.customer_profiles(t).withColumn("course_codes", F.concat_ws(",", "course_codes"))


@query("customer_sheet", """SELECT customer_id AS "customerId", coalesce(title, '') AS title, coalesce(display_name, '') AS "fullNameTh", nickname, coalesce(full_name_en, '') AS "fullNameEn",
    coalesce(CAST(birth_year AS STRING), '') AS "birthYear", coalesce(CAST(2569 - birth_year AS STRING), '') AS age, coalesce(phone, '') AS phone, coalesce(email, '') AS email,
    coalesce(line_display_name, '') AS "lineDisplayName", '' AS facebook, '' AS instagram, coalesce(heard_from, '') AS "heardFrom", '' AS tags,
    strftime(first_interaction_at, '%Y-%m-%d') AS "firstInteractionAt", '' AS "firstMessageAt", coalesce(strftime(form_submitted_at, '%Y-%m-%d'), '') AS "formSubmittedAt",
    CASE WHEN consent_data THEN '✓ ' ELSE '✗' END AS consent, CASE WHEN consent_marketing THEN '✓' ELSE '✗' END AS "consentMarketing", '' AS "pendingMerge",
    strftime(updated_at, '%Y-%m-%d %H:%M') AS "updatedAt" FROM customers""")
def customer_sheet(t):
    return P.customer_sheet(t.customers, 2026)


@query("sheet_write_plan", """WITH ex AS (SELECT customer_id, c_custkey + 2 AS rn FROM customers WHERE c_custkey < 100), mx AS (SELECT max(rn) AS m FROM ex)
    SELECT customer_id, rn AS row_number, 'update' AS action FROM ex
    UNION ALL SELECT customer_id, m + row_number() OVER (ORDER BY CAST(updated_at AS DATE), customer_id), 'append' FROM customers, mx WHERE c_custkey >= 100""")
def sheet_write_plan(t):
    existing = t.customers.where("c_custkey < 100").select("customer_id", (F.col("c_custkey") + 2).alias("row_number"))
    return P.sheet_write_plan(t.customers, existing)


def _pending(t):
    return t.customers.withColumn("pending_merge", F.expr("CASE WHEN c_custkey % 10 = 7 THEN 'cus_' || CAST(c_custkey - 1 AS STRING) END"))


@query("pending_merge_queue", """WITH w AS (SELECT *, 'cus_' || CAST(c_custkey - 1 AS STRING) AS cand FROM customers WHERE c_custkey % 10 = 7 AND status = 'active' ORDER BY updated_at, customer_id LIMIT 200)
    SELECT w.customer_id, cand AS candidate_id, o.status AS candidate_status, coalesce(w.phone = o.phone, FALSE) AS phone_match, coalesce(w.email = o.email, FALSE) AS email_match
    FROM w LEFT JOIN customers o ON o.customer_id = cand""")
def pending_merge_queue(t):
    return P.pending_merge_queue(_pending(t)).drop("updated_at")


@query("link_review_queue", """WITH w AS (SELECT * FROM customer_links WHERE status = 'needs_review' ORDER BY updated_at, link_id LIMIT 200),
    p AS (SELECT person_id, count(*) AS payments, sum(amount) AS paid, max(paid_at) AS last_paid_at FROM legacy_payments GROUP BY 1),
    e AS (SELECT person_id, count(CASE WHEN counts_as_seat THEN 1 END) AS seats FROM legacy_enrollments GROUP BY 1)
    SELECT link_id, customer_id, legacy_person_id AS person_id, score::DOUBLE AS score, coalesce(payments, 0) AS payments, paid, last_paid_at, coalesce(seats, 0) AS seats
    FROM w LEFT JOIN p ON p.person_id = legacy_person_id LEFT JOIN e ON e.person_id = legacy_person_id""")
def link_review_queue(t):
    return P.link_review_queue(t).drop("courses", "updated_at").withColumn("score", F.col("score").cast("double"))
