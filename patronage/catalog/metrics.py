"""Named queries for the six metrics, their metadata and the answer audit."""
from patronage.catalog import query
from patronage.functions import vocabulary as V
from patronage.plans.analytics import AnalyticsQuery, analytics_meta, run_analytics

Y = dict(start="1997-01-01", end="1997-12-31")
CUR = "BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'"
PREV = "BETWEEN DATE '1996-01-02' AND DATE '1996-12-31'"

PAY = """SELECT paid_at AS day, amount, sale_rep, synthetic, CAST(NULL AS STRING) AS person, person_id AS legacy_person
    FROM legacy_payments WHERE NOT synthetic
  UNION ALL SELECT paid_at, amount, sale_rep, synthetic,
    coalesce('cus:' || customer_id, 'pur:' || purchase_id), NULL FROM purchases WHERE status <> 'voided' AND NOT synthetic"""
SEAT = """SELECT session_start AS day, course_code, CAST(NULL AS STRING) AS person, person_id AS legacy_person
    FROM legacy_enrollments WHERE counts_as_seat AND NOT synthetic
  UNION ALL SELECT session_start, course_code, coalesce('cus:' || customer_id, 'pit:' || item_id), NULL
    FROM owned_items WHERE counts_as_seat AND NOT synthetic"""
SEAT_PLAIN = """SELECT session_start AS day, course_code FROM legacy_enrollments WHERE counts_as_seat AND NOT synthetic
  UNION ALL SELECT session_start, course_code FROM purchase_items WHERE counts_as_seat"""
LINK = """SELECT legacy_person_id, 'cus:' || customer_id AS linked FROM (SELECT *, row_number() OVER (PARTITION BY legacy_person_id
    ORDER BY CASE WHEN status = 'confirmed' THEN 0 ELSE 1 END, score DESC, customer_id) AS rn
    FROM customer_links WHERE status IN ('auto', 'confirmed')) WHERE rn = 1"""
KEYED = "coalesce(person, linked, 'lgp:' || legacy_person)"
SHARE = "floor(CAST(value AS DOUBLE) / CAST(sum(value) OVER () AS DOUBLE) * 10000 + 0.5) / 10000"
WEEK = "strftime(date_trunc('week', day), '%Y-%m-%d')"
MONTH = "strftime(day, '%Y-%m')"
DAY = "strftime(day, '%Y-%m-%d')"
NAMES = "CASE key " + " ".join(f"WHEN '{c}' THEN '{n}'" for c, n, _, _ in V.COURSES) + " ELSE key END"


def _measured(rows, key, value, label="key"):
    return f"""WITH r AS ({rows}), g AS (SELECT {key} AS key,
      sum(CASE WHEN day {CUR} THEN {value} ELSE 0 END) AS value, sum(CASE WHEN day {PREV} THEN {value} ELSE 0 END) AS before,
      count(CASE WHEN day {CUR} THEN 1 END) AS n FROM r WHERE day {CUR} OR day {PREV} GROUP BY 1)
    SELECT key, {label} AS label, value, {SHARE} AS share, value - before AS delta FROM g WHERE n > 0"""


def _register(name, sql, **params):
    query(name, sql)(lambda t: run_analytics(t, AnalyticsQuery(**{**Y, **params})))


AMOUNT = "coalesce(amount, 0)"
_register("revenue_by_month", _measured(PAY, MONTH, AMOUNT), metric="revenue", group_by="month")
_register("revenue_by_week", _measured(PAY, WEEK, AMOUNT), metric="revenue", group_by="week")
_register("revenue_by_day", _measured(PAY, DAY, AMOUNT), metric="revenue", group_by="day")
_register("revenue_by_sale_rep", _measured(PAY, f"coalesce(sale_rep, '{V.LABEL_NO_REP}')", AMOUNT), metric="revenue", group_by="saleRep")
_register("revenue_by_course_refused", _measured(PAY, f"'{V.LABEL_TOTAL}'", AMOUNT, NAMES), metric="revenue", group_by="course")
_register("revenue_total", f"""WITH r AS ({PAY}) SELECT '{V.LABEL_TOTAL}' AS key, '{V.LABEL_TOTAL}' AS label,
    sum(coalesce(amount, 0)) AS value, CAST(1 AS DOUBLE) AS share FROM r WHERE day {CUR}""", metric="revenue")
_register("revenue_partner_all_synthetic", f"""SELECT '{V.LABEL_TOTAL}' AS key, '{V.LABEL_TOTAL}' AS label,
    sum(coalesce(amount, 0)) AS value, CAST(1 AS DOUBLE) AS share FROM purchases WHERE status <> 'voided' AND paid_at {CUR}""",
          metric="revenue", sources=("partner",), include_synthetic=True)
_register("revenue_compat_range", f"""WITH r AS ({PAY}) SELECT '{V.LABEL_TOTAL}' AS key, '{V.LABEL_TOTAL}' AS label,
    sum(coalesce(amount, 0)) AS value, CAST(1 AS DOUBLE) AS share FROM r
    WHERE day BETWEEN DATE '1996-12-31' AND DATE '1997-12-31'""", metric="revenue", compat=True)
_register("seats_by_course", _measured(SEAT_PLAIN, "course_code", "1", NAMES), metric="seats", group_by="course")
_register("seats_by_month", _measured(SEAT_PLAIN, MONTH, "1"), metric="seats", group_by="month")
_register("seats_selected_courses", f"""WITH r AS ({SEAT_PLAIN}) SELECT '{V.LABEL_TOTAL}' AS key, '{V.LABEL_TOTAL}' AS label,
    count(*) AS value, CAST(1 AS DOUBLE) AS share FROM r WHERE day {CUR} AND course_code IN ('INNER', 'TTRT')""",
          metric="seats", course_codes=("INNER", "TTRT"))
_register("people_total", f"""WITH s AS ({SEAT}), p AS ({PAY}), l AS ({LINK}),
    u AS (SELECT person, legacy_person FROM s WHERE day {CUR} UNION ALL SELECT person, legacy_person FROM p WHERE day {CUR})
    SELECT '{V.LABEL_TOTAL}' AS key, '{V.LABEL_TOTAL}' AS label, count(DISTINCT {KEYED}) AS value, CAST(1 AS DOUBLE) AS share
    FROM u LEFT JOIN l ON u.legacy_person = l.legacy_person_id""", metric="people")
_register("people_by_course", f"""WITH s AS ({SEAT}), l AS ({LINK}), g AS (SELECT course_code AS key, count(DISTINCT {KEYED}) AS value
    FROM s LEFT JOIN l ON s.legacy_person = l.legacy_person_id WHERE day {CUR} GROUP BY 1)
    SELECT key, {NAMES} AS label, value, {SHARE} AS share FROM g""", metric="people", group_by="course")
_register("people_by_month", f"""WITH s AS ({SEAT}), l AS ({LINK}), g AS (SELECT {MONTH} AS key, count(DISTINCT {KEYED}) AS value
    FROM s LEFT JOIN l ON s.legacy_person = l.legacy_person_id WHERE day {CUR} GROUP BY 1)
    SELECT key, key AS label, value, {SHARE} AS share FROM g""", metric="people", group_by="month")
_register("new_vs_returning", f"""WITH p AS ({PAY}), l AS ({LINK}), k AS (SELECT {KEYED} AS person_key, min(day) AS f, max(day) AS m
      FROM p LEFT JOIN l ON p.legacy_person = l.legacy_person_id WHERE day <= DATE '1997-12-31' GROUP BY 1),
    g AS (SELECT CASE WHEN f < DATE '1997-01-01' THEN 'returning' ELSE 'new' END AS key, count(*) AS value
      FROM k WHERE m >= DATE '1997-01-01' GROUP BY 1)
    SELECT key, CASE key WHEN 'new' THEN '{V.LABEL_NEW}' ELSE '{V.LABEL_RETURNING}' END AS label, value, {SHARE} AS share FROM g""",
          metric="new_vs_returning")
_register("channel_mix_heard_from", f"""WITH g AS (SELECT coalesce(heard_from, '{V.LABEL_NO_CHANNEL}') AS key, count(*) AS value
    FROM customers WHERE status = 'active' GROUP BY 1) SELECT key, key AS label, value, {SHARE} AS share FROM g""", metric="channel_mix")
_register("channel_mix_ad_or_organic", f"""WITH g AS (SELECT CASE WHEN lead_pending IS NULL THEN '{V.LABEL_NOT_AD}'
      WHEN lead_pending THEN '{V.LABEL_AD_PENDING}' ELSE lead_ad_or_organic END AS key, count(*) AS value
    FROM customers WHERE status = 'active' GROUP BY 1) SELECT key, key AS label, value, {SHARE} AS share FROM g""",
          metric="channel_mix", group_by="adOrOrganic")
_register("intent_funnel", f"""WITH g AS (SELECT status || coalesce('/' || hesitation_reason, '') AS key, count(*) AS value FROM intents
    WHERE voided_at IS NULL AND NOT below_threshold AND confidence >= 0.6 GROUP BY 1)
    SELECT key, key AS label, value, {SHARE} AS share FROM g""", metric="intent_funnel")
_register("intent_funnel_budget_inner", f"""WITH g AS (SELECT status || coalesce('/' || hesitation_reason, '') AS key, count(*) AS value
    FROM intents WHERE voided_at IS NULL AND NOT below_threshold AND confidence >= 0.1 AND course_code = 'INNER'
      AND hesitation_reason = 'budget' GROUP BY 1)
    SELECT key, key AS label, value, {SHARE} AS share FROM g""",
          metric="intent_funnel", min_confidence=0.1, course_codes=("INNER",), hesitation_reason="budget")


@query("analytics_meta_revenue", f"""WITH r AS ({PAY}) SELECT 'revenue' AS metric, '1997-01-01' AS "from", '1997-12-31' AS "to",
    'Asia/Bangkok' AS timezone, 'legacy,partner' AS sources_used, count(*) AS rows_scanned, bool_or(synthetic) AS contains_synthetic,
    FALSE AS is_estimate, CASE WHEN bool_or(amount IS NULL) THEN 'null_amounts_not_counted,' ELSE '' END || 'synthetic_excluded' AS warnings
    FROM r WHERE day {CUR}""")
def _meta(t):
    from pyspark.sql import functions as F
    m = analytics_meta(t, AnalyticsQuery("revenue", **Y))
    return m.withColumns({c: F.concat_ws(",", c) for c in ("sources_used", "warnings")})


@query("analytics_meta_intents", """SELECT 'intent_funnel' AS metric, '1997-01-01' AS "from", '1997-12-31' AS "to",
    'Asia/Bangkok' AS timezone, 'legacy,partner' AS sources_used, count(*) AS rows_scanned, FALSE AS contains_synthetic,
    TRUE AS is_estimate, 'estimate_confidence_ge_0.6:' || string_agg(DISTINCT model, ',' ORDER BY model) || ',synthetic_excluded' AS warnings
    FROM intents WHERE voided_at IS NULL AND NOT below_threshold AND confidence >= 0.6""")
def _meta_intents(t):
    from pyspark.sql import functions as F
    m = analytics_meta(t, AnalyticsQuery("intent_funnel", **Y))
    return m.withColumns({c: F.concat_ws(",", c) for c in ("sources_used", "warnings")})
