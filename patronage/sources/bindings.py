"""CRM tables derived from the generic star-schema test tables.

Each view is one plain SELECT that Spark and other ANSI engines read alike, so the same text feeds
the library and its checks. ``{name}`` refers to a base table or to another view.
"""
import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region nation customer supplier part orders lineitem events documents embeddings pages "
        "benchmark labels conversations").split()

_COURSE = ("CASE {0} % 7 WHEN 0 THEN 'INNER' WHEN 1 THEN 'COMMU' WHEN 2 THEN 'PRESENT' WHEN 3 THEN 'TTRT' "
           "WHEN 4 THEN 'DEEPIN' WHEN 5 THEN 'INNERCAMP' ELSE 'OTHER' END")
_KIND = "CASE l_returnflag WHEN 'N' THEN 'enrolled' WHEN 'A' THEN 'relearn' ELSE 'refund' END"
_STR = "CAST({0} AS STRING)"
_DAY = "CAST(DATE '2024-01-01' + CAST({0} AS INT) AS TIMESTAMP)"


def _person(k: str, prefix: str) -> str:
    """Name columns: two thirds get one of 97 first names, one third shares a single hot one."""
    return f"""
      CASE WHEN {k} % 3 = 0 THEN 'นาย Somchai' ELSE 'Given' || CAST({k} % 97 AS STRING) END
        || ' Fam' || CAST({k} % 53 AS STRING) AS {prefix}display_name,
      'Nick' || CAST({k} % 41 AS STRING) AS nickname"""


VIEWS = {
    "customers": f"""
      SELECT 'cus_' || CAST(c_custkey AS STRING) AS customer_id, c_custkey,
        CASE c_custkey % 20 WHEN 0 THEN 'merged' WHEN 1 THEN 'erased' ELSE 'active' END AS status,
        CASE WHEN c_custkey % 20 = 0 THEN 'cus_' || CAST(
          CASE WHEN c_custkey % 100 = 80 THEN c_custkey + 2 ELSE c_custkey + 20 END AS STRING) END AS merged_into,
        CASE WHEN c_custkey % 4 = 0 THEN 'Mr.' END AS title,
        {_person('c_custkey', '')},
        CASE WHEN c_custkey % 7 <> 0 THEN 'chat ' || CAST(c_custkey AS STRING) END AS line_display_name,
        CASE WHEN c_custkey % 2 = 0 THEN 'Given' || CAST(c_custkey % 97 AS STRING) || ' En' || CAST(c_custkey % 31 AS STRING)
          END AS full_name_en,
        CASE WHEN c_custkey % 6 <> 5 THEN '+668' || lpad(CAST(
          CASE WHEN c_custkey % 10 = 7 THEN c_custkey - 1 ELSE c_custkey END AS STRING), 8, '0') END AS phone,
        CASE WHEN c_custkey % 5 <> 4 THEN 'user' || CAST(
          CASE WHEN c_custkey % 10 = 3 THEN c_custkey - 1 ELSE c_custkey END AS STRING)
          || CASE c_custkey % 3 WHEN 0 THEN '@example.com' WHEN 1 THEN '@mail.example.org' ELSE '@shop.example.net' END
          END AS email,
        CASE WHEN c_custkey % 8 <> 7 THEN CAST(2490 + c_nationkey * 2 AS INT) END AS birth_year,
        CASE WHEN c_custkey % 9 <> 8 THEN c_mktsegment END AS heard_from,
        CASE WHEN c_custkey % 4 = 1 THEN 'facebook_lead' ELSE 'line' END AS source_channel,
        CASE c_custkey % 3 WHEN 0 THEN 'lead' WHEN 1 THEN 'customer' ELSE 'inactive' END AS customer_status,
        c_custkey % 3 <> 0 AS consent_data, c_custkey % 3 <> 0 AS consent_marketing,
        CASE WHEN c_custkey % 4 = 1 THEN 'page_' || CAST(c_custkey % 3 AS STRING) END AS lead_page_id,
        CASE WHEN c_custkey % 4 = 1 THEN 'form_' || CAST(c_custkey % 17 AS STRING) END AS lead_form_id,
        CASE WHEN c_custkey % 4 = 1 AND c_custkey % 12 <> 9 THEN 'ad_' || CAST(c_custkey % 29 AS STRING) END AS lead_ad_id,
        CASE WHEN c_custkey % 4 = 1 THEN CASE c_custkey % 5 WHEN 0 THEN 'ad' WHEN 1 THEN 'organic' ELSE 'unknown' END
          END AS lead_ad_or_organic,
        CASE WHEN c_custkey % 4 = 1 THEN c_custkey % 8 = 1 END AS lead_pending,
        c_custkey % 6 = 2 AS sheet_dirty, c_custkey % 5 = 2 AS ai_dirty, CAST(c_custkey % 7 AS INT) AS sync_attempts,
        {_DAY.format('c_custkey % 300')} AS first_interaction_at,
        CASE WHEN c_custkey % 3 = 1 THEN {_DAY.format('c_custkey % 300 + 3')} END AS form_submitted_at,
        {_DAY.format('c_custkey % 300')} AS created_at,
        {_DAY.format('c_custkey % 300 + 40')} AS updated_at
      FROM {{customer}}""",
    "legacy_people": f"""
      SELECT 'lgp_' || CAST(c_custkey AS STRING) AS person_id,
        {_person('c_custkey', '')},
        CASE WHEN c_custkey % 2 = 0 THEN 'Given' || CAST(c_custkey % 97 AS STRING) || ' Old' || CAST(c_custkey % 31 AS STRING)
          END AS full_name_en,
        CASE WHEN c_custkey % 4 <> 3 THEN '+668' || lpad(CAST(
          CASE WHEN c_custkey % 3 = 0 THEN c_custkey ELSE 5000000 + c_custkey END AS STRING), 8, '0') END AS phone,
        CASE WHEN c_custkey % 3 = 1 THEN 'user' || CAST(c_custkey AS STRING) || '@mail.example.org'
          WHEN c_custkey % 3 = 2 THEN 'old' || CAST(c_custkey AS STRING) || '@example.com' END AS email,
        CAST(15 + c_nationkey * 3 AS INT) AS age_at_import,
        c_custkey % 10 = 3 AS synthetic,
        {_DAY.format('c_custkey % 200')} AS updated_at
      FROM {{customer}}""",
    "purchases": """
      SELECT 'pur_' || CAST(o_orderkey AS STRING) AS purchase_id, 'partner-a' AS partner_id,
        CASE WHEN o_orderkey % 50 <> 1 THEN 'cus_' || CAST(o_custkey AS STRING) END AS customer_id,
        CASE WHEN o_orderkey % 97 <> 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) END AS amount,
        CASE WHEN o_orderkey % 101 <> 0 THEN CAST(o_orderdate AS DATE) END AS paid_at,
        CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END AS sale_rep,
        CASE WHEN o_orderstatus = 'F' THEN 'voided' ELSE 'active' END AS status,
        'slip ' || CAST(o_orderkey % 4000 AS STRING) AS external_payment_id,
        o_orderkey % 10 = 3 AS synthetic, o_orderkey % 9 = 1 AS ai_dirty,
        CAST(o_orderdate AS TIMESTAMP) AS created_at, CAST(o_orderdate AS TIMESTAMP) AS updated_at
      FROM {orders} WHERE o_orderkey % 2 = 1""",
    "purchase_items": f"""
      SELECT 'pit_' || CAST(l_orderkey AS STRING) || '_' || CAST(l_linenumber AS STRING) || '_' || CAST(l_partkey AS STRING) AS item_id,
        'pur_' || CAST(l_orderkey AS STRING) AS purchase_id,
        {_COURSE.format('l_partkey')} AS course_code, {_KIND} AS kind, l_returnflag = 'N' AS counts_as_seat,
        CAST(l_shipdate AS DATE) AS session_start, CAST(NULL AS STRING) AS session_label
      FROM {{lineitem}} WHERE l_orderkey % 2 = 1""",
    "owned_items": """
      SELECT i.*, p.customer_id, p.synthetic FROM {purchase_items} i JOIN {purchases} p ON i.purchase_id = p.purchase_id""",
    "legacy_payments": """
      SELECT 'lpy_' || CAST(o_orderkey AS STRING) AS payment_id, 'lgp_' || CAST(o_custkey AS STRING) AS person_id,
        CASE WHEN o_orderkey % 97 <> 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) END AS amount,
        CASE WHEN o_orderkey % 101 <> 0 THEN CAST(o_orderdate AS DATE) END AS paid_at,
        CAST(extract(YEAR FROM o_orderdate) AS INT) AS year,
        CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END AS sale_rep,
        CASE WHEN o_orderkey % 8 <> 0 THEN 'IN-' || lpad(CAST(o_orderkey % 9000 AS STRING), 4, '0') END AS slip_no,
        o_orderkey % 10 = 4 AS synthetic, CAST(o_orderdate AS TIMESTAMP) AS updated_at
      FROM {orders} WHERE o_orderkey % 2 = 0""",
    "legacy_enrollments": f"""
      SELECT 'len_' || CAST(l_orderkey AS STRING) || '_' || CAST(l_linenumber AS STRING) || '_' || CAST(l_partkey AS STRING) AS enrollment_id,
        'lpy_' || CAST(l_orderkey AS STRING) AS payment_id, 'lgp_' || CAST(o_custkey AS STRING) AS person_id,
        {_COURSE.format('l_partkey')} AS course_code, {_KIND} AS kind, l_returnflag = 'N' AS counts_as_seat,
        CAST(l_shipdate AS DATE) AS session_start, l_orderkey % 10 = 4 AS synthetic,
        CASE l_linenumber % 3 WHEN 0 THEN 'เลื่อน 27-28 Jun' WHEN 1 THEN '17-18 Jan' ELSE 'สมชาย ใจดี' END AS session_label
      FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey WHERE l_orderkey % 2 = 0""",
    "customer_links": """
      SELECT 'lnk_a' || CAST(c_custkey AS STRING) AS link_id, 'cus_' || CAST(c_custkey AS STRING) AS customer_id,
        'lgp_' || CAST(c_custkey AS STRING) AS legacy_person_id,
        CASE c_custkey % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'auto' WHEN 2 THEN 'needs_review' ELSE 'rejected' END AS status,
        CASE WHEN c_custkey % 4 IN (0, 3) THEN 'staff' ELSE 'rule' END AS decided_by,
        CASE c_custkey % 2 WHEN 0 THEN 'phone_hash' ELSE 'llm_features' END AS method,
        CASE WHEN c_custkey % 4 = 1 THEN 0.95 ELSE 0.6 END AS score, c_custkey % 3 AS competing_candidates,
        """ + _DAY.format('c_custkey % 100') + """ AS updated_at
      FROM {customer}
      UNION ALL
      SELECT 'lnk_b' || CAST(c_custkey AS STRING), 'cus_' || CAST(c_custkey AS STRING), 'lgp_' || CAST(c_custkey - 1 AS STRING),
        CASE WHEN c_custkey % 10 = 0 THEN 'confirmed' ELSE 'auto' END, 'llm', 'llm_features', 0.7, 0,
        """ + _DAY.format('c_custkey % 100') + """
      FROM {customer} WHERE c_custkey % 5 = 0 AND c_custkey > 0""",
    "intents": """
      SELECT 'int_' || CAST(event_id AS STRING) AS intent_id, event_id,
        CASE WHEN event_id % 37 <> 0 THEN 'cus_' || CAST(user_id AS STRING) END AS customer_id,
        CASE CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 7 WHEN 0 THEN 'INNER' WHEN 1 THEN 'COMMU'
          WHEN 2 THEN 'PRESENT' WHEN 3 THEN 'TTRT' WHEN 4 THEN 'DEEPIN' WHEN 5 THEN 'INNERCAMP' END AS course_code,
        CASE event_type WHEN 'click' THEN 'interested' WHEN 'view' THEN 'hesitant' WHEN 'error' THEN 'not_interested'
          WHEN 'purchase' THEN 'hesitant' ELSE 'unknown' END AS status,
        CASE WHEN event_type IN ('view', 'purchase') THEN CASE event_id % 6 WHEN 0 THEN 'budget' WHEN 1 THEN 'not_needed'
          WHEN 2 THEN 'timing_conflict' WHEN 3 THEN 'not_ready' WHEN 4 THEN 'needs_approval' END END AS hesitation_reason,
        least(value / 500, 1.0) AS confidence,
        CASE WHEN event_id % 5 = 0 THEN 'staff' ELSE 'ai' END AS source,
        CASE WHEN event_id % 5 = 0 AND event_id % 15 = 0 THEN 'sticky' ELSE 'soft' END AS lock_kind,
        CASE WHEN event_id % 5 <> 0 THEN 'model-' || CAST(event_id % 3 AS STRING) END AS model,
        event_id % 5 <> 0 AND value / 500 < 0.6 AS below_threshold,
        CAST(ts AS TIMESTAMP) AS observed_at, CAST(ts AS TIMESTAMP) AS created_at,
        CASE WHEN event_type = 'purchase' THEN CAST(ts AS TIMESTAMP) END AS voided_at,
        event_id % 11 = 1 AS ai_dirty, CAST(event_id % 7 AS INT) AS sync_attempts, CAST(ts AS TIMESTAMP) AS updated_at
      FROM {events}""",
    "inbound": """
      SELECT 'evt_' || CAST(CASE WHEN event_id % 25 = 24 THEN event_id - 1 ELSE event_id END AS STRING) AS event_id, event_id AS seq,
        CASE WHEN event_id % 4 = 0 THEN 'facebook' ELSE 'line' END AS provider,
        CASE WHEN event_id % 31 <> 0 THEN 'chan_' || CAST(event_id % 3 AS STRING) END AS channel_id,
        CASE WHEN event_id % 29 <> 0 THEN 'U' || CAST(user_id AS STRING) END AS line_user_id,
        CASE event_type WHEN 'signup' THEN 'follow' WHEN 'error' THEN 'unfollow' WHEN 'purchase' THEN 'postback' ELSE 'message' END AS event_type,
        CASE event_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'done' WHEN 3 THEN 'failed' ELSE 'dead' END AS status,
        CAST(event_id % 6 AS INT) AS attempts, CAST(ts AS TIMESTAMP) AS occurred_at, CAST(ts AS TIMESTAMP) AS received_at
      FROM {events}""",
    "posts": f"""
      SELECT 'post_' || CAST(page_id AS STRING) AS post_id, page_id,
        'Round ' || CAST(page_id AS STRING) || CASE page_id % 6 WHEN 0 THEN ' #Inner #inner_makeover' WHEN 1 THEN ' #Communication now'
          WHEN 2 THEN ' #TTRT #Presentation' WHEN 3 THEN ' plain text' WHEN 4 THEN ' #DeepIn #promo' ELSE ' #การนำเสนอ #innercamp' END
          || chr(10) || 'second line' AS message,
        {_DAY.format('page_id % 366')} AS created_time, url AS permalink,
        CAST(length(html) % 500 AS BIGINT) AS reactions, CAST(length(url) % 40 AS BIGINT) AS comments,
        CAST(page_id % 23 AS BIGINT) AS shares, CAST(length(html) AS BIGINT) AS reach,
        'ad_' || CAST(page_id % 37 AS STRING) AS ad_id, page_id % 10 = 3 AS synthetic
      FROM {{pages}}""",
}
VIEWS["lead_mappings"] = """
      SELECT DISTINCT CASE c_custkey % 3 WHEN 0 THEN 'adId' WHEN 1 THEN 'formId' ELSE 'pageId' END AS match_on,
        CASE c_custkey % 3 WHEN 0 THEN 'ad_' || CAST(c_custkey % 15 AS STRING) WHEN 1 THEN 'form_' || CAST(c_custkey % 9 AS STRING)
          ELSE 'page_' || CAST(c_custkey % 2 AS STRING) END AS match_value,
        CASE CASE c_custkey % 3 WHEN 0 THEN c_custkey % 15 WHEN 1 THEN c_custkey % 9 ELSE c_custkey % 2 END % 4
          WHEN 0 THEN 'INNER' WHEN 1 THEN 'COMMU' WHEN 2 THEN 'NOPE' END AS course_code,
        'camp ' || CAST(c_custkey % 3 AS STRING) AS campaign_name,
        CASE c_custkey % 3 WHEN 0 THEN 'ad' ELSE 'unknown' END AS ad_or_organic
      FROM {customer}"""


# Sample course cells of every kind, one per order key modulo their number.
CELLS = ["4-5 May", "RL 6-7 Sep", "Free 21-22 Feb", "wait list", "คืนเงิน", "9-10 Nov 26", "Dec", "", "22-23 Apr ย้ายเรียน PS",
         "2027.0", "เพิ่ม IN-7001-00042", "30 Feb", "28,29 Mar-1 Apr", "19-20 Jul คุณมานี รักเรียน เรียนแทน", "14-15 Aug D-1"]
VIEWS["sheet_flat"] = f"""
      SELECT 'Inner' || CASE WHEN o_orderkey % 2 = 0 THEN '2025' ELSE '2026' END AS sheet, CAST(o_orderkey + 2 AS BIGINT) AS row_number,
        CASE WHEN o_orderkey % 11 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) END AS paid_text,
        CASE WHEN o_orderkey % 13 <> 0 THEN ' ' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) ELSE 'free' END AS amount_text,
        CASE WHEN o_orderkey % 11 <> 0 THEN 'IN-' || CAST(o_orderkey % 5000 AS STRING) END AS slip_text,
        CASE WHEN o_orderkey % 19 <> 0 THEN 'Name  ' || CAST(o_custkey AS STRING) END AS name_text,
        CASE WHEN o_custkey % 3 = 0 THEN '08' || lpad(CAST(o_custkey AS STRING), 8, '0') END AS phone_text,
        CASE WHEN o_custkey % 3 <> 2 THEN 'User' || CAST(o_custkey AS STRING) || '@Example.com' END AS email_text,
        CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 130 AS STRING) END AS age_text, o_orderpriority AS rep_text,
        CASE CAST(o_orderkey % {len(CELLS)} AS INT) {" ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CELLS))} END AS inner_cell,
        CASE WHEN o_orderkey % 7 = 0 THEN '1-2 Feb' END AS pro_cell
      FROM {{orders}}"""


VIEWS["identities"] = """
      SELECT 'idn_' || CAST(c_custkey AS STRING) AS identity_id, 'line' AS provider, 'chan_0' AS channel_id, 'U' || CAST(c_custkey AS STRING) AS external_id,
        'cus_' || CAST(c_custkey AS STRING) AS customer_id, c_custkey % 3 <> 0 AS verified, CAST(DATE '2024-02-01' AS TIMESTAMP) AS linked_at
      FROM {customer} WHERE c_custkey % 8 = 0 OR c_custkey % 5 = 0
      UNION ALL SELECT 'idl_' || CAST(c_custkey AS STRING), 'line_login', 'login', 'U' || CAST(c_custkey AS STRING), 'cus_' || CAST(c_custkey + 2 AS STRING), TRUE,
        CAST(CASE WHEN c_custkey % 48 = 0 THEN DATE '2024-01-01' ELSE DATE '2024-03-01' END AS TIMESTAMP)
      FROM {customer} WHERE c_custkey % 16 = 0"""
VIEWS["partner_feed"] = """
      SELECT o_orderkey AS k, o_custkey AS c, CASE WHEN o_orderkey % 10 = 7 THEN o_orderkey - 1 ELSE o_orderkey END AS e,
        CASE WHEN o_orderkey % 20 = 7 THEN 2 ELSE 1 END AS revision,
        CASE WHEN o_orderkey % 15 = 0 THEN 'purchase.void' WHEN o_orderkey % 13 = 0 THEN 'tag' WHEN o_orderkey % 29 = 0 THEN 'refund' ELSE 'purchase' END AS type,
        CASE WHEN o_orderkey % 40 <> 27 AND o_custkey % 4 = 0 THEN 'U' || CAST(o_custkey AS STRING) END AS line_user_id,
        CASE WHEN o_orderkey % 40 <> 27 AND o_custkey % 6 <> 5 THEN '08' || lpad(CAST(CASE WHEN o_custkey % 10 = 7 THEN o_custkey - 1 ELSE o_custkey END AS STRING), 8, '0') END AS phone,
        CASE WHEN o_orderkey % 40 <> 27 AND o_custkey % 2 = 0 AND o_custkey % 5 <> 4 THEN 'user' || CAST(CASE WHEN o_custkey % 10 = 3 THEN o_custkey - 1 ELSE o_custkey END AS STRING)
          || CASE o_custkey % 3 WHEN 0 THEN '@example.com' WHEN 1 THEN '@mail.example.org' ELSE '@shop.example.net' END END AS email,
        CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) AS amount_text, CAST(CAST(o_orderdate AS DATE) AS STRING) AS paid_text
      FROM {orders}"""
VIEWS["partner_raw"] = """
      SELECT 'partner-a' AS partner_id, k AS seq, '{"eventId":"ord-' || CAST(e AS STRING) || '","type":"' || type || '","occurredAt":"2024-01-05T10:00:00'
        || CASE WHEN k % 19 = 0 THEN '' ELSE '+07:00' END || '","revision":' || CAST(revision AS STRING)
        || CASE WHEN type = 'purchase.void' THEN ',"voids":"ord-' || CAST(k - 1 AS STRING) || '"' ELSE
          ',"subject":{"fullName":"Someone"' || CASE WHEN line_user_id IS NOT NULL THEN ',"lineUserId":"' || line_user_id || '"' ELSE '' END
          || CASE WHEN phone IS NOT NULL THEN ',"phone":"' || phone || '"' ELSE '' END || CASE WHEN email IS NOT NULL THEN ',"email":"' || email || '"' ELSE '' END
          || '},"payment":{"externalPaymentId":"slip ' || CAST(k AS STRING) || '","amount":' || amount_text || ',"currency":"THB","paidAt":"' || paid_text
          || '","lines":[{"courseLabel":"' || CASE WHEN k % 37 = 0 THEN 'commu' ELSE 'Inner' END || '","courseCode":"' || CASE WHEN k % 17 = 0 THEN 'NOPE' ELSE 'INNER' END
          || '","kind":"' || CASE WHEN k % 31 = 0 THEN 'bogus' WHEN k % 3 = 0 THEN 'relearn' ELSE 'enrolled' END
          || '","countsAsSeat":true},{"courseLabel":"หนังสือ","kind":"enrolled"}]}' END
        || CASE WHEN k % 23 = 0 THEN ',"summary":"x"' ELSE '' END || '}' AS raw
      FROM {partner_feed}"""


VIEWS["opinion_feed"] = """
      SELECT o_orderkey AS k, 'U' || CAST(o_custkey % 200 AS STRING) AS line_user_id,
        CASE WHEN o_orderkey % 97 = 0 THEN 'erase' WHEN o_orderkey % 7 = 3 THEN 'intent.void' ELSE 'intent' END AS type,
        CASE o_orderkey % 3 WHEN 0 THEN 'INNER' WHEN 1 THEN 'COMMU' END AS course, CASE WHEN o_orderkey % 5 < 2 THEN 'staff' ELSE 'ai' END AS source,
        CASE WHEN o_orderkey % 20 < 2 THEN 'sticky' ELSE 'soft' END AS lock_kind, CASE o_orderkey % 5 WHEN 2 THEN '0.7' WHEN 3 THEN '0.8' ELSE '0.9' END AS confidence,
        DATE '2024-01-01' + CAST(o_orderkey * 7919 % 300 AS INT) AS observed
      FROM {orders}"""
VIEWS["opinion_raw"] = """
      SELECT 'partner-a' AS partner_id, k AS seq, '{"eventId":"opn-' || CAST(k AS STRING) || '","type":"' || type || '","occurredAt":"' || CAST(observed AS STRING) || 'T10:00:00Z"'
        || CASE WHEN type = 'intent.void' THEN ',"voids":"opn-' || CAST(k - 1 AS STRING) || '"' ELSE ',"subject":{"lineUserId":"' || line_user_id || '"}' END
        || CASE type WHEN 'erase' THEN ',"erase":{"reason":"customer_request","requestedAt":"2024-01-05T10:00:00Z"}' WHEN 'intent' THEN
          ',"intent":{' || CASE WHEN course IS NOT NULL THEN '"courseCode":"' || course || '",' ELSE '' END || '"status":"interested","confidence":' || confidence || ',"source":"' || source || '"'
          || CASE WHEN source = 'staff' THEN ',"lock":"' || lock_kind || '"' ELSE ',"model":"m1"' END || '}' ELSE '' END || '}' AS raw
      FROM {opinion_feed}"""
VIEWS["webhook_raw"] = """
      SELECT event_id AS seq, CAST(ts AS TIMESTAMP) AS received_at, '{"destination":"chan_0","events":[{' || CASE WHEN event_id % 7 <> 0 THEN '"webhookEventId":"w' || CAST(event_id AS STRING) || '",' ELSE '' END
        || '"type":"message","timestamp":' || CAST(1700000000000 + event_id * 1000 AS STRING) || ',"source":{"type":"' || CASE WHEN event_id % 9 = 0 THEN 'group' ELSE 'user' END
        || '","userId":"U' || CAST(user_id AS STRING) || '"},"message":{"id":"m' || CAST(event_id AS STRING) || '","type":"text","text":"secret words"}},{"type":"follow","timestamp":'
        || CAST(1700000000000 + event_id * 1000 AS STRING) || ',"source":{"type":"user","userId":"U' || CAST(user_id AS STRING) || '"}}]}' AS raw
      FROM {events}"""
VIEWS["lead_feed"] = """
      SELECT c_custkey AS k, 'lead_' || CAST(c_custkey AS STRING) AS leadgen_id, CASE WHEN c_custkey % 5 <> 0 THEN 'page_' || CAST(c_custkey % 3 AS STRING) END AS page_id,
        'page_9' AS entry_id, 'form_' || CAST(c_custkey % 17 AS STRING) AS form_id, CASE WHEN c_custkey % 3 <> 0 THEN 'ad_' || CAST(c_custkey % 29 AS STRING) END AS ad_id,
        CASE WHEN c_custkey % 11 = 0 THEN 'feed' ELSE 'leadgen' END AS kind,
        CASE WHEN c_custkey % 2 = 0 THEN 'Lead  ' || CAST(c_custkey AS STRING) END AS full_name, 'First' || CAST(c_custkey AS STRING) AS first_name,
        CASE WHEN c_custkey % 4 <> 3 THEN '08' || lpad(CAST(c_custkey + 3 AS STRING), 8, '0') END AS phone_text, 'user' || CAST(c_custkey AS STRING) || '@Example.com' AS email_text,
        CASE c_custkey % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' END AS agree
      FROM {customer} WHERE c_custkey % 13 <> 0"""
VIEWS["lead_raw"] = """
      SELECT k, '{"object":"page","entry":[{"id":"' || entry_id || '","changes":[{"field":"' || kind || '","value":{"leadgen_id":"' || leadgen_id || '"'
        || CASE WHEN page_id IS NOT NULL THEN ',"page_id":"' || page_id || '"' ELSE '' END || ',"form_id":"' || form_id || '"'
        || CASE WHEN ad_id IS NOT NULL THEN ',"ad_id":"' || ad_id || '"' ELSE '' END || ',"created_time":' || CAST(1700000000 + k AS STRING) || '}}]}]}' AS raw
      FROM {lead_feed}"""
VIEWS["post_raw"] = """
      SELECT page_id, '{' || CASE WHEN page_id % 17 <> 0 THEN '"id":" post_' || CAST(page_id AS STRING) || '",' ELSE '' END || '"message":"Round ' || CAST(page_id AS STRING)
        || CASE page_id % 6 WHEN 0 THEN ' #Inner #inner_makeover' WHEN 1 THEN ' #Communication now' WHEN 2 THEN ' #TTRT #Presentation' WHEN 3 THEN ' plain text' WHEN 4 THEN ' #DeepIn #promo' ELSE ' #ｉｎｎｅｒｃａｍｐ' END
        || '","created_time":"' || CASE WHEN page_id % 19 = 0 THEN 'soon' ELSE CAST(DATE '2024-01-01' + CAST(page_id % 366 AS INT) AS STRING) || 'T20:30:00+0000' END
        || '","permalink_url":"' || url || '","reactions":{"summary":{"total_count":' || CAST(length(html) % 500 - 50 AS STRING) || '}},"shares":{"count":' || CAST(page_id % 23 AS STRING) || '}}' AS post_json,
        CASE WHEN page_id % 4 = 0 THEN '{"data":[{"name":"other","values":[{"value":1}]},{"name":"post_impressions_unique","values":[{"value":5},{"value":' || CAST(page_id AS STRING) || '}]}]}' END AS insight_json,
        'ad_' || CAST(page_id % 37 AS STRING) AS ad_id
      FROM {pages}"""
VIEWS["submissions"] = """
      SELECT 'sub_' || CAST(event_id AS STRING) AS submission_id, event_id, 'cus_' || CAST(user_id AS STRING) AS customer_id, CAST(ts AS TIMESTAMP) AS at,
        'key_' || CAST(CASE WHEN event_id % 12 = 5 THEN event_id - 1 ELSE event_id END AS STRING) AS idempotency_key, 'form-a' AS form_id, CAST(event_id % 4 AS INT) AS version,
        '{"fullNameTh":"' || CASE WHEN event_id % 5 = 0 THEN ' ' ELSE ' Name ' || CAST(event_id AS STRING) END || '"'
        || CASE WHEN event_id % 3 <> 0 THEN ',"phone":"08' || CASE WHEN event_id % 7 = 0 THEN '1' ELSE lpad(CAST(event_id AS STRING), 8, '0') END || '"' ELSE '' END
        || CASE WHEN event_id % 4 = 0 THEN ',"nickname":"x"' WHEN event_id % 4 = 1 THEN ',"nickname":"nick"' ELSE '' END
        || ',"heardFrom":"' || CASE event_id % 3 WHEN 0 THEN 'friend' WHEN 1 THEN 'ad' ELSE 'radio' END || '","interests":' || CASE event_id % 4 WHEN 0 THEN '[]' WHEN 1 THEN '["a"]' WHEN 2 THEN '["a","z"]' ELSE '["a","b","c"]' END
        || ',"birthYear":"' || CASE WHEN event_id % 2 = 0 THEN '1992' ELSE '2535' END || '","consentDataProcessing":' || CASE WHEN event_id % 6 = 0 THEN 'false' ELSE 'true' END
        || CASE WHEN event_id % 8 = 0 THEN ',"isAdmin":true' ELSE '' END || '}' AS answers
      FROM {events}"""


class Tables:
    """Base tables and CRM views of one folder as lazily built DataFrames: ``t.customers``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._made = spark, folder, {}
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in VIEWS and name not in BASE):
            raise AttributeError(name)
        if name not in self._made:
            if name in BASE:
                self._made[name] = self._base(name)
            else:
                uses = {u: getattr(self, u) for u in re.findall(r"\{(\w+)\}", VIEWS[name])}
                text = re.sub(r"\{(\w+)\}", r"@@\1@@", VIEWS[name]).replace("{", "{{").replace("}", "}}")
                self._made[name] = self.spark.sql(re.sub(r"@@(\w+)@@", r"{\1}", text), **uses)
        return self._made[name]


    def _base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


class StreamTables(Tables):
    """The same tables with one base table read as a stream of files."""

    def __init__(self, spark: SparkSession, folder: str, streamed: str = "events", files: str | None = None, per_trigger: int = 8):
        super().__init__(spark, folder)
        self._streamed, self._files, self._per_trigger = streamed, files, per_trigger

    def _base(self, name: str) -> DataFrame:
        table = super()._base(name)
        if name != self._streamed:
            return table
        reader = self.spark.readStream.schema(table.schema).option("maxFilesPerTrigger", self._per_trigger)
        if self._files:
            return reader.parquet(self._files)
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(self.folder)


def with_views(body: str) -> str:
    """Prefix a SELECT with the views it names, for an engine that only has the base tables."""
    wanted, queue = [], [body]
    while queue:
        text = queue.pop()
        for name in VIEWS:
            if name not in wanted and re.search(rf"\b{name}\b", text):
                wanted.append(name)
                queue.append(VIEWS[name])
    order = []

    def visit(name: str) -> None:
        if name in order or name not in VIEWS:
            return
        for used in re.findall(r"\{(\w+)\}", VIEWS[name]):
            visit(used)
        order.append(name)

    for name in wanted:
        visit(name)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({re.sub(r'{(\w+)}', r'\1', VIEWS[n])})" for n in order)
    rest = body.strip()
    if rest.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{rest[15:]}"
    return f"WITH {ctes},\n{rest[5:]}" if rest.upper().startswith("WITH ") else f"WITH {ctes}\n{rest}"
