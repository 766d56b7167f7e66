"""Named queries for scrubbing, its audit and record linkage."""
from pyspark.sql import functions as F

from patronage.catalog import query
from patronage.operators import linkage as L, scrub as S
from patronage.sources.store import settle, spread

KEY = "test-pepper"  # a fixed key so both engines hash alike; real jobs pass their secret
YEAR = 2026


def _hmac(expr: str) -> str:
    pad = lambda x: bytes(b ^ x for b in KEY.encode().ljust(64, b"\0")).hex()
    return f"sha256(unhex('{pad(0x5C)}') || unhex(sha256(unhex('{pad(0x36)}') || encode({expr}))))"


def _token(c):
    tag = "'PERSON|'"  # fixed value: what the keyed hash of a name begins with
    return f"'<PERSON_' || left({_hmac(f'{tag} || lower({c})')}, 8) || '>'"


def _mask_phone(c):
    return f"'0' || substr({c}, 4, 1) || 'x-xxx-' || right({c}, 4)"


def _mask_email(c):
    return f"left({c}, 2) || '***' || substr({c}, strpos({c}, '@'))"


CNAMES = """list_distinct(list_filter([CASE WHEN c_custkey % 3 = 0 THEN 'somchai' ELSE 'given' || CAST(c_custkey % 97 AS STRING) END,
   'fam' || CAST(c_custkey % 53 AS STRING), CASE WHEN c_custkey % 2 = 0 THEN 'given' || CAST(c_custkey % 97 AS STRING) END,
   CASE WHEN c_custkey % 2 = 0 THEN '{0}' || CAST(c_custkey % 31 AS STRING) END], lambda x: x IS NOT NULL))"""
LKEY = "CAST(substr(person_id, 5) AS BIGINT)"


@query("scrub_customers", f"""SELECT customer_id, status, merged_into, title, heard_from, customer_status, birth_year,
    {_token('display_name')} AS display_name, {_token('nickname')} AS nickname, {_token('full_name_en')} AS full_name_en,
    {_mask_phone('phone')} AS phone, {_mask_email('email')} AS email,
    {_hmac("'PHONE|' || phone")} AS phone_hash, {_hmac("'EMAIL|' || email")} AS email_hash,
    array_to_string(list_sort(list_transform({CNAMES.format('en')}, lambda w: left({_hmac("'NAMEPART|' || w")}, 12))), ',') AS name_keys,
    left({_hmac("'NAMEPART|' || lower(nickname)")}, 12) AS nickname_key, consent_marketing,
    CAST(first_interaction_at AS DATE) AS first_interaction_at, CAST(form_submitted_at AS DATE) AS form_submitted_at,
    lead_pending AS lead_pending FROM customers""")
def scrub_customers(t):
    df = S.scrub_customers(spread(t.customers), KEY)
    return df.withColumns({"name_keys": F.concat_ws(",", "name_keys"),
                           "lead_pending": F.col("lead_attribution.attribution_pending")}).drop("lead_attribution", "source_updated_at")


LSTATS = """SELECT person_id, count(*) AS payment_count, sum(coalesce(amount, 0)) AS total_paid, min(paid_at) AS first_paid_at,
    max(paid_at) AS last_paid_at, string_agg(DISTINCT CAST(year AS STRING), ',' ORDER BY CAST(year AS STRING)) AS years_active
    FROM legacy_payments GROUP BY 1"""
LSEATS = """SELECT person_id, count(*) AS seat_count, string_agg(DISTINCT course_code, ',' ORDER BY course_code) AS course_codes
    FROM legacy_enrollments WHERE counts_as_seat GROUP BY 1"""


@query("scrub_legacy_people", f"""WITH st AS ({LSTATS}), se AS ({LSEATS}) SELECT p.person_id, {_token('display_name')} AS display_name,
    {_mask_phone('phone')} AS phone, {_mask_email('email')} AS email, {_hmac("'PHONE|' || phone")} AS phone_hash,
    {_hmac("'EMAIL|' || email")} AS email_hash,
    CASE WHEN age_at_import >= 10 THEN CAST(age_at_import // 10 * 10 AS STRING) || '-' || CAST(age_at_import // 10 * 10 + 9 AS STRING) END AS age_band,
    first_paid_at, last_paid_at, coalesce(total_paid, 0) AS total_paid, coalesce(payment_count, 0) AS payment_count,
    coalesce(seat_count, 0) AS seat_count, coalesce(course_codes, '') AS course_codes, coalesce(years_active, '') AS years_active
    FROM legacy_people p LEFT JOIN st ON p.person_id = st.person_id LEFT JOIN se ON p.person_id = se.person_id""")
def scrub_legacy_people(t):
    df = legacy_scrubbed(t)
    return df.select("person_id", "display_name", "phone", "email", "phone_hash", "email_hash", "age_band", "first_paid_at",
                     "last_paid_at", "total_paid", "payment_count", "seat_count",
                     *[F.concat_ws(",", F.col(c).cast("array<string>")).alias(c) for c in ("course_codes", "years_active")])


@query("scrub_legacy_payments", f"""SELECT payment_id, person_id, left({_hmac("'SLIP|' || slip_no")}, 12) AS slip_group_id,
    slip_no IS NOT NULL AND count(*) OVER (PARTITION BY slip_no) > 1 AS slip_shared, amount, paid_at, year,
    CAST(extract(MONTH FROM paid_at) AS INT) AS month, sale_rep, synthetic FROM legacy_payments""")
def scrub_legacy_payments(t):
    return S.scrub_legacy_payments(S.flag_shared_slips(t.legacy_payments), KEY)


@query("scrub_legacy_enrollments", """SELECT * REPLACE (CASE WHEN session_label LIKE '%สมชาย%' THEN '«ข้อความอื่น»' ELSE session_label END AS session_label)
    FROM legacy_enrollments""")
def scrub_legacy_enrollments(t):
    return S.scrub_legacy_enrollments(t.legacy_enrollments)


@query("scrub_purchases", f"""SELECT purchase_id, customer_id, partner_id, left({_hmac("'SLIP|' || upper(external_payment_id)")}, 12) AS payment_group_id,
    amount, paid_at, CAST(extract(YEAR FROM paid_at) AS INT) AS year, CAST(extract(MONTH FROM paid_at) AS INT) AS month, sale_rep, status
    FROM purchases""")
def scrub_purchases(t):
    return S.scrub_purchases(t.purchases, KEY)


@query("scrub_purchase_items", """SELECT item_id, purchase_id, course_code, kind, counts_as_seat, session_start, session_label,
    CAST(extract(YEAR FROM session_start) AS INT) AS session_year FROM purchase_items""")
def scrub_items(t):
    return S.scrub_items(t.purchase_items)


@query("scrub_intents", """SELECT intent_id, customer_id, course_code, status, hesitation_reason, confidence, below_threshold, source,
    lock_kind, model, strftime(observed_at, '%Y-%m-%d %H:%M:%S') AS observed_at, voided_at IS NOT NULL AS voided FROM intents""")
def scrub_intents(t):
    return S.scrub_intents(t.intents).withColumns(
        {"observed_at": F.date_format("observed_at", "yyyy-MM-dd HH:mm:ss"), "voided": F.col("voided_at").isNotNull()}).drop("voided_at")


def legacy_scrubbed(t):
    return S.scrub_legacy_people(spread(t.legacy_people), S.person_payment_stats(t.legacy_payments, t.legacy_enrollments), KEY)


@query("leak_audit_scrubbed_customers", """SELECT '' AS "column", '' AS violation, 0 AS "rows" WHERE FALSE""")
def leak_clean(t):
    return S.leak_counts(S.leak_audit(S.scrub_customers(t.customers, KEY), "customer_id"))


@query("leak_audit_raw_customers", """SELECT "column", violation, count(*) AS "rows" FROM (
    SELECT 'phone' AS "column", 'phone' AS violation FROM customers WHERE phone IS NOT NULL
    UNION ALL SELECT 'email', 'email' FROM customers WHERE email IS NOT NULL) GROUP BY ALL""")
def leak_raw(t):
    return S.leak_counts(S.leak_audit(t.customers, "customer_id"))


EMAIL_RX = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


@query("leak_audit_documents", f"""SELECT doc_id AS id, v AS violation FROM (
    SELECT doc_id, unnest([CASE WHEN regexp_matches(' ' || text || ' ', '[^0-9](\\+66|0)[2-9][0-9]{{7,8}}[^0-9]') THEN 'phone' END,
      CASE WHEN regexp_matches(text, '{EMAIL_RX}') THEN 'email' END]) AS v FROM documents) WHERE v IS NOT NULL""")
def leak_documents(t):
    return S.leak_audit(spread(t.documents.select("doc_id", "text")), "doc_id").select(F.col("id").cast("long").alias("id"), "violation")


@query("leak_audit_nested", """WITH c AS (SELECT c_custkey AS k FROM customer)
    SELECT CAST(k AS STRING) AS id, 'contact.text' AS "column", 'email' AS violation FROM c WHERE k % 3 = 0
    UNION ALL SELECT CAST(k AS STRING), 'lines.label', 'phone' FROM c WHERE k % 5 = 0
    UNION ALL SELECT CAST(k AS STRING), 'extra.key', 'email' FROM c WHERE k % 7 = 0
    UNION ALL SELECT CAST(k AS STRING), 'extra', 'phone' FROM c WHERE k % 11 = 0
    UNION ALL SELECT NULL, 'lines.slip_no', 'forbidden' UNION ALL SELECT NULL, 'contact.raw', 'forbidden'""")
def leak_nested(t):
    """A masked and a full address in one text, contacts inside arrays of structs and maps, forbidden fields below the top."""
    k = F.col("c_custkey")
    phone = F.concat(F.lit("0812"), F.lpad((k % 1_000_000).cast("string"), 6, "0"))
    mail = F.concat(F.lit("user"), k.cast("string"), F.lit("@example.com"))
    rows = t.customer.select(
        k.alias("id"),
        F.struct(F.when(k % 3 == 0, F.concat(F.lit("us***@example.com or "), mail)).otherwise("us***@example.com").alias("text"), k.alias("raw")).alias("contact"),
        F.array(F.struct(F.lit("seat").alias("label"), k.alias("slip_no")),
                F.struct(F.when(k % 5 == 0, F.concat(F.lit("call "), phone)).otherwise("book").alias("label"), k.alias("slip_no"))).alias("lines"),
        F.create_map(F.when(k % 7 == 0, mail).otherwise("mail"), F.when(k % 11 == 0, phone).otherwise("none")).alias("extra"))
    return S.leak_audit(rows, "id", forbidden=S.FORBIDDEN_LEGACY)


# ---- linkage --------------------------------------------------------------------------------

def match_sides(t):
    held = (t.owned_items.where("counts_as_seat and customer_id is not null").groupBy("customer_id")
            .agg(F.sort_array(F.collect_set("course_code")).alias("course_codes")))
    customers = S.scrub_customers(spread(t.customers), KEY).join(held, "customer_id", "left")
    return L.customer_side(customers, YEAR), L.legacy_side(legacy_scrubbed(t))


SIDES = f"""cc AS (SELECT customer_id, list_sort(list_distinct(list(course_code))) AS courses FROM owned_items
      WHERE counts_as_seat AND customer_id IS NOT NULL GROUP BY 1),
  c AS (SELECT m.customer_id, status NOT IN ('merged', 'archived') AS open, phone, email, {CNAMES.format('en')} AS names, nickname AS nick,
      right(phone, 4) AS last4, substr(email, strpos(email, '@') + 1) AS dom, ({YEAR} + 543 - birth_year) // 10 AS age,
      coalesce(courses, []) AS courses, CAST(first_interaction_at AS DATE) AS seen FROM customers m LEFT JOIN cc ON m.customer_id = cc.customer_id),
  lc AS (SELECT person_id, list_distinct(list(course_code)) AS courses FROM legacy_enrollments WHERE counts_as_seat GROUP BY 1),
  lf AS (SELECT person_id, min(paid_at) AS seen FROM legacy_payments GROUP BY 1),
  l AS (SELECT p.person_id, phone, email, {CNAMES.format('old').replace('c_custkey', LKEY.replace('person_id', 'p.person_id'))} AS names,
      nickname AS nick, right(phone, 4) AS last4, substr(email, strpos(email, '@') + 1) AS dom, age_at_import // 10 AS age,
      coalesce(courses, []) AS courses, seen FROM legacy_people p LEFT JOIN lc ON p.person_id = lc.person_id LEFT JOIN lf ON p.person_id = lf.person_id),
  cp AS (SELECT phone, count(*) AS n FROM c GROUP BY 1), ce AS (SELECT email, count(*) AS n FROM c GROUP BY 1),
  lp AS (SELECT phone, count(*) AS n FROM l GROUP BY 1), le AS (SELECT email, count(*) AS n FROM l GROUP BY 1),
  scored AS (SELECT c.customer_id, l.person_id AS legacy_person_id, coalesce(c.phone = l.phone, FALSE) AS ph, coalesce(c.email = l.email, FALSE) AS em,
      c.phone AS cphone, c.email AS cemail, len(list_intersect(c.names, l.names)) AS ov, coalesce(c.nick = l.nick, FALSE) AS nk,
      coalesce(c.last4 = l.last4, FALSE) AS l4, coalesce(c.dom = l.dom, FALSE) AS dm, c.age = l.age AS ag,
      len(list_intersect(c.courses, l.courses)) AS co, len(c.names) AS ta, len(l.names) AS tb, abs(date_diff('day', c.seen, l.seen)) AS dd
    FROM c, l WHERE c.open),
  blocked AS (SELECT *, ph OR em AS hashed, ov >= 2 AND nk AS ruled,
      ov * 3 + nk::INT * 3 + l4::INT * 2 + dm::INT + coalesce(ag, FALSE)::INT + co * 2 AS rank_score
    FROM scored WHERE ph OR em OR ov > 0 OR nk OR l4 OR dm OR coalesce(ag, FALSE)),
  topped AS (SELECT *, CASE WHEN NOT hashed AND NOT ruled THEN row_number() OVER (PARTITION BY customer_id, hashed OR ruled
      ORDER BY rank_score DESC, legacy_person_id) END AS rn FROM blocked),
  pairs AS (SELECT t.*, greatest(CASE WHEN ph THEN cp.n - 1 + lp.n - 1 ELSE 0 END, CASE WHEN em THEN ce.n - 1 + le.n - 1 ELSE 0 END) AS comp
    FROM topped t LEFT JOIN cp ON cp.phone = cphone LEFT JOIN lp ON lp.phone = cphone LEFT JOIN ce ON ce.email = cemail
      LEFT JOIN le ON le.email = cemail WHERE rn IS NULL OR rn <= 5),
  dec AS (SELECT *, CASE WHEN ph THEN 'phone_hash' WHEN em THEN 'email_hash' WHEN ruled THEN 'llm_features' END AS method,
      CASE WHEN ph THEN CASE WHEN comp = 0 THEN 0.95 ELSE 0.75 END WHEN em THEN CASE WHEN comp = 0 THEN 0.9 ELSE 0.7 END WHEN ruled THEN 0.6 END AS score,
      CASE WHEN (ph OR em) AND comp = 0 THEN 'auto' WHEN ph OR em OR ruled THEN 'needs_review' END AS status FROM pairs)"""
PLAIN = """method, score::DOUBLE AS score, status, ph AS phone_hash_match, em AS email_hash_match, ov AS name_key_overlap,
    nk AS nickname_match, ag AS age_band_match, comp AS competing_candidates, co AS course_overlap, dd AS days_between_first_seen"""


def pairs_of(t):
    return L.candidates(*match_sides(t))


def undecided_of(t):
    return L.undecided(*match_sides(t))


@query("match_candidates", f"WITH {SIDES} SELECT customer_id, legacy_person_id, {PLAIN} FROM dec")
def match_candidates(t):
    return pairs_of(t).select(
        "customer_id", "legacy_person_id", "method", "score", "status", "phone_hash_match", "email_hash_match", "name_key_overlap",
        "nickname_match", "age_band_match", "competing_candidates", "course_overlap", "days_between_first_seen")


def _members(rule, key):
    """Rows of a rule's groups on both sides; ``key`` is an expression over the side's columns."""
    return f"""SELECT '{rule}' AS rule, {key} AS key, 'customer' AS side, customer_id AS id, open FROM c
    UNION ALL SELECT '{rule}', {key}, 'legacy', person_id, TRUE FROM l"""


NAME_PAIRS = "unnest(flatten([[nick || ' ' || x || ' ' || y FOR y IN names IF x < y] FOR x IN names]))"


@query("match_rule_groups", f"""WITH {SIDES}, members AS ({_members('phone_hash', 'phone')} UNION ALL {_members('email_hash', 'email')}
    UNION ALL {_members('names', NAME_PAIRS)}),
  sizes AS (SELECT rule, key, count(*) FILTER (side = 'customer') AS n_customers, count(*) FILTER (side = 'customer' AND open) AS n_open,
      count(*) FILTER (side = 'legacy') AS n_legacy FROM members WHERE key IS NOT NULL GROUP BY ALL)
  SELECT rule, side, id, open, n_customers, n_open, n_legacy, n_customers = 1 AND n_legacy = 1 AS clear
  FROM members JOIN sizes USING (rule, key) WHERE n_open > 0 AND n_legacy > 0""")
def match_rule_groups(t):
    """Members of all groups behind the rules: as many rows as members, whatever the number of pairs."""
    return L.rule_groups(*match_sides(t)).drop("key")


@query("match_pair_features", f"""WITH {SIDES} SELECT sha256(customer_id || '|' || legacy_person_id) AS pair_id, ov AS name_key_overlap,
    ta AS name_key_total_a, tb AS name_key_total_b, nk AS nickname_match, ag AS age_band_match, l4 AS phone_last4_match,
    dm AS email_domain_match, co AS course_overlap, dd AS days_between_first_seen FROM dec WHERE method IS NULL""")
def match_pair_features(t):
    return L.pair_features(undecided_of(t))


@query("feature_export_audit", f"WITH {SIDES} SELECT count(*) AS \"rows\", 0 AS unsafe FROM dec WHERE method IS NULL")
def feature_export_audit(t):
    return S.feature_export_audit(L.pair_features(undecided_of(t)))


ANSWER = """SELECT customer_id, legacy_person_id, CASE ov % 3 WHEN 0 THEN 'different' WHEN 1 THEN 'same' ELSE 'unsure' END AS decision,
    0.5 + (co % 5) * 0.1 AS confidence, CASE WHEN dm THEN 'mail a@b' ELSE 'fine' END AS reason FROM dec WHERE method IS NULL"""


def _answers(pairs):
    return pairs.where("method is null").select(
        "customer_id", "legacy_person_id",
        F.expr("CASE name_key_overlap % 3 WHEN 0 THEN 'different' WHEN 1 THEN 'same' ELSE 'unsure' END").alias("decision"),
        (F.lit(0.5) + F.col("course_overlap") % 5 * 0.1).alias("confidence"),
        F.when(F.col("email_domain_match"), "mail a@b").otherwise("fine").alias("reason"), F.lit("m1").alias("model"))


EXT = f"ans AS ({ANSWER}), ext AS (SELECT *, CASE WHEN reason LIKE '%@%' THEN 'unsure' ELSE decision END AS d2 FROM ans)"


@query("external_decisions", f"""WITH {SIDES}, {EXT} SELECT customer_id, legacy_person_id, d2 AS decision, reason LIKE '%@%' AS fallback,
    CASE WHEN d2 = 'same' THEN CASE WHEN confidence >= 0.7 THEN 'medium' ELSE 'low' END END AS confidence,
    CASE WHEN d2 = 'same' THEN 'needs_review' END AS status FROM ext""")
def external_decisions(t):
    pairs = settle(undecided_of(t))
    d = L.external_decisions(pairs, _answers(pairs))
    return d.select("customer_id", "legacy_person_id", "decision", "fallback", F.when(F.col("decision") == "same", F.col("confidence")).alias("confidence"), "status")


RECON = f"""WITH {SIDES}, {EXT}, planned AS (SELECT customer_id, legacy_person_id FROM dec WHERE method IS NOT NULL
    UNION ALL SELECT customer_id, legacy_person_id FROM ext WHERE d2 = 'same'),
  rejected AS (SELECT customer_id, legacy_person_id FROM ext WHERE d2 = 'different' OR (d2 = 'unsure' AND reason NOT LIKE '%@%')),
  act AS (SELECT coalesce(p.customer_id, o.customer_id) AS customer_id, coalesce(p.legacy_person_id, o.legacy_person_id) AS legacy_person_id,
    CASE WHEN o.status IN ('confirmed', 'rejected') THEN 'preserve' WHEN p.customer_id IS NOT NULL AND o.status IS NOT NULL THEN 'update'
      WHEN p.customer_id IS NOT NULL THEN 'insert' WHEN o.decided_by = 'rule' THEN 'remove'
      WHEN o.decided_by = 'llm' AND (d.customer_id IS NULL OR r.customer_id IS NOT NULL) THEN 'remove' ELSE 'keep' END AS action
    FROM planned p FULL JOIN customer_links o ON p.customer_id = o.customer_id AND p.legacy_person_id = o.legacy_person_id
    LEFT JOIN dec d ON d.customer_id = o.customer_id AND d.legacy_person_id = o.legacy_person_id
    LEFT JOIN rejected r ON r.customer_id = o.customer_id AND r.legacy_person_id = o.legacy_person_id)"""


def reconciled(t):
    pairs = settle(pairs_of(t))
    ext = settle(L.external_decisions(pairs, _answers(pairs)))
    return pairs, L.reconcile_links(L.plan_links(pairs, ext), t.customer_links, pairs, ext)


@query("reconcile_links", f"{RECON} SELECT customer_id, legacy_person_id, action FROM act")
def reconcile(t):
    return reconciled(t)[1].select("customer_id", "legacy_person_id", "action")


@query("link_build_report", f"""{RECON} SELECT 'action' AS kind, action AS name, count(*) AS n FROM act GROUP BY ALL
    UNION ALL SELECT 'pair', coalesce(method, 'undecided') || coalesce('/' || status, ''), count(*) FROM dec GROUP BY ALL""")
def link_report(t):
    return L.link_report(*reconciled(t))


@query("link_table_after_build", f"{RECON} SELECT customer_id, legacy_person_id FROM act WHERE action <> 'remove'")
def link_table(t):
    return L.apply_links(reconciled(t)[1], t.customer_links, "2026-01-01 00:00:00").select("customer_id", "legacy_person_id")


@query("verify_links", """WITH d AS (SELECT count(*) AS duplicate_pairs FROM (SELECT 1 FROM customer_links GROUP BY customer_id, legacy_person_id HAVING count(*) > 1)),
    u AS (SELECT count(*) AS unsafe_auto FROM customer_links WHERE status = 'auto' AND (method = 'llm_features' OR competing_candidates > 0))
    SELECT duplicate_pairs, unsafe_auto, duplicate_pairs = 0 AND unsafe_auto = 0 AS ok FROM d, u""")
def verify_links(t):
    return L.verify_links(t.customer_links)


@query("hash_parity", """SELECT 'phone_hash' AS hash, count(*) AS people FROM legacy_people WHERE phone IN (SELECT phone FROM customers WHERE phone IS NOT NULL)
    UNION ALL SELECT 'email_hash', count(*) FROM legacy_people WHERE email IN (SELECT email FROM customers WHERE email IS NOT NULL)""")
def hash_parity(t):
    return L.hash_parity(S.scrub_customers(t.customers, KEY), legacy_scrubbed(t))
