"""Named queries for identity resolution, merges and the partner pipeline."""
from pyspark.sql import functions as F

from patronage.catalog import query
from patronage.operators import identity as N, merging as M, partner as P, scrub as S

STAMP = "2026-01-01"
CHAIN = """chain AS (SELECT customer_id, merged_into AS cur, 1 AS hops FROM customers WHERE status = 'merged'
    UNION ALL SELECT chain.customer_id, m.merged_into, hops + 1 FROM chain JOIN customers m ON m.customer_id = chain.cur AND m.status = 'merged' WHERE hops < 5),
  ends AS (SELECT customer_id, arg_max(cur, hops) AS cur, max(hops) AS hops FROM chain GROUP BY 1)"""


@query("merge_chain_lenient", f"WITH RECURSIVE {CHAIN} SELECT customer_id, cur AS survivor FROM ends")
def chain_lenient(t):
    return N.follow_merges(t.customers, strict=False)


@query("merge_chain_strict", f"""WITH RECURSIVE {CHAIN} SELECT customer_id, CASE WHEN hops < 5 AND cur IN (SELECT customer_id FROM customers) THEN cur END AS survivor FROM ends""")
def chain_strict(t):
    return N.follow_merges(t.customers, strict=True)


def _events_with_contacts(t):
    """Chat events of test users with the contact their customer row holds."""
    c = t.customers.select(F.concat(F.lit("U"), F.col("c_custkey").cast("string")).alias("line_user_id"), "phone", "email")
    return t.inbound.where("line_user_id is not null").select("seq", "provider", F.lit("chan_0").alias("channel_id"), "line_user_id").join(
        c, "line_user_id").withColumnRenamed("line_user_id", "external_id")


EVC = """ev AS (SELECT seq, provider, 'chan_0' AS channel_id, line_user_id AS external_id, phone, email FROM inbound
    JOIN (SELECT 'U' || c_custkey AS uid, phone, email FROM customers) ON uid = line_user_id)"""
OWN = """ph AS (SELECT phone, count(*) AS n, min(customer_id) AS owner FROM customers WHERE status = 'active' AND phone IS NOT NULL GROUP BY 1),
  em AS (SELECT email, count(*) AS n, min(customer_id) AS owner FROM customers WHERE status = 'active' AND email IS NOT NULL GROUP BY 1)"""


@query("resolve_events", f"""WITH RECURSIVE {CHAIN}, {EVC}, {OWN}, kn AS (SELECT i.provider, i.channel_id, i.external_id, coalesce(ends.cur, i.customer_id) AS kid
      FROM identities i LEFT JOIN ends ON ends.customer_id = i.customer_id)
    SELECT seq, coalesce(kid, ph.owner, em.owner, 'cus_' || left(sha256(ev.provider || '|chan_0|' || ev.external_id), 26)) AS customer_id,
      kid IS NULL AND ph.owner IS NULL AND em.owner IS NULL AS is_new, kid IS NULL AND (ph.owner IS NOT NULL OR em.owner IS NOT NULL) AS linked
    FROM ev LEFT JOIN kn ON kn.provider = ev.provider AND kn.channel_id = ev.channel_id AND kn.external_id = ev.external_id
      LEFT JOIN ph ON ph.phone = ev.phone LEFT JOIN em ON em.email = ev.email""")
def resolve_events(t):
    return N.resolve_events(_events_with_contacts(t), t.identities, t.customers).select("seq", "customer_id", "is_new", "linked")


FIRST = """fi AS (SELECT external_id, arg_min(customer_id, (linked_at, customer_id)) AS cid FROM identities GROUP BY 1)"""


@query("resolve_login", f"""WITH RECURSIVE {CHAIN}, {FIRST} SELECT u.external_id, coalesce(ends.cur, cid) AS customer_id
    FROM (SELECT DISTINCT 'U' || user_id AS external_id FROM events) u LEFT JOIN fi ON fi.external_id = u.external_id LEFT JOIN ends ON ends.customer_id = cid""")
def resolve_login(t):
    logins = t.events.select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("external_id")).distinct()
    return N.resolve_login(logins, t.identities, t.customers).select("external_id", "customer_id")


SUBJ = f"""{FIRST}, st AS (SELECT external_id, CASE WHEN ends.customer_id IS NULL THEN CASE WHEN cid IN (SELECT customer_id FROM customers) THEN cid END
      WHEN hops < 5 AND cur IN (SELECT customer_id FROM customers) THEN cur END AS lid FROM fi LEFT JOIN ends ON ends.customer_id = cid),
  sub AS (SELECT f.*, st.external_id IS NOT NULL AS by_line, st.lid, line_user_id IS NOT NULL AND st.external_id IS NULL AS mk, ph.n AS pn, ph.owner AS po, em.n AS en, em.owner AS eo
    FROM partner_feed f LEFT JOIN st ON st.external_id = line_user_id LEFT JOIN ph ON ph.phone = '+66' || substr(f.phone, 2) LEFT JOIN em ON em.email = f.email),
  row0 AS (SELECT *, CASE WHEN k % 23 = 0 OR k % 19 = 0 OR type = 'refund' THEN 'rejected' WHEN type = 'tag' THEN 'quarantined'
      WHEN type = 'purchase' AND k % 31 = 0 THEN 'rejected' WHEN type = 'purchase' AND (k % 17 = 0 OR k % 37 = 0) THEN 'quarantined' ELSE 'ok' END AS outcome,
    CASE WHEN k % 23 = 0 THEN 'forbidden_chat_field' WHEN k % 19 = 0 THEN 'invalid_schema:occurredAt' WHEN type = 'tag' THEN 'unsupported_type:tag'
      WHEN type = 'refund' THEN 'unsupported_type:refund' WHEN type = 'purchase' AND k % 31 = 0 THEN 'unsupported_kind:bogus'
      WHEN type = 'purchase' AND k % 17 = 0 THEN 'unknown_course_code:NOPE' WHEN type = 'purchase' AND k % 37 = 0 THEN 'course_mismatch:INNER:commu' END AS why FROM sub),
  row1 AS (SELECT *, mk AND outcome = 'ok' AS made FROM row0),
  row2 AS (SELECT *, CASE WHEN type = 'purchase.void' THEN NULL WHEN by_line THEN lid WHEN made THEN 'cus_' || left(sha256('line|partner|' || line_user_id), 26) WHEN pn = 1 THEN po
      WHEN pn IS NULL AND en = 1 THEN eo END AS cust, NOT by_line AND NOT made AND (coalesce(pn > 1, FALSE) OR (pn IS NULL AND coalesce(en > 1, FALSE))) AS amb,
    CASE WHEN by_line OR made THEN 'line' WHEN pn = 1 THEN 'phone_only' WHEN pn IS NULL AND en = 1 THEN 'email_only' END AS ev FROM row1),
  row3 AS (SELECT a.*, b.k AS bk, b.outcome AS b_out, b.type AS b_type, b.cust AS b_cust FROM row2 a LEFT JOIN row2 b ON a.k % 10 = 7 AND b.k = a.e AND b.k <> a.k AND b.outcome <> 'rejected'),
  row4 AS (SELECT *, bk IS NOT NULL AND outcome <> 'rejected' AND b_type <> type AS tclash,
      bk IS NOT NULL AND outcome = 'ok' AND b_out = 'ok' AND type = 'purchase' AND cust IS NOT NULL AND cust IS DISTINCT FROM b_cust AS oclash FROM row3),
  row5 AS (SELECT *, CASE WHEN outcome = 'rejected' THEN 'rejected' WHEN bk IS NOT NULL AND revision = 1 THEN 'duplicate' WHEN tclash OR oclash THEN 'rejected'
      WHEN outcome = 'quarantined' THEN 'quarantined' WHEN type = 'purchase' AND coalesce(CASE WHEN b_out = 'ok' THEN b_cust END, cust) IS NULL THEN 'pending_identity' ELSE 'accepted' END AS st0 FROM row4),
  logx AS (SELECT a.*, CASE WHEN a.type = 'purchase.void' AND a.st0 = 'accepted' AND NOT coalesce(tg.st0 IN ('accepted', 'pending_identity') AND tg.type = 'purchase', FALSE)
      THEN 'quarantined' ELSE a.st0 END AS status FROM row5 a LEFT JOIN row5 tg ON a.type = 'purchase.void' AND tg.k = a.k - 1 AND tg.e = tg.k),
  log2 AS (SELECT *, CASE WHEN outcome = 'rejected' THEN why WHEN status = 'rejected' THEN CASE WHEN tclash THEN 'revision_type_change' ELSE 'revision_identity_change' END
      WHEN status = 'quarantined' AND type = 'purchase.void' THEN 'void_target_not_found' WHEN status = 'quarantined' THEN why
      WHEN status = 'pending_identity' THEN CASE WHEN amb THEN 'ambiguous_identity' ELSE 'identity_not_found' END
      WHEN status = 'accepted' AND type = 'purchase' THEN ev END AS reason FROM logx)"""
LOG = f"WITH RECURSIVE {CHAIN}, {OWN}, {SUBJ}"


def log(t, *payload):
    """The log of the partner's events with the ``payload`` columns that a query reads."""
    return P.intake(t.partner_raw, t.identities, t.customers, payload=payload)


@query("partner_event_log", f"{LOG} SELECT k AS seq, CASE WHEN TRUE THEN 'ord-' || e END AS event_id, status, reason FROM log2")
def event_log(t):
    return log(t).select("seq", "event_id", "status", "reason")


@query("partner_intake_summary", f"""{LOG} SELECT count(CASE WHEN status = 'accepted' THEN 1 END) AS accepted, count(CASE WHEN status = 'duplicate' THEN 1 END) AS duplicate,
    count(CASE WHEN status = 'quarantined' THEN 1 END) AS quarantined, count(CASE WHEN status = 'rejected' THEN 1 END) AS rejected,
    count(CASE WHEN status = 'pending_identity' THEN 1 END) AS pending_identity FROM log2""")
def intake_summary(t):
    return P.intake_summary(log(t))


FOLD = """cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY e ORDER BY revision DESC, k DESC) AS rn FROM log2
    WHERE type = 'purchase' AND status IN ('accepted', 'pending_identity')) WHERE rn = 1),
  vd AS (SELECT k - 1 AS e FROM log2 WHERE type = 'purchase.void' AND status = 'accepted')"""


@query("partner_purchases", f"""{LOG}, {FOLD} SELECT 'ord-' || cur.e AS event_id, CAST(amount_text AS DECIMAL(18,2)) AS amount, CAST(paid_text AS DATE) AS paid_at,
    CAST(left(paid_text, 4) AS INT) AS year, CASE WHEN vd.e IS NOT NULL THEN 'voided' ELSE 'active' END AS status, 'slip ' || k AS external_payment_id,
    coalesce(CASE WHEN b_out = 'ok' THEN b_cust END, cust) AS customer_id FROM cur LEFT JOIN vd ON vd.e = cur.e""")
def purchases(t):
    return P.fold_purchases(log(t, *P.PURCHASE))[0].select("event_id", "amount", "paid_at", "year", "status", "external_payment_id", "customer_id")


@query("partner_purchase_items", f"""{LOG}, {FOLD}, it AS (SELECT 'INNER' AS course_code, k % 3 <> 0 AS seat FROM cur UNION ALL SELECT 'OTHER', FALSE FROM cur)
    SELECT course_code, seat AS counts_as_seat, count(*) AS n FROM it GROUP BY ALL""")
def items(t):
    return P.fold_purchases(log(t, *P.PURCHASE))[1].groupBy("course_code", "counts_as_seat").agg(F.count("*").alias("n"))


@query("partner_quarantine", f"""{LOG} SELECT 'ord-' || e AS event_id, arg_max(reason, (revision, k)) AS reason FROM log2
    WHERE status IN ('quarantined', 'accepted', 'pending_identity') GROUP BY e HAVING arg_max(status, (revision, k)) = 'quarantined'""")
def quarantine(t):
    return P.quarantine_table(log(t, "raw")).select("event_id", "reason")


#: Opinions replayed arrival by arrival: ``live`` are the rows of a pair that count, ``held`` also the voided ones.
REPLAY = f"""{SUBJ[:SUBJ.index("),", SUBJ.index("st AS"))]}),
  op AS (SELECT f.*, CASE WHEN st.external_id IS NOT NULL THEN st.lid WHEN type = 'intent' THEN 'cus_' || left(sha256('line|partner|' || line_user_id), 26) END AS cust
    FROM opinion_feed f LEFT JOIN st ON st.external_id = line_user_id),
  it AS (SELECT * FROM op WHERE type = 'intent' AND cust IS NOT NULL),
  acts AS (SELECT cust, course, k, 'intent' AS act, k AS id, source = 'staff' AS staff, observed,
      {{'obs': observed, 'staff': source = 'staff', 'conf': CASE WHEN source = 'staff' THEN 1.0 ELSE CAST(confidence AS DOUBLE) END, 'k': k, 'sticky': lock_kind = 'sticky'}} AS entry FROM it
    UNION ALL SELECT it.cust, it.course, v.k, 'void', it.k, NULL, NULL, NULL FROM op v JOIN it ON it.k = v.k - 1 WHERE v.type = 'intent.void'
    UNION ALL SELECT p.cust, p.course, e.k, 'erase', NULL, NULL, NULL, NULL FROM op e JOIN (SELECT DISTINCT cust, course FROM it) p ON p.cust = e.cust WHERE e.type = 'erase'),
  num AS (SELECT *, row_number() OVER (PARTITION BY cust, course ORDER BY k) AS n FROM acts),
  f AS (SELECT DISTINCT cust, course, 0::BIGINT AS n, NULL::BIGINT AS k, NULL::VARCHAR AS act, NULL::VARCHAR AS no, FALSE AS hit,
      []::STRUCT(obs DATE, staff BOOLEAN, conf DOUBLE, k BIGINT, sticky BOOLEAN)[] AS live, []::BIGINT[] AS held FROM it
    UNION ALL SELECT cust, course, n, k, act, no, CASE act WHEN 'intent' THEN TRUE WHEN 'void' THEN list_contains(held, id) ELSE len(held) > 0 END,
      CASE WHEN act = 'intent' AND no IS NULL THEN list_append(live, entry) WHEN act = 'intent' THEN live WHEN act = 'void' THEN list_filter(live, lambda x: x.k <> id) ELSE [] END,
      CASE WHEN act = 'intent' AND no IS NULL THEN list_append(held, id) WHEN act = 'erase' THEN [] ELSE held END
    FROM (SELECT num.*, f.live, f.held, CASE WHEN num.act = 'intent' AND NOT num.staff AND list_sort(f.live)[-1].staff THEN
        CASE WHEN list_sort(f.live)[-1].sticky THEN 'staff_sticky' WHEN observed <= list_sort(f.live)[-1].obs THEN 'staff_decided' END END AS no
      FROM f JOIN num ON num.cust = f.cust AND num.course IS NOT DISTINCT FROM f.course AND num.n = f.n + 1))"""
OPINIONS = f"WITH RECURSIVE {CHAIN}, {REPLAY}"


def opinions(t, payload=P.ARRIVAL):
    return P.intake(t.opinion_raw, t.identities, t.customers, payload=payload)


@query("partner_intents", f"""{OPINIONS}, fin AS (SELECT cust, course, live, held, list_sort(live)[-1].k AS top FROM f
      QUALIFY row_number() OVER (PARTITION BY cust, course ORDER BY n DESC) = 1),
    rows AS (SELECT cust, course, unnest(held) AS k, [x.k FOR x IN live] AS alive, top FROM fin)
    SELECT 'opn-' || k AS event_id, cust AS customer_id, course AS course_code, NOT list_contains(alive, k) AS voided, k IS NOT DISTINCT FROM top AS current FROM rows
    UNION ALL SELECT 'opn-' || op.k, NULL, course, EXISTS (SELECT 1 FROM op v WHERE v.type = 'intent.void' AND v.k = op.k + 1), FALSE FROM op WHERE type = 'intent' AND cust IS NULL""")
def partner_intents(t):
    """What is left of the opinions after staff precedence, voids and erasures, and which of them are current."""
    left = P.fold_intents(opinions(t, P.OPINION), "2026-01-01")
    voided = F.col("voided_at").isNotNull()
    return left.select("event_id", "customer_id", "course_code", voided.alias("voided"), (F.col("customer_id").isNotNull() & ~voided & F.col("superseded_at").isNull()).alias("current"))


@query("partner_intent_voids", f"""{OPINIONS} SELECT op.k AS seq, op.type, CASE WHEN op.type = 'intent' THEN CASE WHEN op.cust IS NULL THEN 'pending_identity' WHEN no IS NULL THEN 'accepted' ELSE 'rejected' END
      WHEN coalesce(hit, w.k IS NOT NULL) THEN 'accepted' ELSE 'quarantined' END AS status,
    CASE WHEN op.type = 'intent' THEN CASE WHEN op.cust IS NULL THEN 'identity_not_found' ELSE coalesce(no, 'line') END
      WHEN NOT coalesce(hit, w.k IS NOT NULL) THEN 'void_target_not_found' END AS reason
    FROM op LEFT JOIN (SELECT k, no, hit FROM f WHERE act <> 'erase') r ON r.k = op.k LEFT JOIN op w ON w.k = op.k - 1 AND w.type = 'intent' AND w.cust IS NULL WHERE op.type <> 'erase'""")
def partner_intent_voids(t):
    """The outcome of every opinion and every void in arrival order."""
    return P.judge_opinions(opinions(t))[0].where("type <> 'erase'").select("seq", "type", "status", "reason")


@query("partner_erasures", f"""{OPINIONS} SELECT op.k AS seq, cust AS customer_id, CASE WHEN cust IS NULL THEN 'pending_identity' ELSE 'accepted' END AS status,
    CASE WHEN cust IS NULL THEN 'subject_not_found' END AS reason, (SELECT count(*) FROM f WHERE act = 'erase' AND hit AND f.k = op.k) AS pairs FROM op WHERE type = 'erase'""")
def partner_erasures(t):
    """Every erasure with its customer and the number of (customer, course) pairs whose opinions it takes back."""
    return P.erasure_report(*P.judge_opinions(opinions(t)))


LATER = """lph AS (SELECT phone, count(*) AS n, min(customer_id) AS owner FROM customers WHERE (status = 'active' OR c_custkey % 20 = 1) AND phone IS NOT NULL GROUP BY 1),
  lem AS (SELECT email, count(*) AS n, min(customer_id) AS owner FROM customers WHERE (status = 'active' OR c_custkey % 20 = 1) AND email IS NOT NULL GROUP BY 1),
  pd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY e ORDER BY revision DESC, k DESC) AS rp FROM log2 WHERE status = 'pending_identity' AND type = 'purchase') WHERE rp = 1),
  rc AS (SELECT pd.e AS re, CASE WHEN by_line THEN lid WHEN lph.n = 1 THEN lph.owner WHEN lph.n IS NULL AND lem.n = 1 THEN lem.owner END AS rcust,
    NOT by_line AND (coalesce(lph.n > 1, FALSE) OR (lph.n IS NULL AND coalesce(lem.n > 1, FALSE))) AS ramb
    FROM pd LEFT JOIN lph ON lph.phone = '+66' || substr(pd.phone, 2) LEFT JOIN lem ON lem.email = pd.email)"""


def _found_later(t, events):
    """Waiting events looked up again after every twentieth customer came back."""
    back = F.when(F.col("c_custkey") % 20 == 1, "active").otherwise(F.col("status"))
    return P.reconcile_pending(events, t.identities, t.customers.withColumn("status", back))


@query("partner_reconcile_report", f"""{LOG}, {LATER} SELECT count(*) AS scanned, count(rcust) AS resolved, count(CASE WHEN NOT ramb AND rcust IS NULL THEN 1 END) AS still_pending,
    count(CASE WHEN ramb THEN 1 END) AS ambiguous FROM rc""")
def reconcile(t):
    return P.reconcile_report(_found_later(t, log(t, *P.SUBJECT)))


@query("reconciled_purchases", f"""{LOG}, {FOLD}, {LATER} SELECT 'ord-' || cur.e AS event_id,
    coalesce(CASE WHEN b_out = 'ok' THEN b_cust END, cust, CASE WHEN cur.status = 'pending_identity' THEN rcust END) AS customer_id FROM cur LEFT JOIN rc ON re = cur.e""")
def reconciled_purchases(t):
    events = log(t, *P.SUBJECT, *P.PURCHASE)
    return P.fold_purchases(P.reconciled(events, _found_later(t, events)))[0].select("event_id", "customer_id")


CORRECTED = f"""{LOG}, q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY e ORDER BY revision DESC, k DESC) AS rq FROM log2 WHERE status = 'quarantined') WHERE rq = 1),
    reach AS (SELECT e AS te, max(revision) AS top FROM log2 WHERE status IN ('accepted', 'pending_identity', 'quarantined') GROUP BY 1),
    fo AS (SELECT * FROM (SELECT e AS oe, cust AS owner, row_number() OVER (PARTITION BY e ORDER BY k) AS ro FROM log2 WHERE outcome = 'ok') WHERE ro = 1),
    own AS (SELECT q.*, top, oe, owner, CASE WHEN type = 'purchase.void' THEN NULL WHEN by_line THEN lid WHEN mk AND type <> 'tag' THEN 'cus_' || left(sha256('line|partner|' || line_user_id), 26)
      WHEN pn = 1 THEN po WHEN pn IS NULL AND en = 1 THEN eo END AS fcust FROM q LEFT JOIN reach ON te = e LEFT JOIN fo ON oe = e),
    fx AS (SELECT *, CASE WHEN revision + 1 <= top THEN 'duplicate' WHEN type = 'purchase' AND oe IS NOT NULL AND fcust IS NOT NULL AND fcust IS DISTINCT FROM owner THEN 'rejected'
      WHEN type = 'tag' THEN 'quarantined' WHEN type = 'purchase' AND coalesce(fcust, owner) IS NULL THEN 'pending_identity' ELSE 'accepted' END AS fst FROM own),
    tg AS (SELECT e AS ge, min(came) AS came FROM (SELECT e, k AS came FROM log2 WHERE type = 'purchase' AND status IN ('accepted', 'pending_identity')
      UNION ALL SELECT e, k + 1000000000 FROM fx WHERE type = 'purchase' AND fst IN ('accepted', 'pending_identity')) GROUP BY 1),
    fixed AS (SELECT 'ord-' || fx.e AS event_id, revision + 1 AS revision, CASE WHEN type = 'purchase' THEN 'COMMU' END AS course,
      CASE WHEN type = 'purchase.void' AND fst = 'accepted' AND NOT coalesce(tg.came < fx.k + 1000000000, FALSE) THEN 'quarantined' ELSE fst END AS status
    FROM fx LEFT JOIN tg ON fx.type = 'purchase.void' AND ge = fx.k - 1)"""


def _fixed(t):
    """Every event with a row in quarantine, re-sent orders and lost voids included, after a fix of its course."""
    none = F.lit(None).cast("string")

    def fixes(before):
        return before.where("status = 'quarantined'").groupBy("partner_id", "event_id").agg(F.max(F.struct("revision", "seq")).alias("l")).select(
            "partner_id", "event_id", (F.col("l.seq") + 1_000_000_000).alias("fix_seq"), F.lit("COMMU").alias("fix_course"), none.alias("fix_status"), none.alias("fix_voids"))

    return P.intake(t.partner_raw, t.identities, t.customers, fixes, ["lines"]).where("seq >= 1000000000")


@query("partner_corrected_events", f"{CORRECTED} SELECT * FROM fixed")
def corrected_events(t):
    """What becomes of each of them."""
    return _fixed(t).select("event_id", "revision", F.when(F.col("type") == "purchase", F.get("lines", F.lit(0))["course_code"]).alias("course"), "status")


@query("partner_corrections", f"{CORRECTED} SELECT count(*) AS fixed FROM fixed WHERE status IN ('accepted', 'pending_identity')")
def corrections(t):
    """How many of them leave quarantine."""
    return _fixed(t).where("status in ('accepted', 'pending_identity')").agg(F.count("*").alias("fixed"))


def _waiting(t):
    """Every waiting event with its contacts and the name of its customer."""
    waiting = log(t).where("status in ('quarantined', 'pending_identity')").select(F.col("seq").alias("k"))
    names = t.customers.select(F.col("c_custkey").alias("c"), "display_name")
    return t.partner_feed.join(waiting, "k", "left_semi").join(names, "c", "left").select(
        "k", F.concat(F.lit("ord-"), F.col("k").cast("string")).alias("event_id"), P.normalize_phone(F.col("phone")).alias("phone"), "email", "display_name")


def _candidates(t, events):
    return N.match_candidates_for(events, t.customers).select("event_id", "candidate_id", F.concat_ws(",", "matched_by").alias("matched_by"))


REVIEW = f"""{LOG}, ev AS (SELECT k, '+66' || substr(l.phone, 2) AS phone, l.email, n.display_name AS name
      FROM log2 l LEFT JOIN customers n ON n.c_custkey = l.c WHERE l.status IN ('quarantined', 'pending_identity')),
    hits AS (SELECT k, customer_id, 'phone' AS how FROM ev JOIN customers c ON c.phone = ev.phone WHERE status = 'active'
      UNION SELECT k, customer_id, 'email' FROM ev JOIN customers c ON c.email = ev.email WHERE status = 'active'
      UNION SELECT k, customer_id, 'name' FROM ev JOIN customers c ON c.display_name = ev.name WHERE status = 'active'),
    g AS (SELECT k, customer_id, string_agg(how, ',' ORDER BY how) AS matched_by, count(*) AS n FROM hits GROUP BY 1, 2)
    SELECT 'ord-' || k AS event_id, customer_id AS candidate_id, matched_by FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, customer_id) AS rn FROM g) WHERE rn <= 20"""


@query("partner_review_all_candidates", REVIEW)
def review_all_candidates(t):
    return _candidates(t, _waiting(t))


@query("partner_review_candidates", f"SELECT event_id, count(*) AS candidates, min(candidate_id) AS first_id FROM ({REVIEW}) GROUP BY event_id")
def review_candidates(t):
    """How many customers every waiting event may belong to."""
    return review_all_candidates(t).groupBy("event_id").agg(F.count("*").alias("candidates"), F.min("candidate_id").alias("first_id"))


@query("contact_conflicts", """WITH o AS (SELECT customer_id, phone FROM customers WHERE status = 'active' AND phone IS NOT NULL),
    p AS (SELECT c.customer_id, min(o.customer_id) AS candidate_id FROM customers c JOIN o ON o.phone = c.phone AND o.customer_id <> c.customer_id GROUP BY 1)
    , no AS (SELECT customer_id AS a, 'cus_' || (c_custkey - 1) AS b FROM customers WHERE c_custkey % 20 = 7)
    SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM no WHERE (a = customer_id AND b = candidate_id) OR (b = customer_id AND a = candidate_id))""")
def contact_conflicts(t):
    rejected = t.customers.where("c_custkey % 20 = 7").select(F.col("customer_id").alias("a"), F.concat(F.lit("cus_"), (F.col("c_custkey") - 1).cast("string")).alias("b"))
    return N.contact_conflicts(t.customers, t.customers, rejected)


MERGE = """mp AS (SELECT 'cus_' || (c_custkey - 1) AS a, customer_id AS b FROM customers WHERE c_custkey % 10 = 7 AND status = 'active' AND (c_custkey - 1) % 20 > 1),
  ver AS (SELECT customer_id, count(*) AS v FROM identities WHERE verified GROUP BY 1),
  fact AS (SELECT c.customer_id, coalesce(v, 0) AS v, created_at, (display_name IS NOT NULL)::INT + (nickname IS NOT NULL)::INT + (phone IS NOT NULL)::INT + (email IS NOT NULL)::INT
      + (birth_year IS NOT NULL)::INT + consent_data::INT AS filled FROM customers c LEFT JOIN ver ON ver.customer_id = c.customer_id),
  win AS (SELECT CASE WHEN keep THEN a ELSE b END AS winner_id, CASE WHEN keep THEN b ELSE a END AS loser_id FROM (SELECT a, b,
      fa.v > fb.v OR (fa.v = fb.v AND (fa.created_at < fb.created_at OR (fa.created_at = fb.created_at AND fa.filled >= fb.filled))) AS keep
    FROM mp JOIN fact fa ON fa.customer_id = a JOIN fact fb ON fb.customer_id = b))"""


def _merges(t):
    pairs = t.customers.where("c_custkey % 10 = 7 and status = 'active' and (c_custkey - 1) % 20 > 1").select(
        F.concat(F.lit("cus_"), (F.col("c_custkey") - 1).cast("string")).alias("a"), F.col("customer_id").alias("b"))
    return N.pick_winner(pairs, t.customers, t.identities)


@query("merge_winners", f"WITH {MERGE} SELECT * FROM win")
def merge_winners(t):
    return _merges(t)


MERGED = """SELECT c.customer_id, CASE WHEN l.loser_id IS NOT NULL THEN 'merged' ELSE c.status END AS status, coalesce(l.winner_id, c.merged_into) AS merged_into,
    coalesce(c.email, lo.email) AS email, coalesce(c.phone, lo.phone) AS phone, coalesce(c.title, lo.title) AS title, coalesce(c.birth_year, lo.birth_year) AS birth_year,
    coalesce(c.display_name, lo.display_name) AS display_name, coalesce(c.nickname, lo.nickname) AS nickname, coalesce(c.full_name_en, lo.full_name_en) AS full_name_en,
    coalesce(c.heard_from, lo.heard_from) AS heard_from, array_to_string(list_sort(list_distinct([c.source_channel, lo.source_channel])), ',') AS sources,
    c.consent_data, c.consent_marketing, c.sheet_dirty OR l.loser_id IS NOT NULL OR lo.customer_id IS NOT NULL AS sheet_dirty,
    c.ai_dirty OR l.loser_id IS NOT NULL OR lo.customer_id IS NOT NULL AS ai_dirty,
    strftime(CASE WHEN l.loser_id IS NOT NULL OR lo.customer_id IS NOT NULL THEN TIMESTAMP '2026-01-01' ELSE c.updated_at END, '%Y-%m-%d') AS updated_at,
    strftime(least(c.first_interaction_at, coalesce(lo.first_interaction_at, c.first_interaction_at)), '%Y-%m-%d') AS first_interaction_at
    FROM customers c LEFT JOIN win l ON l.loser_id = c.customer_id LEFT JOIN win w ON w.winner_id = c.customer_id LEFT JOIN customers lo ON lo.customer_id = w.loser_id"""


@query("merged_customers", f"WITH {MERGE} {MERGED}")
def merged_customers(t):
    """Every column that a merge writes and that these customers have."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return N.apply_merges(t.customers, _merges(t), "2026-01-01").select(
        "customer_id", "status", "merged_into", "email", "phone", "title", "birth_year", "display_name", "nickname", "full_name_en", "heard_from",
        F.concat_ws(",", "sources").alias("sources"), "consent_data", "consent_marketing", "sheet_dirty", "ai_dirty", day("updated_at"), day("first_interaction_at"))


#: Pairs that meet: k with k - 1 and k - 1 with k - 2. One survivor a group, one that never loses if there is one.
GRAPH = MERGE.replace("c_custkey % 10 = 7", "c_custkey % 10 IN (6, 7)") + """,
  links AS (SELECT winner_id AS x, loser_id AS y FROM win UNION SELECT loser_id, winner_id FROM win),
  reach AS (SELECT x, x AS y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
  graph AS (SELECT x AS loser_id, arg_min(y, (y IN (SELECT loser_id FROM win), y)) AS winner_id FROM reach GROUP BY x),
  fin AS (SELECT * FROM graph WHERE loser_id <> winner_id)"""
CHILDREN = ["identities", "purchases", "owned_items", "intents", "submissions", "customer_links"]


def _run(t):
    pairs = t.customers.where("c_custkey % 10 in (6, 7) and status = 'active' and (c_custkey - 1) % 20 > 1").select(
        F.concat(F.lit("cus_"), (F.col("c_custkey") - 1).cast("string")).alias("a"), F.col("customer_id").alias("b"))
    return M.merge_run(t.customers, N.pick_winner(pairs, t.customers, t.identities), {c: getattr(t, c) for c in CHILDREN}, STAMP)


@query("merge_graph", f"WITH RECURSIVE {GRAPH} SELECT loser_id AS customer_id, winner_id AS survivor_id FROM fin")
def merge_graph(t):
    """The tombstones of a run whose merges meet, with their survivors."""
    before = t.customers.select("customer_id", F.col("merged_into").alias("was"))
    return _run(t)["customers"].join(before, "customer_id").where("status = 'merged' and not (merged_into <=> was)").select("customer_id", F.col("merged_into").alias("survivor_id"))


@query("merge_moves", f"WITH RECURSIVE {GRAPH} " + " UNION ALL ".join(
    f"SELECT winner_id, '{c}' AS child, count(*) AS n FROM {c} JOIN fin ON loser_id = customer_id GROUP BY 1" for c in CHILDREN))
def merge_moves(t):
    """Rows that came to each survivor, by table."""
    return _run(t)["moved"]


@query("merged_intents", f"""WITH RECURSIVE {GRAPH}, mine AS (SELECT i.* REPLACE (coalesce(winner_id, customer_id) AS customer_id) FROM intents i LEFT JOIN fin ON loser_id = customer_id),
    top AS (SELECT intent_id FROM (SELECT *, row_number() OVER (PARTITION BY customer_id, course_code ORDER BY observed_at DESC,
      CASE WHEN source = 'staff' THEN 0 ELSE 1 END, confidence DESC, created_at DESC, intent_id DESC) AS rn FROM mine WHERE voided_at IS NULL) WHERE rn = 1)
    SELECT m.intent_id, m.customer_id, top.intent_id IS NULL AS superseded FROM mine m LEFT JOIN top ON top.intent_id = m.intent_id
    WHERE m.customer_id IN (SELECT winner_id FROM fin)""")
def merged_intents(t):
    """The survivors' opinions, their own and those that came, with the current one of each course decided again."""
    out, won = _run(t), merge_graph(t).select(F.col("survivor_id").alias("customer_id")).distinct()
    return out["intents"].join(won, "customer_id", "left_semi").select("intent_id", "customer_id", F.col("superseded_at").isNotNull().alias("superseded"))


@query("merged_purchases", f"""WITH {MERGE} SELECT purchase_id, coalesce(winner_id, customer_id) AS customer_id FROM purchases LEFT JOIN win ON loser_id = customer_id""")
def merged_purchases(t):
    return N.rekey(t.purchases, _merges(t)).select("purchase_id", "customer_id")


def _erase(t):
    return t.customers.where("c_custkey % 50 = 12").select("customer_id", F.lit("customer_request").alias("reason"))


@query("erase_customers", """SELECT customer_id, CASE WHEN c_custkey % 50 = 12 THEN 'erased' ELSE status END AS status, CASE WHEN c_custkey % 50 <> 12 THEN phone END AS phone,
    CASE WHEN c_custkey % 50 <> 12 THEN email END AS email, CASE WHEN c_custkey % 50 <> 12 THEN display_name END AS display_name FROM customers""")
def erase_customers(t):
    return S.erase_customers(t.customers, _erase(t), "2026-01-01").select("customer_id", "status", "phone", "email", "display_name")


@query("erase_audit", """SELECT c.customer_id, (SELECT count(*) FROM intents i WHERE i.customer_id = c.customer_id) AS intents,
    (SELECT count(*) FROM identities i WHERE i.customer_id = c.customer_id) AS identities FROM customers c WHERE c_custkey % 50 = 12""")
def erase_audit(t):
    return S.erase_audit(_erase(t), {"intents": t.intents, "identities": t.identities}, "2026-01-01").select("customer_id", "intents", "identities")


@query("erase_keeps_other_intents", "SELECT intent_id FROM intents WHERE customer_id IS NULL OR CAST(substr(customer_id, 5) AS BIGINT) % 50 <> 12")
def erase_intents(t):
    return S.drop_owned(t.intents, _erase(t)).select("intent_id")


DEC = """dc AS (SELECT 'lnk_a' || c_custkey AS link_id, CASE WHEN c_custkey % 6 = 0 THEN 'auto' ELSE 'needs_review' END AS expected,
    CASE WHEN c_custkey % 10 = 1 THEN 'auto' WHEN c_custkey % 3 = 0 THEN 'rejected' ELSE 'confirmed' END AS decision FROM customers WHERE c_custkey % 5 <> 0),
  jd AS (SELECT dc.*, l.status, coalesce(dc.expected = l.status AND l.status IN ('needs_review', 'auto') AND decision IN ('confirmed', 'rejected'), FALSE) AS ok
    FROM dc LEFT JOIN customer_links l ON l.link_id = dc.link_id)"""


def _decided(t):
    from patronage.operators.decisions import LINK_STEPS, apply_decisions
    d = t.customers.where("c_custkey % 5 <> 0").select(
        F.concat(F.lit("lnk_a"), F.col("c_custkey").cast("string")).alias("link_id"),
        F.expr("CASE WHEN c_custkey % 6 = 0 THEN 'auto' ELSE 'needs_review' END").alias("expected"),
        F.expr("CASE WHEN c_custkey % 10 = 1 THEN 'auto' WHEN c_custkey % 3 = 0 THEN 'rejected' ELSE 'confirmed' END").alias("decision"),
        F.lit("staff").alias("actor"), F.col("updated_at").alias("at"))
    return apply_decisions(t.customer_links, d, "link_id", "status", LINK_STEPS)


@query("link_decisions", f"WITH {DEC} SELECT l.link_id, coalesce(jd.decision, l.status) AS status FROM customer_links l LEFT JOIN jd ON jd.link_id = l.link_id AND jd.ok")
def link_decisions(t):
    return _decided(t)[0].select("link_id", "status")


@query("link_decision_conflicts", f"WITH {DEC} SELECT link_id, expected, status AS found, decision FROM jd WHERE NOT ok")
def link_conflicts(t):
    return _decided(t)[1].select("link_id", "expected", "found", "decision")


@query("assign_event_owners", f"""{LOG} SELECT k AS seq, CASE WHEN status = 'pending_identity' AND e % 3 = 0 AND (e % 100) % 20 > 1 THEN 'accepted' ELSE status END AS status FROM log2""")
def assign_owners(t):
    from patronage.operators.decisions import assign_owners as assign
    d = t.partner_feed.where("e % 3 = 0").select(
        F.lit("partner-a").alias("partner_id"), F.concat(F.lit("ord-"), F.col("e").cast("string")).alias("event_id"),
        F.concat(F.lit("cus_"), (F.col("e") % 100).cast("string")).alias("owner"), F.col("k").alias("at"))
    return assign(log(t), d, t.customers)[0].select("seq", "status")
