"""Invariants of money, privacy and event order, and streams against their batch twins."""
import datetime as dt
import json
import random
from decimal import Decimal
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from patronage.operators import answers as A, events as E, intents as I, partner as P, precedence, quality as Q, recommend as R
from patronage.plans.analytics import AnalyticsQuery, run_analytics
from patronage.streaming import jobs as J


def crm(spark, **tables):
    schemas = {
        "legacy_payments": "payment_id string, person_id string, amount decimal(18,2), paid_at date, sale_rep string, synthetic boolean",
        "purchases": "purchase_id string, customer_id string, amount decimal(18,2), paid_at date, sale_rep string, status string",
        "legacy_enrollments": "person_id string, course_code string, counts_as_seat boolean, session_start date, synthetic boolean",
        "purchase_items": "item_id string, purchase_id string, customer_id string, course_code string, counts_as_seat boolean, session_start date",
        "customer_links": "customer_id string, legacy_person_id string, status string, score double"}
    made = {n: spark.createDataFrame(tables.get(n, []), s) for n, s in schemas.items()}
    return SimpleNamespace(**made, owned_items=made["purchase_items"])


def test_money_on_the_payment_seats_on_the_item(spark):
    d = dt.date(2026, 3, 5)
    t = crm(spark, purchases=[("p1", "c1", Decimal(33900), d, "r", "active"), ("p2", "c1", Decimal(500), d, "r", "voided")],
            purchase_items=[("i1", "p1", "c1", "INNER", True, d), ("i2", "p1", "c1", "COMMU", True, d), ("i3", "p1", "c1", "TTRT", False, d)])
    q = dict(start="2026-03-01", end="2026-03-31")
    assert [r.value for r in run_analytics(t, AnalyticsQuery("revenue", **q)).collect()] == [Decimal("33900.00")]
    assert sum(r.value for r in run_analytics(t, AnalyticsQuery("seats", group_by="course", **q)).collect()) == 2
    assert [r.value for r in run_analytics(t, AnalyticsQuery("revenue", group_by="course", **q)).collect()] == [Decimal("33900.00")]


def test_people_unify_only_over_usable_links(spark):
    d = dt.date(2026, 3, 5)
    t = crm(spark, purchases=[("p1", "c1", Decimal(1), d, None, "active")], legacy_payments=[("l1", "x", Decimal(1), d, None, False), ("l2", "y", Decimal(1), d, None, False)],
            customer_links=[("c1", "x", "confirmed", 0.9), ("c1", "y", "needs_review", 0.9)])
    assert run_analytics(t, AnalyticsQuery("people", start="2026-03-01", end="2026-03-31")).collect()[0].value == 2


def test_query_parameters_are_checked():
    for bad in (dict(metric="x"), dict(start="2026-02-01"), dict(group_by="colour"), dict(min_confidence=2), dict(sources=("web",))):
        with pytest.raises(ValueError):
            AnalyticsQuery(**{**dict(metric="revenue", start="2026-01-01", end="2026-01-31"), **bad})


INTENT = "intent_id string, customer_id string, course_code string, status string, source string, lock_kind string, confidence double, observed_at timestamp, " \
         "created_at timestamp, voided_at timestamp"


def random_intents(seed, n=160):
    rng = random.Random(seed)
    base = dt.datetime(2026, 1, 1)
    out = []
    for i in range(n):
        staff = rng.random() < 0.3
        out.append((f"i{i:04d}", rng.choice(["c1", "c2", "c3"]), rng.choice(["INNER", None]), "hesitant", "staff" if staff else "ai",
                    "sticky" if staff and rng.random() < 0.4 else "soft", 1.0 if staff else rng.choice([0.5, 0.7]),
                    base + dt.timedelta(hours=rng.randint(0, 60)), base + dt.timedelta(hours=3 * i), None))
    return out


def replay(rows):
    current, verdict = {}, {}
    for r in sorted(rows, key=lambda r: (r[8], r[0])):
        key, rank = (r[1], r[2]), (r[7], r[4] == "staff", r[6], r[8], r[0])
        held = current.get(key)
        v = None
        if held and held[0][1] and r[4] == "ai":
            v = "staff_sticky" if held[1] == "sticky" else ("staff_decided" if r[7] <= held[0][0] else None)
        verdict[r[0]] = v
        if v is None and (held is None or rank > held[0]):
            current[key] = (rank, r[5])
    return verdict


@pytest.mark.parametrize("seed", range(4))
def test_staff_verdicts_equal_a_replay(spark, seed):
    rows = random_intents(seed)
    got = {r.intent_id: r.rejection for r in precedence.staff_verdicts(spark.createDataFrame(rows, INTENT)).collect()}
    assert got == replay(rows)


def split_files(spark, df, folder, parts):
    """Write rows as several files in the given order of a column ``part``."""
    for i in range(parts):
        df.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(folder)


def test_staff_lock_stream_equals_batch(spark, tmp_path):
    rows = random_intents(7)
    df = spark.createDataFrame([(*r, i // 40) for i, r in enumerate(sorted(rows, key=lambda r: r[8]))], INTENT + ", part int")
    split_files(spark, df, str(tmp_path / "in"), 4)
    stream = spark.readStream.schema(INTENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    J.drain(J.staff_lock(stream, str(tmp_path / "out"), str(tmp_path / "cp")))
    got = {r.intent_id: r.rejection for r in spark.read.schema(J.VERDICT).parquet(str(tmp_path / "out")).collect()}
    assert got == replay(rows)


def test_late_intent_does_not_become_current_in_any_order(spark, tmp_path):
    rows = random_intents(9)
    want = {(r.customer_id, r.course_code): r.intent_id for r in I.current_intents(spark.createDataFrame(rows, INTENT)).collect()}
    order = list(enumerate(rows))
    random.Random(1).shuffle(order)
    df = spark.createDataFrame([(*r, k % 3) for k, (_, r) in enumerate(order)], INTENT + ", part int")
    split_files(spark, df, str(tmp_path / "in"), 3)
    stream = spark.readStream.schema(INTENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    snaps = J.ChangeRows(spark.createDataFrame([], INTENT), str(tmp_path / "snap"), ["customer_id", "course_code"])
    J.drain(J.keep_current_intents(stream, snaps, str(tmp_path / "cp")))
    assert {(r.customer_id, r.course_code): r.intent_id for r in snaps.latest().collect()} == want


def test_contact_fold_stream_in_shuffled_order(spark, tmp_path):
    rng = random.Random(3)
    base = dt.datetime(2026, 1, 1)
    rows = [(f"e{i}", "line", f"U{rng.randint(0, 4)}", rng.choice(["follow", "message", "unfollow"]), base + dt.timedelta(hours=rng.randint(0, 500)), i % 4) for i in range(80)]
    schema = "event_id string, provider string, line_user_id string, event_type string, occurred_at timestamp"
    df = spark.createDataFrame(rows, schema + ", part int")
    split_files(spark, df, str(tmp_path / "in"), 4)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    empty = spark.createDataFrame([], "line_user_id string, first_interaction_at timestamp, last_interaction_at timestamp, first_message_at timestamp")
    snaps = J.ChangeRows(empty, str(tmp_path / "snap"), ["line_user_id"])
    J.drain(J.fold_contacts(stream, snaps, str(tmp_path / "cp")))
    pick = ["line_user_id", "first_interaction_at", "last_interaction_at", "first_message_at"]
    batch = E.fold_customers(df).select(pick)
    assert sorted(map(tuple, snaps.latest().select(pick).collect()), key=str) == sorted(map(tuple, batch.collect()), key=str)


# ---- partner events -------------------------------------------------------------------------

def event(**changes):
    e = {"eventId": "e1", "type": "purchase", "occurredAt": "2026-01-05T10:00:00+07:00", "revision": 1, "subject": {"phone": "0812345678"},
         "payment": {"externalPaymentId": "x", "amount": 100, "currency": "THB", "paidAt": "2026-01-04",
                     "lines": [{"courseLabel": "Inner", "courseCode": "INNER", "kind": "enrolled", "countsAsSeat": False}]}}
    e.update(changes)
    return {k: v for k, v in e.items() if v != "drop"}


def intent(**changes):
    i = {"courseCode": "INNER", "status": "hesitant", "confidence": 0.7, "source": "ai", "model": "m"}
    i.update(changes)
    return event(type="intent", payment="drop", intent={k: v for k, v in i.items() if v != "drop"})


LINE = {"courseLabel": "Inner", "kind": "enrolled"}
CASES = [
    (event(), "ok", None),
    (event(note="x"), "rejected", "invalid_schema:event"),
    (event(eventId=5), "rejected", "invalid_schema:eventId"),
    (event(eventId="  "), "rejected", "invalid_schema:eventId"),
    (event(occurredAt="2026-01-05T10:00:00"), "rejected", "invalid_schema:occurredAt"),
    (event(revision=0), "rejected", "invalid_schema:revision"),
    (event(revision="1"), "rejected", "invalid_schema:revision"),
    (event(subject={}), "rejected", "invalid_schema:subject"),
    (event(subject={"phone": 812345678}), "rejected", "invalid_schema:subject.phone"),
    (event(subject={"phone": "0812345678", "age": 3}), "rejected", "invalid_schema:subject"),
    (event(subject="drop"), "rejected", "subject_required"),
    (event(payment="drop"), "rejected", "payment_required"),
    (event(payment={**event()["payment"], "amount": -1}), "rejected", "invalid_schema:payment.amount"),
    (event(payment={**event()["payment"], "amount": "100"}), "rejected", "invalid_schema:payment.amount"),
    (event(payment={**event()["payment"], "amount": None}), "ok", None),
    (event(payment={**event()["payment"], "currency": "baht"}), "rejected", "invalid_schema:payment.currency"),
    (event(payment={**event()["payment"], "paidAt": "2026-02-30"}), "rejected", "invalid_schema:payment.paidAt"),
    (event(payment={**event()["payment"], "lines": []}), "rejected", "invalid_schema:payment.lines"),
    (event(payment={**event()["payment"], "lines": [LINE, {**LINE, "kind": 3}]}), "rejected", "invalid_schema:payment.lines.1.kind"),
    (event(payment={**event()["payment"], "lines": [{**LINE, "price": 3}]}), "rejected", "invalid_schema:payment.lines.0"),
    (event(payment={**event()["payment"], "lines": [{**LINE, "kind": "unknown"}]}), "rejected", "unsupported_kind:unknown"),
    (event(payment={**event()["payment"], "lines": [{**LINE, "courseCode": "COMMU"}]}), "quarantined", "course_mismatch:COMMU:Inner"),
    (event(payment={**event()["payment"], "lines": [{**LINE, "courseCode": "ZZZ"}]}), "quarantined", "unknown_course_code:ZZZ"),
    (event(payment={**event()["payment"], "lines": [{**LINE, "courseLabel": "What"}]}), "quarantined", "unknown_course:What"),
    (event(quote="hi"), "rejected", "forbidden_chat_field"),
    (event(subject={"phone": "0812345678", "fullName": 'say "quote": now'}), "ok", None),
    (event(payment={**event()["payment"], "lines": [{**LINE, "summary": "x"}]}), "rejected", "forbidden_chat_field"),
    (event(type="tag"), "quarantined", "unsupported_type:tag"),
    (event(tags=["a"]), "quarantined", "unsupported_type:tag"),
    (event(type="gift"), "rejected", "unsupported_type:gift"),
    (event(type="erase", subject="drop", payment="drop"), "rejected", "erase_requires_subject"),
    (event(type="purchase.void", payment="drop"), "rejected", "voids_required"),
    (intent(), "ok", None),
    (intent(status="maybe"), "quarantined", "unknown_intent_status:maybe"),
    (intent(hesitationReason="rain"), "quarantined", "unknown_hesitation_reason:rain"),
    (intent(status="interested", hesitationReason="budget"), "rejected", "hesitation_reason_without_hesitant"),
    (intent(model="drop"), "rejected", "ai_model_required"),
    (intent(lock="soft"), "rejected", "ai_lock_forbidden"),
    (intent(confidence=1.2), "rejected", "invalid_schema:intent.confidence"),
    (intent(source="robot"), "rejected", "invalid_schema:intent.source"),
    (intent(courseCode="ZZZ"), "quarantined", "unknown_course_code:ZZZ"),
    (event(attribution={"source": "ad", "x": 1}), "rejected", "invalid_schema:attribution"),
    (event(type="erase", payment="drop", erase={"reason": "whim"}), "rejected", "invalid_schema:erase.reason"),
    (event(type="erase", payment="drop", erase={"reason": "legal_request"}), "ok", None),
]


def raw_events(spark, events):
    rows = [("p", i, e if isinstance(e, str) else json.dumps(e, ensure_ascii=False)) for i, e in enumerate(events)]
    return spark.createDataFrame(rows, "partner_id string, seq long, raw string")


def test_partner_validation_cases(spark):
    got = {r.seq: (r.outcome, r.reason) for r in P.parse_events(raw_events(spark, [c[0] for c in CASES] + ["not json", "[1]"])).collect()}
    for i, (e, outcome, reason) in enumerate(CASES):
        assert got[i] == (outcome, reason), e
    assert got[len(CASES)] == ("rejected", "invalid_schema:event") and got[len(CASES) + 1][0] == "rejected"


def people(spark):
    customers = spark.createDataFrame([("c1", "active", None, "+66812345678", None), ("c2", "active", None, "+66899999999", None), ("c3", "active", None, "+66899999999", None)],
                                      "customer_id string, status string, merged_into string, phone string, email string")
    identities = spark.createDataFrame([("line", "ch", "U1", "c2", dt.datetime(2026, 1, 1))], "provider string, channel_id string, external_id string, customer_id string, linked_at timestamp")
    return identities, customers


def test_partner_flow_of_revisions_voids_and_owners(spark):
    pay = event()["payment"]
    log = P.intake(raw_events(spark, [
        event(), event(), event(revision=2, payment={**pay, "amount": 250}), event(revision=3, subject={"lineUserId": "U1"}),
        event(eventId="e2", subject={"phone": "0899999999"}), event(eventId="v", type="purchase.void", payment="drop", subject="drop", voids="e1"),
        event(eventId="w", type="purchase.void", payment="drop", subject="drop", voids="nothing"), event(eventId="e3", subject={"lineUserId": "U9"}),
        event(eventId="e1", type="intent", revision=9, payment="drop", intent=intent()["intent"]), event(eventId="er", type="erase", payment="drop", subject={"phone": "0877777777"}),
    ]), *people(spark)).cache()
    got = {r.seq: (r.status, r.reason) for r in log.collect()}
    assert got[0] == ("accepted", "phone_only") and got[1] == ("duplicate", None) and got[2] == ("accepted", "phone_only")
    assert got[3] == ("rejected", "revision_identity_change") and got[4] == ("pending_identity", "ambiguous_identity")
    assert got[5] == ("accepted", None) and got[6] == ("quarantined", "void_target_not_found") and got[7] == ("accepted", "line")
    assert got[8] == ("rejected", "revision_type_change") and got[9] == ("pending_identity", "subject_not_found")
    head, items = P.fold_purchases(log)
    rows = {r.event_id: r for r in head.collect()}
    assert (rows["e1"].amount, rows["e1"].status, rows["e1"].customer_id) == (Decimal("250.00"), "voided", "c1")
    assert rows["e2"].customer_id is None and items.where("event_id is null" if "event_id" in items.columns else "counts_as_seat").count() == 3
    assert P.erase_requests(log).count() == 0


def test_partner_intents_respect_staff(spark):
    s = lambda **k: intent(source="staff", model="drop", **k)
    late = {**intent(), "eventId": "a2", "occurredAt": "2026-01-01T10:00:00Z"}
    log = P.intake(raw_events(spark, [{**intent(), "eventId": "a1"}, {**s(status="interested", lock="soft"), "eventId": "s1", "occurredAt": "2026-01-06T00:00:00Z"}, late,
                                      {**intent(), "eventId": "a3", "occurredAt": "2026-01-07T00:00:00Z"}]), *people(spark))
    rows = {r.event_id: r for r in P.fold_intents(log, "2026-02-01").collect()}
    assert set(rows) == {"a1", "s1", "a3"} and rows["a3"].superseded_at is None and rows["s1"].superseded_at is not None
    assert rows["s1"].confidence == 1.0 and rows["s1"].model is None


# ---- forms, answers, recommendations --------------------------------------------------------

RULES = [Q.Rule("name", required=True, max_length=5, pattern="^[A-Z]"), Q.Rule("tel", "tel"), Q.Rule("n", "number", min=1, max=9),
         Q.Rule("pick", "radio", options=("a", "b")), Q.Rule("many", "checkbox", min_items=1, max_items=2, options=("x", "y", "z")),
         Q.Rule("ok", "consent", required=True), Q.Rule("why", required=True, visible_if=("pick", "eq", "b")), Q.Rule("pic", "image")]
FORMS = [
    ({"name": "Ann", "ok": True}, set()), ({"name": " ", "ok": True}, {"name/required", "name/pattern"}), ({"ok": True}, {"name/required"}),
    ({"name": "Annabel", "ok": True}, {"name/max_length"}), ({"name": "ann", "ok": True}, {"name/pattern"}), ({"name": "Ann", "ok": False}, {"ok/required"}),
    ({"name": "Ann", "ok": "true"}, {"ok/type", "ok/required"}), ({"name": 5, "ok": True}, {"name/type"}), ({"name": "Ann", "ok": True, "tel": "12"}, {"tel/phone"}),
    ({"name": "Ann", "ok": True, "n": "10"}, {"n/max"}), ({"name": "Ann", "ok": True, "n": "x"}, {"n/type"}), ({"name": "Ann", "ok": True, "pick": "c"}, {"pick/option"}),
    ({"name": "Ann", "ok": True, "pick": "b"}, {"why/required"}), ({"name": "Ann", "ok": True, "many": ["x", "y", "z"]}, {"many/max_items"}),
    ({"name": "Ann", "ok": True, "many": ["q"]}, {"many/option"}), ({"name": "Ann", "ok": True, "many": []}, {"many/min_items"}),
    ({"name": "Ann", "ok": True, "isAdmin": 1}, {"isAdmin/unknown"}), ({"name": "Ann", "ok": True, "pic": "x"}, {"pic/unknown"}),
]


def test_form_rules(spark):
    df = spark.createDataFrame([(i, json.dumps(a)) for i, (a, _) in enumerate(FORMS)], "i int, answers string")
    got = {r.i: {f"{v.field}/{v.code}" for v in r.violations} for r in Q.validate(df, RULES).collect()}
    for i, (a, want) in enumerate(FORMS):
        assert got[i] == want, a


def test_number_audit(spark):
    row = "array(named_struct('key','2026-08','label','2026-08','value',1234.5D,'share',0.1734D,'delta',cast(null as double)))"
    texts = ["ยอด 1,235 บาท (17.34%) ปี 2026", "1234.50", "โต 23%", "2026-08 ได้ 1234.5", "17.0"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, answer string").selectExpr(
        "*", f"{row} as rows", "1234.5D as total", "3L as rows_scanned", "'2026-08-01' as start", "'2026-08-31' as end")
    got = {r.i: r.invented for r in A.audit_answers(df).collect()}
    assert got == {0: [], 1: [], 2: ["23"], 3: [], 4: []}


def test_recommendations(spark):
    d = dt.date(2026, 1, 1)
    hist = spark.createDataFrame([("c1", "INNER", True, d, "partner", False), ("c1", "DEEPIN", False, None, "partner", False), ("c2", "COMMU", True, dt.date(2027, 1, 1), "legacy", False)],
                                 "customer_id string, course_code string, counts_as_seat boolean, session_start date, source string, synthetic boolean")
    people_ = spark.createDataFrame([("c1", "active", "A", None, True), ("c2", "active", None, "B", False)],
                                    "customer_id string, status string, display_name string, line_display_name string, consent_marketing boolean")
    summary = R.history_summary(hist, "2026-06-01")
    assert {r.reco_id for r in R.upsells(summary, people_).collect()} == {"upsell:c1:COMMU", "upsell:c1:INNERCAMP"}
    at = dt.datetime(2026, 2, 1)
    intents = spark.createDataFrame([("i1", "c1", "COMMU", "hesitant", "budget", 0.9, at, None, None), ("i2", "c1", "INNER", "hesitant", None, 0.9, at, None, None),
                                     ("i3", "c2", "INNER", "hesitant", None, 0.9, at, None, None)],
                                    "intent_id string, customer_id string, course_code string, status string, hesitation_reason string, confidence double, observed_at timestamp, "
                                    "superseded_at timestamp, voided_at timestamp")
    rows = R.follow_ups(intents, people_, summary).collect()
    assert [(r.reco_id, r.suggested_action) for r in rows] == [("follow_up:c1:COMMU", "เสนอผ่อน / ส่วนลด")]


def test_change_rows_after_a_restart(spark, tmp_path):
    """A new object finds the versions in the folder; a batch writes its own keys only, and a replayed batch replaces itself."""
    schema = "k string, j string, v int"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    make = lambda: J.ChangeRows(rows(), str(tmp_path / "t"), ["k", "j"])
    assert make().latest().collect() == []
    make().write(rows(*[(f"k{i}", None, i) for i in range(50)]), 0)
    assert make().before(1, rows(("k3", None, 0), ("new", None, 0))).collect() == [("k3", None, 3)]
    for _ in range(2):
        make().write(make().before(1, rows(("k3", None, 0))).withColumn("v", F.col("v") + 100).unionByName(rows(("new", "x", 7))), 1)
    table = make()
    assert spark.read.parquet(str(tmp_path / "t")).groupBy("version").count().orderBy("version").collect() == [(0, 50), (1, 2)]
    assert {r.k: r.v for r in table.latest().collect()} == {**{f"k{i}": i for i in range(50)}, "k3": 103, "new": 7}
    assert sorted(table.compact(str(tmp_path / "c")).latest().collect(), key=str) == sorted(table.latest().collect(), key=str)
    assert spark.read.parquet(str(tmp_path / "c")).count() == 51
