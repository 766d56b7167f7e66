"""Rows that look nothing up, and rows of one key, stay spread over many tasks; answers are parsed once."""
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from patronage.catalog import operations as O
from patronage.catalog.sheets import GRID_HEAD
from patronage.operators import identity as N, partner as P, quality as Q, sheets as X
from patronage.sources.bindings import Tables


@contextmanager
def plain_joins(spark):
    """Joins by shuffle and no help of adaptive execution."""
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def largest(df):
    return max(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())


def test_rows_of_one_sheet_spread(spark):
    with plain_joins(spark):
        head = spark.createDataFrame([("s", 1, GRID_HEAD)], "sheet string, row_number long, cells array<string>")
        body = spark.range(2, 2002).select(F.lit("s").alias("sheet"), F.col("id").alias("row_number"), F.array(*[F.lit("x") for _ in GRID_HEAD]).alias("cells"))
        rows = X.extract_rows(head.unionByName(body))
        assert rows.count() == 2000 and largest(rows) < 600


def test_rows_without_a_target_spread(spark):
    with plain_joins(spark):
        log = spark.range(2000).select(F.lit("p").alias("partner_id"), F.col("id").alias("seq"), F.concat(F.lit("e"), F.col("id")).alias("event_id"),
                                       F.when(F.col("id") == 9, "purchase.void").otherwise("purchase").alias("type"), F.lit("accepted").alias("status"),
                                       F.lit(None).cast("string").alias("reason"), F.when(F.col("id") == 9, "e3").when(F.col("id") == 11, "e5").alias("voids"))
        out = P.judge_voids(log)
        assert largest(out) < 600 and out.where("status = 'accepted'").count() == 2000


def test_subjects_without_a_chat_id_are_not_dealt_by_it(spark, folder):
    with plain_joins(spark):
        t = Tables(spark, folder)
        s = spark.range(100).select(F.col("id"), F.lit(None).cast("string").alias("line_user_id"), F.lit(None).cast("string").alias("phone"), F.lit(None).cast("string").alias("email"))
        plan = N.resolve_subjects(s, t.identities, t.customers)._jdf.queryExecution().executedPlan().toString()
        sides = [x for x in plan.splitlines() if "SortMergeJoin" in x and "line_user_id" in x]
        assert not sides and "_line" in plan


@pytest.mark.parametrize("kind,payload", [("partner_raw", []), ("opinion_raw", P.ARRIVAL)])
def test_columns_that_nobody_reads_take_no_part_in_the_log(spark, folder, monkeypatch, kind, payload):
    t, kept = Tables(spark, folder), []
    inner = P.settle
    monkeypatch.setattr(P, "settle", lambda df: kept.append(set(df.columns)) or inner(df))
    told = ["seq", "event_id", "status", "reason", "customer_id"]
    narrow = P.intake(getattr(t, kind), t.identities, t.customers, payload=payload)
    assert kept and not any(c & ({"raw", "lines", *P.PURCHASE} - set(payload)) for c in kept) and not set(P.SUBJECT) & set(narrow.columns)
    whole = P.intake(getattr(t, kind), t.identities, t.customers)
    assert {"raw", *P.PURCHASE, *P.SUBJECT} <= set(whole.columns) and set(payload) <= set(narrow.columns)
    assert sorted(map(str, narrow.select(told).collect())) == sorted(map(str, whole.select(told).collect())) and narrow.count() > 1000


def test_facts_of_an_event_come_from_one_aggregation(spark):
    """The first stored row gives the type, the first good one the owner; events without a good row have no owner."""
    rows = [("a", 1, "quarantined", "purchase", None), ("a", 2, "ok", "purchase", "c1"), ("a", 3, "ok", "purchase", "c2"), ("b", 4, "quarantined", "tag", None), ("c", 5, "rejected", "refund", None)]
    e = spark.createDataFrame([("p", i, s, s, t, o, c) for i, s, o, t, c in rows], "partner_id string, event_id string, seq long, revision int, type string, outcome string, customer_id string").withColumns(
        {"intent_course": F.lit(None).cast("string"), "reason": F.lit("why"), "evidence": F.lit("line"), "ambiguous": F.lit(False)})
    with plain_joins(spark):
        out = P.settle_revisions(e)
        firsts = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "AS f#" in x]
        assert firsts and all("AS o#" in x for x in firsts)
    got = {r.seq: (r.status, r.reason, r.customer_id) for r in out.collect()}
    assert got == {1: ("quarantined", "why", "c1"), 2: ("accepted", "line", "c1"), 3: ("rejected", "revision_identity_change", "c1"), 4: ("quarantined", "why", None), 5: ("rejected", "why", None)}


def test_corrections_use_the_log_that_intake_has_made(spark, folder, monkeypatch):
    t, parsed = Tables(spark, folder), []
    inner = P.parse_events
    monkeypatch.setattr(P, "parse_events", lambda raw: parsed.append(1) or inner(raw))
    from patronage.catalog.partner import _fixed
    assert _fixed(t).count() > 0 and len(parsed) == 1


@pytest.mark.parametrize("used", ["id", "answers"])
def test_answers_are_parsed_once(spark, folder, used):
    t = Tables(spark, folder)
    valid = Q.valid_submissions(t.submissions, O.RULES).select(F.col("event_id").alias("id"), "answers").select(used)
    plan = valid._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1


def test_undecided_pairs_need_no_rule_pairs(spark, folder, monkeypatch):
    from patronage.catalog import linkage as C
    from patronage.operators import linkage as L

    def refuse(*args):
        raise AssertionError("pairs of rules were made")

    monkeypatch.setattr(L, "fuzzy_pairs", lambda c, l, top: c.sparkSession.createDataFrame([], "customer_id string, legacy_person_id string, score int, rank int"))
    monkeypatch.setattr(L, "rule_groups", refuse)
    monkeypatch.setattr(L, "_rule_keys", refuse)
    t = Tables(spark, folder)
    assert C.feature_export_audit(t).first()["rows"] == 0 and C.match_pair_features(t).isEmpty() and C.external_decisions(t).isEmpty()


def test_lists_are_scored_block_by_block(monkeypatch):
    import random

    import pyarrow as pa
    from patronage.operators import linkage as L
    rng = random.Random(5)

    def side(p, n, blank):
        one = {p + x: pa.array([rng.choice([blank, 1, 2, 3]) for _ in range(n)]) for x in L.SINGLE}
        many = {p + x: pa.array([rng.sample(range(5), rng.randint(0, 3)) for _ in range(n)], pa.list_(pa.int64())) for x in ("names", "courses")}
        return pa.table({p + "id": [f"{p}{i:03d}" for i in range(n)], **one, **many, p + "taken": pa.array([rng.randint(0, 127) for _ in range(n)])})

    left, right = side("c_", 40, -1), side("l_", 101, -2)
    found = []
    for block in (3, 1000):
        monkeypatch.setattr(L, "BLOCK", block)
        found.append(L._score_list(left, right, 5).to_pylist())
    assert len(found[0]) == 200 and found[0] == found[1]


def test_staff_lock_goes_on_from_its_change_rows(spark, tmp_path):
    """One pair, two runs: the second starts from the row that the first has kept as a change row."""
    from patronage.streaming import jobs as J
    from test_flows import INTENT, random_intents, replay
    rows = [(r[0], "c", None, *r[3:]) for r in random_intents(11)]
    half, want = len(rows) // 2, replay(rows)
    for i, part in enumerate((rows[:half], rows[half:])):
        spark.createDataFrame(part, INTENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        J.drain(J.staff_lock(spark.readStream.schema(INTENT).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")))
    got = {r.intent_id: r.rejection for r in spark.read.schema(J.VERDICT).parquet(str(tmp_path / "out")).collect()}
    assert got == want and (tmp_path / "cp-held").exists()


def test_sheet_texts_are_cleaned_once_a_row(spark):
    from patronage.operators import sheets

    rows = spark.createDataFrame([("Inner2025", 3, {"paidAt": "2025-01-02", "amount": " 1,200 ", "phone": "081 234 5678", "email": "A@B.co "}, [("Inner", "x")])],
                                 "sheet string, row_number long, fields map<string,string>, courses array<struct<label:string,value:string>>")
    parsed = sheets.parse_rows(rows)
    assert parsed._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") <= 14
    row = parsed.first()
    assert (str(row.paid_at), str(row.amount), row.phone, row.email, row.person_key) == ("2025-01-02", "1200.00", "+66812345678", "a@b.co", "+66812345678")
