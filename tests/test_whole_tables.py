"""Operators that must not depend on row order, and audits that must report what they are given."""
from pyspark.sql import functions as F

from patronage.functions.text import column_letter, normalize_name
from patronage.operators import events as E, identity as N, quality as Q, scrub as S
from patronage.sources.bindings import Tables


def rows(df):
    return sorted(map(str, df.collect()))


def test_chat_folds_do_not_depend_on_row_order(spark, folder):
    t = Tables(spark, folder)
    owner = t.customers.select(F.concat(F.lit("U"), F.col("c_custkey").cast("string")).alias("line_user_id"), "customer_id")
    stored = t.inbound.limit(0).select(F.col("event_id").alias("source_event_id"))
    a, b = t.inbound, t.inbound.repartition(7, F.xxhash64("seq", F.lit(3))).sortWithinPartitions(F.desc("seq"))
    assert rows(E.fold_customers(a)) == rows(E.fold_customers(b))
    assert rows(E.milestones(a, stored)) == rows(E.milestones(b, stored))
    assert rows(E.merge_fold(t.customers, E.fold_customers(a), owner)) == rows(E.merge_fold(t.customers, E.fold_customers(b), owner))


def test_latest_mark_of_all_chat_ids_decides(spark, folder):
    t = Tables(spark, folder)
    at = lambda d: F.lit(f"2024-05-{d:02d}").cast("timestamp")
    event = lambda i, user, kind, day: spark.range(1).select(F.lit(f"e{i}").alias("event_id"), F.lit("line").alias("provider"), F.lit(user).alias("line_user_id"), F.lit(kind).alias("event_type"), at(day).alias("occurred_at"), at(day).alias("received_at"))
    log = event(1, "Ua", "follow", 1).unionByName(event(2, "Ub", "unfollow", 2))
    owner = spark.createDataFrame([("Ua", "cus_2"), ("Ub", "cus_2")], "line_user_id string, customer_id string")
    status = lambda events: {r.customer_id: r.customer_status for r in E.merge_fold(t.customers, E.fold_customers(events), owner).collect()}["cus_2"]
    assert status(log) == "inactive" and status(log.unionByName(event(3, "Ua", "follow", 3))) == "lead"


def test_a_rejected_pair_is_dropped_both_ways(spark):
    customers = spark.createDataFrame([("a", "1", "active"), ("b", "1", "active"), ("c", "2", "active"), ("d", "2", "active")], "customer_id string, phone string, status string")
    rejected = spark.createDataFrame([("b", "a")], "a string, b string")
    assert {(r.customer_id, r.candidate_id) for r in N.contact_conflicts(customers, customers, rejected).collect()} == {("c", "d"), ("d", "c")}


def test_nested_leaks_are_reported(spark):
    df = spark.createDataFrame([(1, {"k": ["x", "me@here.org"]}, [[("call 0812345678",)]], "us***@a.org and me@here.org")],
                               "id long, m map<string,array<string>>, a array<array<struct<slip_no:string>>>, t string")
    got = {(r.id, r.column, r.violation) for r in S.leak_audit(df, "id", forbidden=S.FORBIDDEN_LEGACY).collect()}
    assert got == {("1", "m", "email"), ("1", "a.slip_no", "phone"), ("1", "t", "email"), (None, "a.slip_no", "forbidden")}
    clean = spark.createDataFrame([(1, "us***@a.org", 5)], "id long, t string, n long")
    assert S.leak_audit(clean, "id").count() == 0 and S.leak_audit(clean.select("id", "n"), "id").count() == 0


def test_answers_are_parsed_once(spark, folder):
    from patronage.catalog.operations import RULES
    t = Tables(spark, folder)
    plan = Q.violations(t.submissions, RULES, "event_id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") <= 2


def test_letters_and_titles(spark):
    got = [r.x for r in spark.createDataFrame([(0,), (25,), (26,), (701,), (702,), (18277,), (18278,)], "i long").select(column_letter(F.col("i")).alias("x")).collect()]
    assert got == ["A", "Z", "AA", "ZZ", "AAA", "ZZZ", "AAAA"]
    names = ["Mr. Ann Lee", "MR.Ann", "mr. A", "Dr Who", "Drake", "นายก ข", "x" * 3000, " Mrs.  Bo "]
    got = [r.x for r in spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, n string").orderBy("k").select(normalize_name(F.col("n")).alias("x")).collect()]
    assert got == ["Ann Lee", "Ann", ". A", "Who", "ake", "ก ข", "x" * 3000, "Bo"]


def test_lookup_keys_of_rows_that_do_not_look_up_are_spread(spark):
    df = spark.range(1000).withColumn("phone", F.lit("1"))
    keys = df.select(N.lookup_key(F.col("id") % 10 == 0, F.col("phone"), df).alias("k")).groupBy("k").count().collect()
    assert {r["count"] for r in keys if r.k != "1"} == {1} and next(r["count"] for r in keys if r.k == "1") == 100
