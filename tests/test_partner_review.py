"""Partner corrections and review candidates over all waiting events, against their SQL and by hand."""
import duckdb
import pytest

from patronage.catalog import load
from patronage.sources.bindings import BASE


@pytest.fixture(scope="module")
def con(folder):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for table in BASE:
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return c


def test_every_quarantined_event_is_corrected(spark, con, folder):
    queries, oracles = load()
    rows = {r.event_id: (r.revision, r.course, r.status) for r in queries["partner_corrected_events"](spark, folder).collect()}
    assert rows == {e: rest for e, *rest in map(tuple, con.execute(f"SELECT event_id, (revision, course, status) FROM ({oracles['partner_corrected_events']})").fetchall()) for rest in [rest[0]]}
    held = con.execute(oracles["partner_event_log"]).fetchall()
    held = [(e, why) for _, e, status, why in held if status == "quarantined"]
    assert set(rows) == {e for e, _ in held}
    # re-sent versions, mismatched courses and lost voids are among them
    mismatched = {e for e, why in held if why.startswith("course_mismatch")}
    assert mismatched and {rows[e][1] for e in mismatched} == {"COMMU"}
    assert any(r > 2 and course for r, course, _ in rows.values()) and any(why == "void_target_not_found" for _, why in held)


def test_every_waiting_event_is_looked_up_by_name(spark, con, folder):
    queries, oracles = load()
    rows = {tuple(r) for r in queries["partner_review_all_candidates"](spark, folder).select("event_id", "candidate_id", "matched_by").collect()}
    assert rows == set(con.execute(f"SELECT event_id, candidate_id, matched_by FROM ({oracles['partner_review_all_candidates']})").fetchall())
    assert any(int(e[4:]) % 3 and "name" in how for e, _, how in rows)


def test_a_frequent_name_keeps_its_ranked_list(spark):
    from patronage.operators import identity as N
    customers = spark.createDataFrame([(f"c{i:03d}", "active", str(i), None, "same") for i in range(300)], "customer_id string, status string, phone string, email string, display_name string")
    events = spark.createDataFrame([("e1", "250", None, "same"), ("e2", None, None, "same"), ("e3", "7", None, "other")], "event_id string, phone string, email string, display_name string")
    got = {(r.event_id, r["rank"]): (r.candidate_id, r.matched_by) for r in N.match_candidates_for(events, customers).collect()}
    assert got[("e1", 1)] == ("c250", ["name", "phone"]) and [got[("e1", k)][0] for k in range(2, 21)] == [f"c{i:03d}" for i in range(19)]
    assert [got[("e2", k)] for k in range(1, 21)] == [(f"c{i:03d}", ["name"]) for i in range(20)] and got[("e3", 1)] == ("c007", ["phone"]) and len(got) == 41
