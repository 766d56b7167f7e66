"""A cross-section of the named queries against their SQL; ``check.py`` runs them all."""
import duckdb
import pytest

from check import compare
from patronage.catalog import load
from patronage.sources.bindings import BASE

SAMPLE = ["revenue_by_month", "seats_by_course", "people_total", "new_vs_returning", "intent_funnel", "scrub_legacy_people", "match_candidates", "customer_profiles",
          "sales_sheet", "import_people", "sheet_profile_quantiles", "partner_event_log", "merged_customers", "fold_leads", "post_analytics", "mirror_advance", "health_issues", "stream_ingest"]


@pytest.fixture(scope="module")
def con(folder):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for table in BASE:
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, folder, name):
    queries, oracles = load()
    ok, text = compare(spark, con, folder, name, queries[name], oracles[name])
    assert ok, text


def test_every_query_has_sql():
    queries, oracles = load()
    assert set(queries) == set(oracles)


def test_entry(spark):
    from __spark_entry__ import entry
    assert entry(spark).columns == ["key", "label", "value", "share", "delta"]
