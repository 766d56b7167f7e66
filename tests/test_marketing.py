"""Leads of the marketing tab."""
from pyspark.sql import functions as F

from patronage.catalog.intake import tagged
from patronage.operators import posts as O
from patronage.sources.bindings import Tables


def test_later_leads_are_in_the_tab_and_the_count(spark, folder):
    t = Tables(spark, folder)
    first = F.col("source_channel") == "facebook_lead"
    some = t.customers.withColumn("sources", F.when(F.col("c_custkey") % 7 == 0, F.array(F.lit("line"), F.lit("facebook_lead"))))
    wanted = {r.customer_id for r in some.where(first | (F.col("c_custkey") % 7 == 0)).select("customer_id").collect()}
    assert len(wanted) > t.customers.where(first).count()
    assert {r.customer_id for r in O.marketing_leads(some, tagged(t)).select("customer_id").collect()} == wanted
    assert O.marketing_counts(some, tagged(t)).first().leads == len(wanted)
