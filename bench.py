"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""
import json
import os
import time

from patronage.catalog import load
from patronage.session import local_session

HEADLINE = [
    "revenue_by_month", "seats_by_course", "people_by_course", "new_vs_returning", "channel_mix_heard_from", "intent_funnel",
    "scrub_customers", "scrub_legacy_people", "leak_audit_documents", "match_candidates", "current_intents", "staff_verdicts",
    "upsell_recommendations", "sales_report", "customer_profiles", "import_people", "sheet_profile_histograms", "partner_event_log",
    "fold_chat_events", "fold_leads", "post_analytics", "form_violations", "mirror_advance", "health_issues", "redact_documents",
]


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    queries["revenue_total"](spark, folder).collect()  # start the session before timing
    times = {}
    for name in HEADLINE:
        started = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - started, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
