"""Merged customers keep what both sides had."""
import random
from datetime import datetime

from patronage.operators import identity as N, merging as M


def test_winner_takes_over_whole_records(spark):
    day = lambda n: datetime(2024, 5, n)
    customers = spark.createDataFrame([
        ("w", "active", None, "line", ["form"], ["a"], 2, None, day(3), day(4), None, None, False, False, day(4), None),
        ("l", "active", None, "form", ["facebook_lead"], ["b"], 3, 1, day(1), day(9), True, False, False, False, day(4), "x@y.org"),
        ("o", "active", None, "line", ["sheet"], None, 7, 7, day(2), day(2), None, None, False, False, day(4), None)],
        "customer_id string, status string, merged_into string, source_channel string, sources array<string>, tags array<string>, milestones long, form_submits long, "
        "first_interaction_at timestamp, last_interaction_at timestamp, consent_data boolean, consent_marketing boolean, sheet_dirty boolean, ai_dirty boolean, updated_at timestamp, email string")
    out = N.apply_merges(customers, spark.createDataFrame([("w", "l")], "winner_id string, loser_id string"), "2026-01-01")
    assert out.columns == customers.columns
    got = {r.customer_id: r for r in out.collect()}
    w, lost, o = got["w"], got["l"], got["o"]
    assert (w.sources, w.tags, w.milestones, w.form_submits) == (["facebook_lead", "form", "line"], ["a", "b"], 5, 1)
    assert (w.first_interaction_at, w.last_interaction_at, w.consent_data, w.consent_marketing, w.email) == (day(1), day(9), True, False, "x@y.org")
    assert w.sheet_dirty and w.ai_dirty and lost.sheet_dirty and lost.ai_dirty and (lost.status, lost.merged_into, lost.milestones) == ("merged", "w", 3)
    assert (o.sources, o.milestones, o.form_submits, o.sheet_dirty, o.updated_at) == (["line", "sheet"], 7, 7, False, day(4))


def survivors(pairs):
    """By definition: groups of pairs that meet; one that never loses survives, else the smallest."""
    groups = {x: {x} for p in pairs for x in p}
    for a, b in pairs:
        if groups[a] is not groups[b]:
            groups[a] |= groups[b]
            for x in groups[b]:
                groups[x] = groups[a]
    losers = {b for a, b in pairs if a != b}
    root = {x: min(g, key=lambda y: (y in losers, y)) for x, g in groups.items()}
    return {x: r for x, r in root.items() if x != r}


def test_merges_that_meet(spark):
    chain = [(f"k{i:03d}", f"k{i + 1:03d}") for i in range(70)]
    star = [("hub", f"s{i:03d}") for i in range(50)]
    cycle = [("z1", "z2"), ("z2", "z3"), ("z3", "z1")]
    two = [("p", "shared"), ("q", "shared"), ("same", "same")]
    rng = random.Random(4)
    some = [(f"r{rng.randint(0, 40):02d}", f"r{rng.randint(0, 40):02d}") for _ in range(25)]
    pairs = chain + star + cycle + two + some
    got = {r.loser_id: r.winner_id for r in M.resolve_merges(spark.createDataFrame(pairs, "winner_id string, loser_id string")).collect()}
    assert got == survivors([p for p in pairs if p[0] != p[1]])
    assert got["k070"] == "k000" and got["s049"] == "hub" and got["z2"] == "z1" and got["q"] == "p"
    assert M.resolve_merges(spark.createDataFrame([], "winner_id string, loser_id string")).collect() == []
