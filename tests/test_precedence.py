"""Staff precedence against a plain replay: hot pairs over many ranges, and arrivals that are taken back."""
import datetime as dt
import random

import pytest

from patronage.operators import precedence
from tests.test_flows import INTENT, replay

BASE = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def opinions(seed, n, hot):
    """``hot`` of the rows belong to one pair; times go up and down so that staff rows are overtaken now and then."""
    rng, out = random.Random(seed), []
    for i in range(n):
        staff = rng.random() < 0.15
        customer, course = ("c0", "INNER") if rng.random() < hot else (f"c{rng.randint(1, 9)}", rng.choice(["INNER", None]))
        out.append((f"i{i:05d}", customer, course, "hesitant", "staff" if staff else "ai", "sticky" if staff and rng.random() < 0.1 else "soft", 1.0 if staff else rng.choice([0.5, 0.7]),
                    BASE + dt.timedelta(hours=i // 4 + rng.randint(-60, 60)), BASE + dt.timedelta(minutes=i), None))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_a_pair_with_most_rows_spans_ranges(spark, seed):
    rows = opinions(seed, 3000, 0.9)
    df = spark.createDataFrame(rows, INTENT).repartition(5)
    got = {r.intent_id: r.rejection for r in precedence.staff_verdicts(df).collect()}
    assert got == replay(rows) and {None, "staff_sticky", "staff_decided"} >= set(got.values()) and any(got.values())


def test_maps_compose():
    """The map of a stretch is the map of its halves, one after the other, whatever the state before."""
    rng = random.Random(3)

    def rows(n, lead):
        return [{"customer_id": "c", "course_code": None, "_range": "r", "intent_id": str(i), "source": rng.choice(["ai", "ai", "staff"]), "lock_kind": rng.choice(["soft", "soft", "sticky"]),
                 "observed_at": BASE + dt.timedelta(hours=rng.randint(0, 30)), "confidence": 1.0, "created_at": BASE + dt.timedelta(minutes=i), "_past": lead, "_open": None} for i in range(n)]

    for _ in range(200):
        own, lead, state = rows(rng.randint(1, 12), None), None, rng.choice([None, BASE + dt.timedelta(hours=rng.randint(0, 40))])
        bar = top = end = None
        now = state
        for r in own:
            end, now = precedence._moved(end, r, lead), precedence._moved(now, r, lead)
            if r["source"] == "staff":
                led = r["observed_at"] if lead is None else max(r["observed_at"], lead[0][0])
                bar = bar if top is not None and top > led else precedence._later(bar, led)
                rank = (precedence._rank(r["observed_at"], 1.0, r["created_at"], r["intent_id"]), r["lock_kind"] == "sticky")
                lead = rank if lead is None or rank[0] > lead[0] else lead
            else:
                top = precedence._later(top, r["observed_at"])
        mapped = precedence._later(state, top) if state is not None and (bar is None or state > bar) else end
        assert mapped == now


def arrivals(seed, n):
    rng, out, known = random.Random(seed), [], []
    for k in range(n):
        what = rng.random()
        if known and what < 0.15:
            out.append((k, "void", rng.choice(known), None, None, None, None, None, None))
        elif what < 0.18:
            out.append((k, "erase", f"x{k}", f"c{rng.randint(0, 8)}", None, None, None, None, None))
        else:
            again = known and rng.random() < 0.05
            prior = next(r for r in out if r[2] == known[-1]) if again else None
            staff = rng.random() < 0.3
            out.append((k, "intent", known[-1] if again else f"e{k}", prior[3] if again else f"c{rng.randint(0, 12)}", prior[4] if again else rng.choice(["A", None]), "staff" if staff else "ai",
                        rng.choice(["soft", "sticky"]) if staff and rng.random() < 0.4 else "soft", BASE + dt.timedelta(hours=rng.randint(0, 50)), 1.0 if staff else 0.7))
            if not again:
                known.append(f"e{k}")
    return out


def one_by_one(rows):
    """What the definition says: each arrival meets the rows held at that time."""
    held, where, out = {}, {}, []
    for k, kind, event, customer, course, source, lock, t, conf in rows:
        if kind == "intent":
            where.setdefault(event, (customer, course))
            pair = held.setdefault((customer, course), {})
            others = [v for e, v in pair.items() if e != event and not v["void"]]
            top = max(others, key=lambda v: v["rank"], default=None)
            no = None
            if source == "ai" and top and top["staff"]:
                no = "staff_sticky" if top["sticky"] else "staff_decided" if t <= top["rank"][0] else None
            if no is None:
                pair[event] = {"rank": (t, source == "staff", conf, k), "staff": source == "staff", "sticky": lock == "sticky", "void": event in pair and pair[event]["void"]}
            out.append((k, event, customer, course, no, True))
        elif kind == "void" and event in where:
            row = held[where[event]].get(event)
            if row:
                row["void"] = True
            out.append((k, event, *where[event], None, bool(row)))
        elif kind == "erase":
            for pair in sorted({p for p in where.values() if p[0] == customer}, key=str):
                out.append((k, event, *pair, None, bool(held.get(pair))))
                held[pair] = {}
    return out


@pytest.mark.parametrize("seed", [5, 6, 7])
def test_replay_takes_back_what_voids_and_erasures_undo(spark, seed):
    rows = arrivals(seed, 500)
    df = spark.createDataFrame(rows, "seq long, kind string, event_id string, customer_id string, course_code string, source string, lock_kind string, observed_at timestamp, confidence double")
    got = [(r.seq, r.event_id, r.customer_id, r.course_code, r.rejection, r.hit) for r in precedence.replay(df).collect()]
    # Pairs that are only touched after an erasure of their customer count as pairs of that customer from the start.
    want = one_by_one(rows)
    late = {(g[0], g[2], g[3]) for g in got} - {(w[0], w[2], w[3]) for w in want}
    assert all(not g[5] for g in got if (g[0], g[2], g[3]) in late)
    assert sorted(map(str, (g for g in got if (g[0], g[2], g[3]) not in late))) == sorted(map(str, want))
