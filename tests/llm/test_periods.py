"""Periodic runs against the definition, word by word."""
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from patronage.llm import periods


def runs_by_definition(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def made(rng):
    words = []
    while len(words) < rng.randint(0, 300):
        part = [rng.choice("abc") for _ in range(rng.randint(1, 40))]
        words += part * rng.choice([1, 1, 2, 4, 5, 9]) + part[: rng.randint(0, len(part))]
    return words


def local_runs(words, **how):
    codes = np.unique(words, return_inverse=True)[1].astype(np.int32) if words else np.zeros(0, np.int32)
    best = {}
    for q, s, e in periods.fragments(codes, np.array([len(codes)]), **how)[0]:
        if e - s >= max(6, 4 * q):
            best[s, e - s] = min(q, best.get((s, e - s), q))
    return sorted((s, n, q) for (s, n), q in best.items())


@pytest.mark.parametrize("seed", range(60))
def test_fragments_equal_the_definition(seed):
    words = made(random.Random(seed))
    assert local_runs(words) == runs_by_definition(words)


def test_z_function():
    s = list("aabaabaaxaab")
    assert periods.z_function(s) == [len(s)] + [next((k for k in range(len(s) - i) if s[i + k] != s[k]), len(s) - i) for i in range(1, len(s))]


def test_equal_hashes_of_unequal_words_are_refuted(monkeypatch):
    """With one hash for all windows every pair is a candidate; results stay the same."""
    real = periods.window_hashes
    monkeypatch.setattr(periods, "window_hashes", lambda codes: (np.zeros_like(h) for h in real(codes)))
    for seed in range(8):
        words = made(random.Random(seed))
        assert local_runs(words) == runs_by_definition(words)


def digest(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2])))
    return hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest()


@pytest.mark.parametrize("long", [1 << 16, 40])
def test_documents_whole_or_in_strips(spark, monkeypatch, long):
    """Strips of a document that is exploded give the rows of one that is not."""
    if long == 40:
        monkeypatch.setattr(periods, "LONG", long)
        monkeypatch.setattr(periods, "STRIP", 32)
    rng = random.Random(5)
    texts = [made(rng) for _ in range(40)] + [["x"] * 700, [str(i % 150) for i in range(900)], [str(i) for i in range(200)]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = {r.doc_id: r for r in periods.digests(df, "doc_id").collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        runs, r = runs_by_definition(t), rows[i]
        assert (r.runs_sha256, r.collapsed_sha256) == digest(t, runs) and r.n_runs == len(runs) and r.n_words == len(t)
        best = min(((-n, s, q) for s, n, q in runs), default=None)
        assert (r.start, r.length, r.period) == ((best[1], -best[0], best[2]) if best else (None, None, None))
        assert r.exponent_milli == (-best[0] * 1000 // best[2] if best else None)


def test_period_of_a_very_long_text(spark):
    """300,000 words: strips go to many tasks, the run of 290,000 words comes back in one piece."""
    tail = [f"w{i}" for i in range(9_000)]
    words = [f"h{i}" for i in range(10_000)] + [tail[i % 9_000] for i in range(290_000)]
    df = spark.createDataFrame([(1, "\n".join(words))], "doc_id long, text string")
    (r,) = periods.digests(df, "doc_id").collect()
    assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (1, 10_000, 290_000, 9_000, 32_222)
    assert r.collapsed_sha256 == digest(words, [(10_000, 290_000, 9_000)])[1]


def test_edges(spark, odd_docs):
    rows = periods.digests(odd_docs, "doc_id").collect()
    assert len(rows) == odd_docs.count()
    nothing = hashlib.sha256(b"").hexdigest()
    for r in rows:
        if r.doc_id in (2, 3, 4):
            assert (r.n_words, r.n_runs, r.start, r.period, r.runs_sha256, r.collapsed_sha256) == (0, 0, None, None, nothing, nothing)
    assert [(r.n_runs, r.period, r.length) for r in rows if r.doc_id == 8] == [(1, 3, 12_000)]
    assert len({(r.runs_sha256, r.collapsed_sha256) for r in rows if r.doc_id == 5}) == 1
    assert periods.digests(odd_docs.limit(0), "doc_id").collect() == []


def test_repeated_texts(spark):
    """The altered texts of the query, computed by the rule."""
    rows = [(i, " ".join(f"w{k}" for k in range(i % 37))) for i in range(-150, 400)] + [(None, "a b c"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = df.select("doc_id", "text", periods.repeated(F.col("text"), F.col("doc_id")).alias("t")).collect()
    changed = 0
    for r in got:
        words = (r.text or "").split()
        h = None if r.doc_id is None else zlib.crc32(str(r.doc_id).encode())
        if h is None or h % 10 or not words:
            assert r.t == r.text
            continue
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        assert r.t.split() == words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        changed += 1
    assert changed > 30
