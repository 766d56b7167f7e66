"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions that adds spans.

Base spans come from four patterns, searched leftmost and without overlap per kind; a match that fails its check is dropped
and not tried again. The tagger is trained in numpy on windows around labelled spans of a bounded sample of documents
(``SAMPLE``, picked by hash). Every kind needs a digit or an ``@``, so the windows to be tagged are those around all such
characters of the whole text; they overlap by half. Each window is decoded by the CRF; spans of all windows of a text are
then reconciled globally: a span cut by its window's edge is left to the neighbouring window, equal spans count once with
their best score, base spans stay, and of the others the set without overlaps that has the highest total score is added.

Defined results: a null or empty text has no spans; repeated rows get equal spans; texts are read whole; offsets are code
points with the end exclusive; other columns pass through, own ``spans`` columns are replaced. Without labelled spans in
the sample the tagger adds nothing.
"""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from patronage.llm.shared import text_batches

KINDS = ("email", "ip", "card", "phone")
#: Most documents of the training sample, windows of the training, characters of a window and around an anchor.
SAMPLE, TRAINED, WINDOW, AROUND = 2000, 1500, 96, 24
#: Characters of the longest text in the training sample; tagging reads texts of any length.
LONGEST = 20_000
#: Least mean marginal of a span that the tagger may add.
SURE = 0.9

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT, ANCHOR = re.compile(r"[0-9]"), re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list:
    """(start, end, kind number) in order of start, then kind. Linear in the text for any input."""
    found = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end(), 0))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    if DIGIT.search(text):
        # a match begins at the first of a run of digits: if it fails there, it fails behind it too
        found += [(*m.span(), 1) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p[-3:]) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((*m.span(), 2))
        if "+" in text:
            found += [(*m.span(), 3) for m in PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(found, key=lambda s: (s[0], s[2]))


# the tagger: classes of characters, tags O, B-kind, I-kind

_SIGNS = {c: 6 + k for k, c in enumerate(" \n@.-+()_%:/\"'=,#&?;")}
CLASSES, TAGS = 6 + len(_SIGNS), 1 + 2 * len(KINDS)


def classes(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    table = np.zeros(128, dtype=np.int64)
    table[97:123], table[65:91], table[48:58] = 1, 2, 3
    for c, k in _SIGNS.items():
        table[ord(c)] = k
    return np.where(code < 128, table[np.minimum(code, 127)], 4)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def _sig(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Tagger:
    """Bidirectional LSTM over character classes, a linear layer to tag scores, and CRF transitions."""

    def __init__(self, hidden: int = 12, seed: int = 5):
        r, h = np.random.default_rng(seed), hidden
        self.h = h
        self.p = {f"{d}{k}": r.normal(0, 0.3, size) for d in "fb" for k, size in (("x", (CLASSES + 1, 4 * h)), ("h", (h, 4 * h)))}
        for d in "fb":
            self.p[d + "x"][:, h : 2 * h] += 1.0  # forget gates start open
        self.p |= {"o": r.normal(0, 0.3, (2 * h, TAGS)), "c": np.zeros(TAGS), "t": np.zeros((TAGS, TAGS))}

    def lstm(self, x: np.ndarray, d: str) -> tuple:
        """Hidden states (n, time, h) and what the way back needs; class ``CLASSES`` is padding."""
        n, time = x.shape
        h, order = self.h, range(time) if d == "f" else range(time - 1, -1, -1)
        state, cell, out, kept = np.zeros((n, h)), np.zeros((n, h)), np.zeros((n, time, h)), {}
        for t in order:
            z = self.p[d + "x"][x[:, t]] + state @ self.p[d + "h"]
            gates, new = _sig(z[:, : 3 * h]), np.tanh(z[:, 3 * h :])
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            past, cell = cell, f * cell + i * new
            bent = np.tanh(cell)
            kept[t] = (i, f, o, new, past, bent, state)
            state = out[:, t] = o * bent
        return out, (kept, list(order))

    def emissions(self, x: np.ndarray) -> tuple:
        (a, ka), (b, kb) = self.lstm(x, "f"), self.lstm(x, "b")
        both = np.concatenate([a, b], axis=2)
        return both @ self.p["o"] + self.p["c"], both, ka, kb

    def lattice(self, e: np.ndarray) -> tuple:
        """Forward and backward log sums over tags, each (n, time, tags)."""
        f, b, t = e.copy(), np.zeros_like(e), self.p["t"]
        for k in range(1, e.shape[1]):
            f[:, k] += _lse(f[:, k - 1, :, None] + t, 1)
        for k in range(e.shape[1] - 2, -1, -1):
            b[:, k] = _lse(t + (e[:, k + 1] + b[:, k + 1])[:, None, :], 2)
        return f, b

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict:
        e, both, *kept = self.emissions(x)
        f, b = self.lattice(e)
        z = _lse(f[:, -1], 1)[:, None, None]
        g, n, h = {}, len(x), self.h
        de = np.exp(f + b - z)
        de[np.arange(n)[:, None], np.arange(x.shape[1]), y] -= 1
        step = f[:, :-1, :, None] + self.p["t"] + (e + b)[:, 1:, None, :] - z[..., None]
        g["t"] = np.exp(step).sum(axis=(0, 1))
        np.add.at(g["t"], (y[:, :-1], y[:, 1:]), -1)
        g["o"], g["c"] = both.reshape(-1, 2 * h).T @ de.reshape(-1, TAGS), de.sum(axis=(0, 1))
        one_hot = np.eye(CLASSES + 1)[x.reshape(-1)]
        dboth = de @ self.p["o"].T
        for d, (steps, order), dout in (("f", kept[0], dboth[..., :h]), ("b", kept[1], dboth[..., h:])):
            all_z, states = np.zeros((n, x.shape[1], 4 * h)), np.zeros((n, x.shape[1], h))
            ds, dc = np.zeros((n, h)), np.zeros((n, h))
            for t in reversed(order):
                i, fo, o, new, past, bent, state = steps[t]
                ds = ds + dout[:, t]
                dc = dc + ds * o * (1 - bent * bent)
                dz = np.concatenate([dc * new * i * (1 - i), dc * past * fo * (1 - fo), ds * bent * o * (1 - o), dc * i * (1 - new * new)], axis=1)
                all_z[:, t], states[:, t] = dz, state
                ds, dc = dz @ self.p[d + "h"].T, dc * fo
            flat = all_z.reshape(-1, 4 * h)
            g[d + "x"], g[d + "h"] = one_hot.T @ flat, states.reshape(-1, h).T @ flat
        return {k: v / n for k, v in g.items()}

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 400, batch: int = 32, rate: float = 0.03, seed: int = 5) -> "Tagger":
        r, m, v, order = np.random.default_rng(seed), {}, {}, np.zeros(0, dtype=np.int64)
        for step in range(1, steps + 1):
            if len(order) < batch:
                order = np.concatenate([order, r.permutation(len(x))])
            now, order = order[:batch], order[batch:]
            for name, grad in self.gradients(x[now], y[now]).items():
                grad = np.clip(grad, -5, 5)
                m[name] = 0.9 * m.get(name, 0) + 0.1 * grad
                v[name] = 0.99 * v.get(name, 0) + 0.01 * grad * grad
                self.p[name] -= rate * (1 - step / (steps + 1)) * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-8)
        return self

    def tag(self, x: np.ndarray) -> tuple:
        """(best tags by Viterbi, marginal of each of them)."""
        e = self.emissions(x)[0]
        f, b = self.lattice(e)
        marginal = np.exp(f + b - _lse(f[:, -1], 1)[:, None, None])
        best, back = e[:, 0], []
        for k in range(1, e.shape[1]):
            paths = best[:, :, None] + self.p["t"]
            back.append(paths.argmax(axis=1))
            best = paths.max(axis=1) + e[:, k]
        tags = np.zeros(x.shape, dtype=np.int64)
        tags[:, -1] = best.argmax(axis=1)
        rows = np.arange(len(x))
        for k in range(x.shape[1] - 2, -1, -1):
            tags[:, k] = back[k][rows, tags[:, k + 1]]
        return tags, marginal[rows[:, None], np.arange(x.shape[1]), tags]


def windows(text: str) -> list:
    """Starts of the windows that cover the surroundings of every digit and ``@``; neighbours overlap by half."""
    out: list = []
    low = high = -1

    def cover():
        if low >= 0:
            out.append(low)
            while out[-1] + WINDOW < high:
                out.append(out[-1] + WINDOW // 2)

    for m in ANCHOR.finditer(text):
        a, b = max(0, m.start() - AROUND), min(len(text), m.start() + AROUND)
        if a > high:
            cover()
            low, high = a, b
        high = max(high, b)
    cover()
    return out


def padded(codes: np.ndarray, start: int) -> np.ndarray:
    part = codes[start : start + WINDOW]
    return np.concatenate([part, np.full(WINDOW - len(part), CLASSES)]) if len(part) < WINDOW else part


def gold(text: str, start: int, spans: list) -> np.ndarray:
    y = np.zeros(WINDOW, dtype=np.int64)
    for a, b, k in spans:
        if a < start + WINDOW and b > start and not y[max(a - start, 0) : b - start].any():
            y[max(a - start, 0) : b - start] = 2 + 2 * k
            if a >= start:
                y[a - start] = 1 + 2 * k
    return y


def examples(text: str) -> list:
    """(start, codes, tags) of the text's windows; the labelled spans are the base spans."""
    spans, codes = base_spans(text), classes(text)
    return [(start, padded(codes, start).astype(np.uint8), gold(text, start, spans).astype(np.uint8)) for start in windows(text)]


def train_on(rows: list, trained: int = TRAINED) -> Tagger | None:
    """A tagger from (codes, tags); at most ``trained`` windows, half of them with spans."""
    with_spans, without = [r for r in rows if r[1].any()], [r for r in rows if not r[1].any()]
    if not with_spans:
        return None
    r = np.random.default_rng(3)
    pick = lambda rows, n: [rows[k] for k in r.permutation(len(rows))[:n]]
    some = pick(with_spans, trained // 2) + pick(without, trained - min(len(with_spans), trained // 2))
    return Tagger().fit(np.stack([x for x, _ in some]).astype(np.int64), np.stack([y for _, y in some]).astype(np.int64))


def train(texts: list, trained: int = TRAINED) -> Tagger | None:
    return train_on([(x, y) for text in texts for _, x, y in examples(text)], trained)


def reconciled(base: list, found: dict) -> list:
    """``found`` (start, end, kind) -> score, without overlaps with ``base`` and each other, at the highest total score."""
    spans = sorted((s for s in found if not any(s[0] < b[1] and b[0] < s[1] for b in base)), key=lambda s: s[1])
    best, ends = [(0.0, None)], [0]
    for k, s in enumerate(spans):
        before = np.searchsorted(ends, s[0], side="right") - 1
        take = best[before][0] + found[s]
        best.append((take, (int(before), s)) if take > best[-1][0] else (best[-1][0], None))
        ends.append(s[1])
    out, k = [], len(spans)
    while k:
        if best[k][1]:
            out.append(best[k][1][1])
            k = best[k][1][0]
        else:
            k -= 1
    return out


def added_spans(texts: list, bases: list, tagger: Tagger | None, group: int = 512) -> list:
    """For each text the spans that the tagger adds to its base spans."""
    found = [{} for _ in texts]
    if tagger is None:
        return [[] for _ in texts]
    waiting: list = []

    def flush():
        tags, sure = tagger.tag(np.stack([x for _, _, x, _ in waiting]))
        marks = tags > 0
        for row in np.flatnonzero(marks.any(axis=1)):
            text_no, start, _, size = waiting[row]
            y, k = tags[row], 0
            while k < min(WINDOW, size):
                if y[k] == 0 or y[k] % 2 == 0:
                    k += 1
                    continue
                end = k + 1
                while end < WINDOW and y[end] == y[k] + 1:
                    end += 1
                cut = (k == 0 and start > 0) or (end == WINDOW and size > WINDOW)
                score = float(sure[row, k:end].mean())
                if not cut and end <= size and score >= SURE:
                    key = (start + k, start + end, (int(y[k]) - 1) // 2)
                    found[text_no][key] = max(score, found[text_no].get(key, 0.0))
                k = end
        waiting.clear()

    for text_no, text in enumerate(texts):
        places = windows(text)
        codes = classes(text) if places else None
        for start in places:
            waiting.append((text_no, start, padded(codes, start), len(text) - start))
            if len(waiting) == group:
                flush()
    if waiting:
        flush()
    return [reconciled(base, own) if own else [] for base, own in zip(bases, found)]


SPAN = StructType([StructField("start", IntegerType(), False), StructField("end", IntegerType(), False), StructField("kind", StringType(), False), StructField("base", BooleanType(), False)])


def _examples(batches):
    for batch, texts in text_batches(batches):
        rows = [(h, *e) for h, text in zip(batch.column("h").to_pylist(), texts) for e in examples(text)]
        h, start, codes, tags = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(start, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([t.tobytes() for t in tags], pa.binary())],
                                         names=["h", "start", "codes", "tags"])


def fit(docs: DataFrame, key: str = "doc_id", sample: int = SAMPLE, longest: int = LONGEST) -> Tagger | None:
    """The tagger for ``docs``: from the windows of at most ``sample`` texts with a digit or ``@`` and up to ``longest`` characters.

    They are picked by hash of key and text. Texts stay on the executors; windows of fixed size come to the driver.
    """
    h = F.xxhash64(F.col(key).cast("string"), F.col("text")).alias("h")
    some = docs.where(F.col("text").rlike("[0-9@]") & (F.length("text") <= longest)).select(h, "text")
    picked = some.select("h").distinct().orderBy("h").limit(sample)
    rows = some.join(F.broadcast(picked), "h").mapInArrow(_examples, "h long, start int, codes binary, tags binary").dropDuplicates(["h", "start"])
    found = sorted((r.h, r.start, bytes(r.codes), bytes(r.tags)) for r in rows.collect())
    return train_on([(np.frombuffer(x, dtype=np.uint8), np.frombuffer(y, dtype=np.uint8)) for _, _, x, y in found])


def tag(docs: DataFrame, tagger: Tagger | None, to: str = "spans") -> DataFrame:
    """Adds ``to`` to all rows: spans (start, end, kind, base), by start, then kind as listed."""
    base = docs.drop(to)
    names, kind = base.columns, pa.list_(pa.struct([pa.field("start", pa.int32(), False), pa.field("end", pa.int32(), False), pa.field("kind", pa.string(), False), pa.field("base", pa.bool_(), False)]))

    def run(batches):
        for batch, texts in text_batches(batches):
            bases = list(map(base_spans, texts))
            rows = []
            for own, more in zip(bases, added_spans(texts, bases, tagger)):
                both = sorted([(*s, True) for s in own] + [(*s, False) for s in more], key=lambda s: (s[0], s[2]))
                rows.append([{"start": a, "end": b, "kind": KINDS[k], "base": is_base} for a, b, k, is_base in both])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(rows, kind)], names=[*names, to])

    return base.mapInArrow(run, StructType([*base.schema.fields, StructField(to, ArrayType(SPAN), False)]))


def masked(docs: DataFrame, spans: str = "spans") -> DataFrame:
    """``text`` with every span of column ``spans`` replaced by its kind in brackets; where spans overlap, the union is replaced."""
    base = docs.drop(spans)
    names, place = base.columns, base.columns.index("text")

    def run(batches):
        for batch, texts in text_batches(batches):
            out = []
            for text, own in zip(texts, batch.column(spans).to_pylist()):
                parts, at = [], 0
                for s in own:
                    if s["start"] >= at:
                        parts += [text[at : s["start"]], f"[{s['kind'].upper()}]"]
                    at = max(at, s["end"])
                out.append("".join([*parts, text[at:]]))
            whole = batch.column("text")
            arrays = [batch.column(c) for c in names]
            arrays[place] = pa.array([None if old is None else new for old, new in zip(whole.to_pylist(), out)], pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select(*names, spans).mapInArrow(run, base.schema)
