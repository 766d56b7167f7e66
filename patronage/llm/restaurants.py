"""Language model: hierarchical Pitman-Yor process over word pairs, its seating sampled by Gibbs.

Every word (and the end of a text, which also stands before the first word) is a context with a restaurant of its own: its
customers are the tokens that follow it in the training texts. All these restaurants share one parent, the restaurant of
the empty context, whose customers are their tables and whose own parent is uniform over the known words and one unknown.
What a dish (token) contributes depends on its customers c and its tables t only, so the sampler keeps t. A Gibbs step
draws t from its full conditional, ``S_d(c, t) P(w)^t`` times the rising product over the restaurant's other tables, where
S_d are the generalised Stirling numbers that count the seatings of c customers at t tables. Up to ``EXACT`` customers the
draw is exact, beyond it comes from the saddle point of the same law (a binomial, or a mixed Poisson, of its mean and variance), so a dish
with a billion customers costs no more than one with a hundred.

The dishes of one restaurant are drawn at once given the totals of the sweep before, and the parent is told after each
sweep: its tables are drawn from the new customers, and its probabilities go back. Discounts come from counts of counts;
predictive probabilities are averaged over the last draws.

How it is distributed. A text is cut to words once; ``chunks`` of about ``CHUNK`` tokens hold a dictionary and codes. A chunk
asks for its distinct words and its distinct pairs, once each however often they occur, so no common word gathers rows.
Words are counted and numbered in parts by checksum, pairs are merged to restaurants in parts by context; contexts with
more than ``HOT`` customers are split over several parts by the next word; their totals are summed like the parent's
customers and stay those of the sweep before. Answers are arrays in the order of the question. Every step ends in a written table.

Defined results: a null or empty text has one token, its end; a null key is never held out; repeated rows count and return
as often as they come; without training texts every probability is that of the uniform parent. Only the named columns are read.
"""
from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, StructField, StructType

from patronage.llm.shared import settle, text_batches

#: Tokens of a chunk; pairs of a part; bytes of text that are cut to words at once; customers from which a context is split.
CHUNK, PART, PIECE, HOT = 1 << 21, 1 << 21, 1 << 20, 1 << 20
#: Sweeps that end with the parent; draws of a sweep that are left out, and those that are averaged; strengths of a context and of the parent.
SWEEPS, BURN, DRAWS = 1, 2, 4
STRENGTH, PARENT_STRENGTH = 1.0, 1.0
#: Customers up to which a draw is exact.
EXACT = 32
#: Compression of arrays.
LEVEL = 5
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def pack(a: np.ndarray) -> bytes:
    """The array's bytes by significance, compressed: small numbers in wide types take little room."""
    raw = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()
    return squeeze(raw)


def pack_steps(a: np.ndarray) -> bytes:
    """Longs that mostly rise slowly, as packed steps."""
    d = np.diff(a, prepend=0)
    return pack((d << 1) ^ (d >> 63))


def unpack_steps(data: bytes) -> np.ndarray:
    z = unpack(data, np.int64)
    return np.cumsum((z >> 1) ^ -(z & 1))


def squeeze(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=LEVEL).compress(data, asbytes=True)


def words_of(data: bytes) -> list:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True).split(b" ")


def unpack(data: bytes, kind) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    raw = np.frombuffer(pa.decompress(data[8:], n, "zstd", asbytes=True), np.uint8)
    return raw.reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel() if n else np.zeros(0, kind)


# --- words -----------------------------------------------------------------------------------------------------------


def _cut(text: str):
    """(words, whether they are the last) of a text, about ``PIECE`` bytes at once, cut at white space."""
    data, at = text.encode().lower(), 0
    while True:
        gap = SPACE.search(data, at + PIECE) if len(data) - at > PIECE else None
        if gap is None:
            yield data[at:].split(), True
            return
        yield data[at : gap.start()].split(), False
        at = gap.start()


class _Codes(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


class _Book:
    """A chunk in the making: dictionary (the end of a text is the empty word 0), codes, and the pieces of texts in it."""

    def __init__(self):
        self.words, self.codes, self.pieces = _Codes({b"": 0}), [], []

    def add(self, row, key, held, before: bytes, words: list, last: bool):
        lead = self.words[before]
        self.codes.append(self.words.of([*words, b""] if last else words))
        self.pieces.append((row, key, held, len(words) + last, lead))

    def size(self) -> int:
        return sum(p[3] for p in self.pieces)


def _chunks(schema: pa.Schema):
    def run(batches):
        made = 0

        def told(book):
            codes = np.concatenate(book.codes)
            row, key, held, size, lead = map(list, zip(*book.pieces))
            known = np.repeat(~np.array(held), size)
            chunk = TaskContext.get().partitionId() * 2**32 + made
            marks = np.array([zlib.crc32(w) >> 8 for w in book.words], np.int32)
            values = [chunk, len(codes), int(known.sum()), squeeze(b" ".join(book.words)), pack(marks), pack(codes), row, key, held, size, lead]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)

        book, filled = _Book(), 0
        for batch, texts in text_batches(batches):
            for row, key, held, text in zip(*(batch.column(c).to_pylist() for c in ("row", "key", "held")), texts):
                before = b""
                for words, last in _cut(text):
                    book.add(row, key, held, before, words, last)
                    filled += len(words) + last
                    before = words[-1] if words else before
                    if filled >= CHUNK:
                        yield told(book)
                        made, book, filled = made + 1, _Book(), 0
        if book.pieces:
            yield told(book)

    return run


def _ask_words(parts: int):
    def run(batches):
        for batch in batches:
            for chunk, blob, marks, packed, held, sizes in zip(*(batch.column(c).to_pylist() for c in ("chunk", "words", "marks", "codes", "held", "sizes"))):
                words, codes = words_of(blob), unpack(packed, np.int32)
                counts = np.bincount(codes[np.repeat(~np.array(held), sizes)], minlength=len(words))
                share, rows = unpack(marks, np.int32) % parts, []
                order = np.argsort(share, kind="stable")
                ends = np.searchsorted(share[order], np.arange(parts + 1))
                for p in np.unique(share).tolist():
                    at = order[ends[p] : ends[p + 1]]
                    rows.append((p, chunk, squeeze(b" ".join([words[i] for i in at.tolist()])), pack(counts[at])))
                yield pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["part", "chunk", "words", "counts"])

    return run


ANSWER = pa.schema([("chunk", pa.int64()), ("part", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("known", pa.int64())])


def _count_words(parts: int):
    """Numbers words by falling count: number = rank * parts + part; words that training texts lack get -1."""

    def run(key, asked):
        part, asks = key[0].as_py(), sorted(zip(*(asked.column(c).to_pylist() for c in ("chunk", "words", "counts"))))
        code = _Codes()
        codes = [code.of(words_of(blob)) for _, blob, _ in asks]
        total = np.zeros(len(code), np.int64)
        for own, (_, _, counts) in zip(codes, asks):
            total[own] += unpack(counts, np.int64)  # the words of a chunk are distinct
        order = np.fromiter((c for _, c in sorted(code.items())), np.int64, len(code))
        named = order[np.argsort(-total[order], kind="stable")][: np.count_nonzero(total)]
        number = np.full(len(code), -1, np.int64)
        number[named] = np.arange(len(named)) * parts + part
        rows = [(chunk, part, 0, pack(number[own]), pack(total[own]), len(named)) for own, (chunk, _, _) in zip(codes, asks)]
        return pa.table([pa.array(list(v), f.type) for v, f in zip(zip(*rows), ANSWER)], schema=ANSWER)

    return run


# --- pairs -----------------------------------------------------------------------------------------------------------


class _Pairs:
    """The tokens of a chunk with their contexts, and the distinct pairs in the order in which they are asked for."""

    def __init__(self, chunk: dict, answers: list, parts: int):
        self.share = unpack(chunk["marks"], np.int32) % parts
        n_words = len(self.share)
        self.codes, sizes = unpack(chunk["codes"], np.int32), np.array(chunk["sizes"])
        starts = np.cumsum(sizes) - sizes
        self.before = np.concatenate([np.zeros(1, np.int32), self.codes[:-1]])
        self.before[starts[sizes > 0]] = np.array(chunk["leads"])[sizes > 0]
        self.train = np.repeat(~np.array(chunk["held"]), sizes)
        self.number, self.count = np.full(n_words, -1, np.int64), np.zeros(n_words, np.int64)
        for part, ids, counts in answers:
            own = self.share == part
            self.number[own], self.count[own] = unpack(ids, np.int64), unpack(counts, np.int64)
        key, of = np.unique(self.before * np.int64(n_words) + self.codes, return_inverse=True)
        self.of = of.astype(np.int32)
        del of
        n = np.bincount(self.of, weights=self.train, minlength=len(key)).astype(np.int64)
        u, w = key // n_words, key % n_words
        contexts = np.unique(u)
        contexts = contexts[self.number[contexts] >= 0]
        asked = np.flatnonzero((self.number[u] >= 0) & (self.number[w] >= 0))
        self.place = np.full(len(key), -1, np.int64)  # of a pair among the questions; then of a context alone
        self.alone = np.full(n_words, -1, np.int64)
        del key
        u, w = np.concatenate([u[asked], contexts]), np.concatenate([self.number[w[asked]], np.full(len(contexts), -1)])
        n = np.concatenate([n[asked], np.zeros(len(contexts), np.int64)])
        self.customers = self.count[u]
        salt = np.where(w >= 0, w, 0) % (1 + self.customers // HOT)
        u = self.number[u]
        part = ((u + salt * 1_000_003).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % parts
        order = np.argsort(u << 31 | w + 1) if max(u.max(initial=0), w.max(initial=0)) < 2**31 - 1 else np.lexsort((w, u))
        order = order[np.argsort(part[order].astype(np.uint16 if parts <= 2**16 else np.int64), kind="stable")]
        self.part, self.u, self.w, self.n, self.customers = part[order], u[order], w[order], n[order], self.customers[order]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        self.place[asked], self.alone[contexts] = back[: len(asked)], back[len(asked) :]


PAIRS = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("us", pa.binary()), ("customers", pa.binary()), ("k", pa.binary()), ("w", pa.binary()), ("n", pa.binary())])


def _starts(u: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]])) if len(u) else np.zeros(0, np.int64)


def _ask_pairs(parts: int):
    def run(key, chunks, answers):
        rows = []
        for chunk in chunks.to_pylist():
            p = _Pairs(chunk, list(zip(*(answers.column(c).to_pylist() for c in ("part", "a", "b")))), parts)
            ends = np.searchsorted(p.part, np.arange(parts + 1))
            for part in np.unique(p.part).tolist():
                own = slice(ends[part], ends[part + 1])
                u, first = p.u[own], _starts(p.u[own])
                rows.append((part, chunk["chunk"], pack(u[first]), pack(p.customers[own][first]), pack(np.diff(np.append(first, len(u)))), pack_steps(p.w[own]), pack(p.n[own])))
        return pa.table([pa.array(list(v), f.type) for v, f in zip(zip(*rows), PAIRS)] if rows else [pa.array([], f.type) for f in PAIRS], schema=PAIRS)

    return run


CELLS = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("us", pa.binary()), ("customers", pa.binary()), ("k", pa.binary()), ("w", pa.binary()), ("c", pa.binary()), ("ones", pa.int64()), ("twos", pa.int64()), ("at", pa.binary())])


def _merge_pairs(key, asked):
    """The restaurants of a part: contexts and customers, and the pairs of each with their customers, 0 for those that training texts lack.

    Every chunk gets a row of its own with the places of its questions in the list of all contexts, each followed by its pairs,
    so the questions need not be moved again for their answers.
    """
    parts = []
    for chunk, us, k, w, customers, n in sorted(zip(*(asked.column(c).to_pylist() for c in ("chunk", "us", "k", "w", "customers", "n")))):
        us = unpack(us, np.int64)
        parts.append((chunk, us, np.repeat(us, unpack(k, np.int64)), unpack_steps(w), unpack(customers, np.int64), unpack(n, np.int64)))
    us, first = np.unique(np.concatenate([p[1] for p in parts]), return_index=True)
    customers = np.concatenate([p[4] for p in parts])[first]
    u, w, n = (np.concatenate([p[i] for p in parts]) for i in (2, 3, 5))
    cell, of = np.unique(np.searchsorted(us, u) << 40 | w + 1, return_inverse=True)
    c = np.bincount(of, weights=n, minlength=len(cell)).astype(np.int64)
    pair = (cell & (2**40 - 1)) > 0
    place = np.cumsum(pair) + (cell >> 40)  # a context may be asked for alone in another part only
    cell, c = cell[pair], c[pair]
    k = np.bincount(cell >> 40, minlength=len(us))
    part, ends = key[0].as_py(), np.cumsum([len(p[2]) for p in parts])[:-1]
    rows = [(part, None, pack(us), pack(customers), pack(k), pack_steps((cell & (2**40 - 1)) - 1), pack(c), int((c == 1).sum()), int((c == 2).sum()), None)]
    rows += [(part, p[0], None, None, None, None, None, None, None, pack_steps(at)) for p, at in zip(parts, np.split(place[of], ends))]
    return _table(rows, CELLS)


# --- seating ---------------------------------------------------------------------------------------------------------


def stirling(d: float, most: int = EXACT) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: [c, t], seatings of c customers at t tables with discount d."""
    s = np.full((most + 1, most + 1), -np.inf)
    s[0, 0] = 0.0
    for c in range(most):
        for t in range(c + 1):
            if c > t * d and np.isfinite(s[c, t]):
                s[c + 1, t] = np.logaddexp(s[c + 1, t], s[c, t] + np.log(c - t * d))
            s[c + 1, t + 1] = np.logaddexp(s[c + 1, t + 1], s[c, t])
    return s


def draw_tables(c: np.ndarray, p: np.ndarray, others: np.ndarray, theta: float, d: float, numbers: np.ndarray, rng) -> np.ndarray:
    """Tables of dishes with c customers and parent probability p, given the other tables of their restaurants."""
    t = np.minimum(c, 1)
    for size in np.unique(c[(c > 1) & (c <= EXACT)]).tolist():
        at = np.flatnonzero(c == size)
        tables = np.arange(size)
        weight = np.cumsum(np.log(theta + d * (others[at][:, None] + tables)), axis=1) + np.outer(np.log(p[at]), tables + 1) + numbers[size, 1 : size + 1]
        share = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
        t[at] = 1 + (share < (rng.random(len(at)) * share[:, -1])[:, None]).sum(axis=1)
    at = np.flatnonzero(c > EXACT)
    if len(at):
        n, p, others = c[at].astype(float), p[at], others[at]
        low, high = np.full(len(at), -700.0), np.full(len(at), -1e-9)
        for _ in range(60):  # log y, where the tables' sizes fall off as (1 - y)^size and add up to c
            y = (low + high) / 2
            a = np.exp(np.log(n) + (1 - d) * y) / -np.expm1(y)
            over = a * (1 + p * np.expm1(d * y)) > (theta + d * others) * p
            low, high = np.where(over, low, y), np.where(over, y, high)
        y = np.exp(low)
        a = n * y ** (1 - d) / (1 - y)
        mean = np.maximum(a * -np.expm1(d * low) / d, 1e-12)
        spread = np.maximum(mean - n / (1 + (1 - y) * (1 - d) / y), 1e-9 * mean)
        spread = 1 / np.maximum(1 / spread - d / (theta + d * (others + mean)), 1e-3 / spread)
        q = np.clip(1 - spread / mean, 1e-9, 1 - 1e-9)
        more = np.where(spread < mean, rng.binomial(np.maximum(np.rint(mean / q), 1).astype(np.int64), q), rng.poisson(rng.gamma(mean / np.maximum(spread / mean - 1, 1e-9), np.maximum(spread / mean - 1, 1e-9))))
        t[at] = np.clip(1 + more, 1, c[at])
    return t


class _Part:
    """Restaurants of a part and what the parent has told them."""

    def __init__(self, cells: dict, told: list, law: dict):
        self.us, self.customers, k = (unpack(cells[x], np.int64) for x in ("us", "customers", "k"))
        self.w, self.c = unpack_steps(cells["w"]), unpack(cells["c"], np.int64)
        self.of = np.repeat(np.arange(len(self.us)), k)
        # places of contexts and pairs in the list of both, as the chunks know them
        self.size, self.alone, seen = len(self.us) + len(self.c), np.cumsum(k) - k + np.arange(len(k)), np.flatnonzero(self.c)
        self.place = seen + self.of[seen] + 1
        self.w, self.c, self.of = self.w[seen], self.c[seen], self.of[seen]
        self.words, self.word = np.unique(self.w, return_inverse=True)
        self.hot = np.flatnonzero(self.customers >= HOT)
        self.tables, self.law = np.ones(len(self.c), np.int64), law
        self.local = np.bincount(self.of, minlength=len(self.us))
        self.total = self.local.copy()
        if told:
            p, hot = np.zeros(len(self.words)), self.us[self.hot]
            for to, kind, values in told:
                if kind == 1:
                    p[self.words % law["parts"] == to] = unpack(values, np.float64)
                else:
                    self.total[self.hot[hot % law["parts"] == to]] = unpack(values, np.float64)
            self.p = ((p + law["rest"]) / law["all"])[self.word]

    def sweep(self, seed: int, draws: int):
        """Mean tables of each dish, and of each restaurant, over the last ``draws`` draws; the last draw stays."""
        law, rng, numbers = self.law, np.random.default_rng(seed), stirling(self.law["d"])
        many = np.flatnonzero(self.c > 1)
        sums, totals = np.zeros(len(self.c)), np.zeros(len(self.us))
        for step in range(BURN + draws):
            of, old = self.of[many], self.tables[many]
            self.tables[many] = draw_tables(self.c[many], self.p[many], np.maximum(self.total[of] - old, 0), STRENGTH, law["d"], numbers, rng)
            more = np.bincount(of, weights=self.tables[many] - old, minlength=len(self.us)).astype(np.int64)
            more[self.hot] = 0
            self.total = self.total + more
            if step >= BURN:
                sums, totals = sums + self.tables, totals + self.total
        return sums / draws, totals / draws

    def customers_of_parent(self):
        """(to, kind, ids, numbers): tables by word, and tables of the contexts that are split."""
        m = np.bincount(self.word, weights=self.tables, minlength=len(self.words)).astype(np.int64)
        own = np.bincount(self.of, weights=self.tables, minlength=len(self.us)).astype(np.int64)
        for kind, ids, n in ((1, self.words, m), (2, self.us[self.hot], own[self.hot])):
            to = ids % self.law["parts"]
            for k in np.unique(to).tolist():
                yield k, kind, pack(ids[to == k]), pack(n[to == k])


ASK = pa.schema([("to", pa.int64()), ("part", pa.int64()), ("kind", pa.int32()), ("ids", pa.binary()), ("m", pa.binary())])
TOLD = pa.schema([("part", pa.int64()), ("to", pa.int64()), ("kind", pa.int32()), ("values", pa.binary()), ("customers", pa.float64()), ("tables", pa.float64()), ("ones", pa.int64()), ("twos", pa.int64())])


def _asks(part: _Part, number: int) -> list:
    return [(to, number, kind, ids, m) for to, kind, ids, m in part.customers_of_parent()]


def _table(rows: list, schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(list(v), f.type) for v, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


def _first_customers(law: dict):
    """Every dish has one table at first."""

    def run(batches):
        for batch in batches:
            for cells in batch.to_pylist():
                yield from _table(_asks(_Part(cells, [], law), cells["part"]), ASK).to_batches()

    return run


def _parent(law: dict, seed: int):
    """A share of the empty context's restaurant: tables of each word, and answers ``m - d t`` in the order of the questions."""

    def run(key, asked):
        to, rows = key[0].as_py(), sorted(zip(*(asked.column(c).to_pylist() for c in ("kind", "part", "ids", "m"))))
        out = []
        for kind in (1, 2):
            own = [(part, unpack(ids, np.int64), unpack(m, np.int64)) for k, part, ids, m in rows if k == kind]
            if not own:
                continue
            ids, of = np.unique(np.concatenate([x for _, x, _ in own]), return_inverse=True)
            total = np.bincount(of, weights=np.concatenate([m for *_, m in own]), minlength=len(ids)).astype(np.int64)
            tables = np.zeros(len(ids))
            if kind == 1:
                rng, numbers, d = np.random.default_rng([seed, to]), stirling(law["parent_d"]), law["parent_d"]
                seated = np.minimum(total, 1)
                for _ in range(DRAWS):
                    seated = draw_tables(total, np.full(len(ids), 1 / (law["words"] + 1)), np.maximum(law["tables"] - seated, 0), PARENT_STRENGTH, d, numbers, rng)
                    tables = tables + seated / DRAWS
            values = total - (law["parent_d"] * tables if kind == 1 else 0)
            out += [(part, to, kind, pack(values[np.searchsorted(ids, x)].astype(np.float64)), None, None, None, None) for part, x, _ in own]
            if kind == 1:
                out.append((-1, to, 0, pack(ids), float(total.sum()), float(tables.sum()), int((total == 1).sum()), int((total == 2).sum())))
                out.append((-2, to, 0, pack(values), None, None, None, None))
        return _table(out, TOLD)

    return run


def _told(told: pa.Table) -> list:
    return sorted(zip(*(told.column(c).to_pylist() for c in ("to", "kind", "values"))))


def _sweep(law: dict, seed: int):
    def run(key, cells, told):
        out = []
        for row in cells.to_pylist():
            part = _Part(row, _told(told), law)
            part.sweep([seed, row["part"]], 1)
            out += _asks(part, row["part"])
        return _table(out, ASK)

    return run


def _answer(law: dict, seed: int):
    """``c - d t`` for every question's pairs, and the tables of the contexts alone, averaged over draws."""

    def run(key, asked, right):
        rows = right.to_pylist()
        cells = next(r for r in rows if r["c"] is not None)
        part = _Part(cells, sorted((r["to"], r["kind"], r["values"]) for r in rows if r["c"] is None), law)
        tables, totals = part.sweep([seed, cells["part"]], DRAWS)
        value, out = np.zeros(part.size, np.float32), []
        value[part.place], value[part.alone] = part.c - law["d"] * tables, totals
        for chunk, at in sorted(zip(asked.column("chunk").to_pylist(), asked.column("at").to_pylist())):
            out.append((chunk, cells["part"], 2, pack(value[unpack_steps(at)]), None, None))
        return _table(out, ANSWER)

    return run


def _words_of_parent(key, asked, told):
    """The parent's ``m - d t`` for the words of every chunk."""
    found = {r["part"]: r["values"] for r in told.to_pylist()}
    ids, values = (unpack(found[-1], np.int64), unpack(found[-2], np.float64)) if found else (np.zeros(0, np.int64), np.zeros(0))
    out = []
    for chunk, a in sorted(zip(asked.column("chunk").to_pylist(), asked.column("a").to_pylist())):
        x = unpack(a, np.int64)
        at = np.minimum(np.searchsorted(ids, x), max(len(ids) - 1, 0))
        value = np.where(ids[at] == x, values[at], 0.0) if len(ids) else np.zeros(len(x))
        out.append((chunk, key[0].as_py(), 1, pack(value), None, None))
    return _table(out, ANSWER)


def _score(law: dict, schema: pa.Schema):
    def run(key, chunks, answers):
        out = []
        given = list(zip(*(answers.column(c).to_pylist() for c in ("part", "kind", "a", "b"))))
        for chunk in chunks.to_pylist():
            p = _Pairs(chunk, [(part, a, b) for part, kind, a, b in given if kind == 0], law["parts"])
            parent, value = np.zeros(len(p.number)), np.zeros(len(p.u))
            p.u = p.w = p.n = p.train = None  # asked before; not needed for the answers
            for part, kind, a, _ in given:
                if kind == 1:
                    parent[p.share == part] = unpack(a, np.float64)
                elif kind == 2:
                    value[p.part == part] = unpack(a, np.float32)
            whole = STRENGTH + p.customers
            shared = (parent + law["rest"]) / law["all"]
            alone = np.where(p.alone >= 0, ((STRENGTH + law["d"] * value) / whole)[p.alone] if len(value) else 0.0, 1.0)
            pair = np.where(p.place >= 0, (value / whole)[p.place] if len(value) else 0.0, 0.0)
            single = np.log10((p.count + 0.1) / (law["tokens"] + 0.1 * (law["words"] + 1)))
            ends = np.cumsum(chunk["sizes"])
            own = []
            for a, b in zip((ends - np.array(chunk["sizes"])).tolist(), ends.tolist()):
                codes = p.codes[a:b]
                logs = np.log10(pair[p.of[a:b]] + alone[p.before[a:b]] * shared[codes])
                own.append((int((p.count[codes] > 0).sum()), float(single[codes].sum()), float(logs.sum())))
            out += list(zip(chunk["rows"], chunk["keys"], chunk["held"], chunk["sizes"], *zip(*own)))
        return _table(out, schema)

    return run


def held_out(key: str, folds: int = 10) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == 0, F.lit(False))


def score(docs: DataFrame, key: str, held: Column, text: str = "text", seed: int = 11) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score), one row a document; held-out texts are scored only."""
    kind = docs.schema[key].dataType
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), held.alias("held"), F.col(text).alias("text"))
    of_key = StructType([StructField("rows", ArrayType(numbered.schema["row"].dataType)), StructField("keys", ArrayType(kind)), StructField("held", ArrayType(BooleanType()))])
    from pyspark.sql.pandas.types import to_arrow_schema

    head = pa.schema([("chunk", pa.int64()), ("tokens", pa.int64()), ("train", pa.int64()), ("words", pa.binary()), ("marks", pa.binary()), ("codes", pa.binary())])
    schema = pa.schema([*head, *to_arrow_schema(of_key), ("sizes", pa.list_(pa.int64())), ("leads", pa.list_(pa.int32()))])
    chunks = settle(numbered.mapInArrow(_chunks(schema), StructType([*_spark(head).fields, *of_key.fields, *_spark(schema).fields[-2:]])))
    size = chunks.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("train"), F.lit(0)).alias("train")).first()
    parts = 1 + size.tokens // PART
    words = settle(chunks.select("chunk", "words", "marks", "codes", "held", "sizes").mapInArrow(_ask_words(parts), "part long, chunk long, words binary, counts binary").groupBy("part").applyInArrow(_count_words(parts), _spark(ANSWER)))
    known = words.groupBy("part").agg(F.max("known").alias("known")).agg(F.sum("known")).first()[0] or 0
    law = {"parts": parts, "tokens": size.train, "words": known}
    texts = chunks.select("chunk", "marks", "codes", "held", "sizes", "leads")
    asked = texts.groupBy("chunk").cogroup(words.select("chunk", "part", "a", "b").groupBy("chunk")).applyInArrow(_ask_pairs(parts), _spark(PAIRS))
    merged = settle(asked.groupBy("part").applyInArrow(_merge_pairs, _spark(CELLS)))
    cells = merged.where("chunk is null").drop("chunk", "at")
    rare = cells.agg(F.sum("ones").alias("ones"), F.sum("twos").alias("twos")).first()
    law["d"] = _discount(rare)
    requests, told = cells.mapInArrow(_first_customers(law), _spark(ASK)), None
    law |= {"parent_d": 0.5, "tables": known}
    for sweep in range(SWEEPS + 1):
        told = settle(requests.groupBy("to").applyInArrow(_parent(dict(law), seed + sweep), _spark(TOLD)))
        sums = told.where("part = -1").agg(F.sum("customers").alias("customers"), F.sum("tables").alias("tables"), F.sum("ones").alias("ones"), F.sum("twos").alias("twos")).first()
        law["rest"] = (PARENT_STRENGTH + law["parent_d"] * (sums.tables or 0.0)) / (known + 1)
        law["all"] = PARENT_STRENGTH + (sums.customers or 0.0)
        law["tables"] = sums.tables or 0.0
        if sweep < SWEEPS:
            answers = told.where("part >= 0").select("part", "to", "kind", "values")
            requests = cells.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(_sweep(dict(law), seed + 1000 + sweep), _spark(ASK))
            law["parent_d"] = _discount(sums)
    answers = told.where("part >= 0").select("part", "to", "kind", "values")
    both = cells.unionByName(answers, allowMissingColumns=True)
    of_pairs = merged.where("chunk is not null").select("part", "chunk", "at").groupBy("part").cogroup(both.groupBy("part")).applyInArrow(_answer(dict(law), seed + 2000), _spark(ANSWER))
    parent = told.where("part < 0").select(F.col("to"), "part", "values")
    of_words = words.select("chunk", F.col("part").alias("to"), "a").groupBy("to").cogroup(parent.groupBy("to")).applyInArrow(_words_of_parent, _spark(ANSWER))
    replies = words.unionByName(of_pairs).unionByName(of_words).select("chunk", "part", "kind", "a", "b")
    result = StructType([numbered.schema["row"], StructField("key", kind), *_spark(pa.schema([("held", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])).fields])
    pieces = chunks.drop("tokens", "train", "words").groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_score(dict(law), to_arrow_schema(result)), result)
    sums = [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]
    whole = pieces.groupBy("row").agg(F.first("key").alias("key"), F.first("held").alias("held"), *sums)
    return whole.select(F.col("key").alias(key), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(size.train).cast("long").alias("train_tokens"), "base_score", "score")


def _discount(counts) -> float:
    """The usual estimate from the numbers of things seen once and twice."""
    one, two = counts.ones or 0, counts.twos or 0
    return min(max(one / (one + 2 * two), 0.05), 0.95) if one and two else 0.5


def _spark(schema: pa.Schema) -> StructType:
    from pyspark.sql.pandas.types import from_arrow_schema

    return from_arrow_schema(schema)
