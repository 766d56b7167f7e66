"""SentencePiece encoding with seeded merge-dropout, and decoding.

The vocabulary is that of a trained BPE model file (never trained here). The encoder works off an agenda of candidate
merges, best score first and leftmost among equals, as the library does; with dropout, a candidate that comes up is
skipped when a hash of (seed, text, place of the unit in the text, place in the unit, piece) falls below the rate, so every
occurrence of a word is decided anew. Without dropout the pieces equal the library's, but for the character U+2581 within a
text, which is kept by byte pieces so that decoding is always lossless.

No piece of such a model crosses from a word into the white space or the signs beside it (checked when the model is read),
so these units are encoded independently: numpy merges all units of a batch together, a candidate of each at a time, and
nothing is remembered from one occurrence to the next; units of over ``WIDE`` characters are merged one by one. Results
depend on seed and text only, not on partitions or batches.

Defined results: a null or empty text has no pieces and decodes to an empty text; repeated rows get equal pieces; texts
of any length are encoded whole; other columns pass through unchanged, except an own ``ids`` column, which is replaced.
"""
from __future__ import annotations

import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from patronage.llm.shared import text_batches

RATE = 0.1
#: Units of up to so many characters are merged together, in tables of the next of these widths.
WIDTHS = (*range(2, 13), 16, 20, 24, 32, 48, 64)
WIDE = WIDTHS[-1]
MASK = (1 << 64) - 1
PLACE, PIECE, SPREAD = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93
#: Latin letters with the white space before them, line ends, other runs: units that no piece crosses.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
UNIT = re.compile(f"▁*[{LETTERS}]+|\n|▁+[^▁\n{LETTERS}]*|[^▁\n{LETTERS}]+")


class Model:
    """Pieces, scores and byte pieces of a model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        kinds = proto.SentencePiece
        if proto.trainer_spec.model_type != 2 or proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces or not proto.normalizer_spec.add_dummy_prefix:
            raise ValueError("a BPE model that leaves texts as they are, with a leading space, is needed")
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        self.scores = [p.score for p in proto.pieces]
        if any(len(UNIT.findall(p)) > 1 for p in self.ids):
            raise ValueError("a piece crosses the border of two units")
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        if len(self.bytes) != 256:
            raise ValueError("byte pieces are missing")
        self.surface = [b""] * len(proto.pieces)
        for piece, i in self.ids.items():
            self.surface[i] = piece.replace("▁", " ").encode()
        for b, i in self.bytes.items():
            self.surface[i] = bytes([b])


class Pairs:
    """The piece that two neighbouring symbols make, for arrays of them.

    A symbol is a piece id, or for a character that is no piece ``base`` and its code point. Pairs stand in an open hash table.
    """

    BITS = 20

    def __init__(self, model: Model):
        ids, base = model.ids, len(model.scores)
        self.base, self.chars = base, np.arange(base, base + 0x110000, dtype=np.int32)
        for piece, i in ids.items():
            if len(piece) == 1:
                self.chars[ord(piece)] = i
        named = lambda x: ids.get(x, base + ord(x) if len(x) == 1 else -1)
        rows = np.array([(named(p[:k]), named(p[k:]), i) for p, i in ids.items() for k in range(1, len(p))], dtype=np.int64).reshape(-1, 3)
        rows = rows[(rows[:, :2] >= 0).all(axis=1)]
        self.bits = max(self.BITS, int(len(rows)).bit_length() + 1)
        self.keys, self.made = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        keys, made = rows[:, 0] << 21 | rows[:, 1], rows[:, 2]
        slots = self.slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slots] < 0)
            _, first = np.unique(slots[free], return_index=True)
            put = free[first]
            self.keys[slots[put]], self.made[slots[put]] = keys[put], made[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            keys, made, slots = keys[rest], made[rest], slots[rest] + 1 & (1 << self.bits) - 1

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(PLACE) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Piece ids, -1 where two symbols make none."""
        keys = left.astype(np.int64) << 21 | right
        slots = self.slot(keys)
        there, found = self.keys[slots], self.made[slots]
        on = np.flatnonzero((there != keys) & (there >= 0))
        found[on] = -1
        while on.size:
            slots[on] = slots[on] + 1 & (1 << self.bits) - 1
            there = self.keys[slots[on]]
            hit = there == keys[on]
            found[on[hit]] = self.made[slots[on[hit]]]
            on = on[~hit & (there >= 0)]
        return found


class Words:
    """Pieces of units; ``key`` stands for the hashes of one occurrence, the seed's by default."""

    def __init__(self, model: Model, rate: float, seed: int):
        self.model, self.limit, self.key = model, int(rate * (1 << 24)), xxhash.xxh64_intdigest(str(seed))
        self.pairs = Pairs(model)
        self.scores = np.array([*model.scores, -np.inf], dtype=np.float32)
        self.bytes = np.array([model.bytes[b] for b in range(256)], dtype=np.int32)

    def __getitem__(self, word: str) -> bytes:
        return array("i", self.pieces(word)).tobytes()

    def merge(self, symbols: np.ndarray, keys: np.ndarray) -> None:
        """Merges each row of symbols by its key; a symbol that went into the one before it becomes -1."""
        n, width = symbols.shape
        pairs, scores = self.pairs, self.scores
        found = np.full((n, width), -1, np.int32)
        found[:, :-1] = pairs.find(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(n, width - 1)
        rank = scores[found]
        # flat places of the neighbours, -1 where there is none
        after = np.arange(1, n * width + 1).reshape(n, width)
        before = after - 2
        after[:, -1] = before[:, 0] = -1
        flat, found, after, before, ranks = symbols.reshape(-1), found.reshape(-1), after.reshape(-1), before.reshape(-1), rank.reshape(-1)
        live = np.arange(n)
        while live.size:
            k = (rank if len(live) == n else rank[live]).argmax(axis=1)
            at = live * width + k
            on = np.flatnonzero(ranks[at] > -np.inf)
            live, k, at = live[on], k[on].astype(np.uint64), at[on]
            made = found[at]
            told = k * np.uint64(PLACE) ^ made.astype(np.uint64) * np.uint64(PIECE)
            dropped = (keys[live] ^ told) * np.uint64(SPREAD) >> np.uint64(40) < np.uint64(self.limit)
            ranks[at[dropped]] = -np.inf
            at, made = at[~dropped], made[~dropped]
            gone = after[at]
            right, left = after[gone], before[at]
            flat[at], flat[gone], ranks[gone], ranks[at], after[at] = made, -1, -np.inf, -np.inf, right
            has = np.flatnonzero(right >= 0)
            before[right[has]] = at[has]
            found[at[has]] = new = pairs.find(made[has], flat[right[has]])
            ranks[at[has]] = scores[new]
            has = np.flatnonzero(left >= 0)
            found[left[has]] = new = pairs.find(flat[left[has]], made[has])
            ranks[left[has]] = scores[new]

    def pieces(self, word: str, key: int | None = None) -> list:
        ids, scores, limit = self.model.ids, self.model.scores, self.limit
        key = self.key if key is None else key
        if len(word) > 200:
            return self.long(word, key)
        parts, places = list(word), list(range(len(word)))
        found = [ids.get(a + b) for a, b in zip(parts, parts[1:])]
        rank = [-3e38 if i is None else scores[i] for i in found]
        while rank:
            best = max(rank)
            if best == -3e38:
                break
            k = rank.index(best)
            if ((key ^ (places[k] * PLACE ^ found[k] * PIECE) & MASK) * SPREAD & MASK) >> 40 < limit:
                rank[k] = -3e38
                continue
            parts[k] += parts[k + 1]
            del parts[k + 1], places[k + 1], found[k], rank[k]
            for j in (k - 1, k):
                if 0 <= j < len(rank):
                    i = found[j] = ids.get(parts[j] + parts[j + 1])
                    rank[j] = -3e38 if i is None else scores[i]
        return self.named(parts)

    def long(self, word: str, key: int | None = None) -> list:
        """The same with a heap and links, for words that a scan per merge would make slow."""
        from heapq import heapify, heappop, heappush

        ids, scores, limit = self.model.ids, self.model.scores, self.limit
        key, n = self.key if key is None else key, len(word)
        parts, after, before = list(word), [*range(1, n), -1], list(range(-1, n - 1))
        agenda = [(-scores[i], k, len(word[k : k + 2]), i) for k in range(n - 1) if (i := ids.get(word[k : k + 2])) is not None]
        heapify(agenda)

        def offer(a, b):
            if a >= 0 and b >= 0 and (i := ids.get(parts[a] + parts[b])) is not None:
                heappush(agenda, (-scores[i], a, len(parts[a]) + len(parts[b]), i))

        while agenda:
            _, a, size, i = heappop(agenda)
            b = after[a]
            if not parts[a] or b < 0 or len(parts[a]) + len(parts[b]) != size or ids.get(parts[a] + parts[b]) != i:
                continue
            if ((key ^ (a * PLACE ^ i * PIECE) & MASK) * SPREAD & MASK) >> 40 < limit:
                continue
            parts[a] += parts[b]
            parts[b], after[a] = "", after[b]
            if after[b] >= 0:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return self.named(p for p in parts if p)

    def named(self, parts) -> list:
        ids, fallback = self.model.ids, self.model.bytes
        return list(chain.from_iterable((ids[p],) if p in ids else (fallback[b] for b in p.encode()) for p in parts))


class Encoder:
    def __init__(self, path: str, rate: float = RATE, seed: int = 0):
        self.model = Model(path)
        self.words = [Words(self.model, rate, seed)]

    def encode(self, text: str) -> bytes:
        """Piece ids as packed 32-bit numbers."""
        return self.encode_all([text])[0].tobytes()

    def encode_all(self, texts: list) -> tuple:
        """(piece ids of all texts, number of ids by text)."""
        words, = self.words
        base = words.pairs.base
        units, counts, signs = [], [], []
        for text in texts:
            before = len(units)
            if text:
                head, *rest = text.split("▁")
                units += UNIT.findall("▁" + head.replace(" ", "▁"))
                for x in rest:
                    signs.append(len(units))
                    units.append("▁")
                    units += UNIT.findall(x.replace(" ", "▁"))
            counts.append(len(units) - before)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        starts = np.cumsum(sizes) - sizes
        codes = np.frombuffer("".join(units).encode("utf-32-le"), dtype=np.uint32)
        symbols = words.pairs.chars[codes]
        symbols[starts[signs]] = base + ord("▁")  # the sign itself: bytes
        counts = np.array(counts, dtype=np.int64)
        first = np.array([xxhash.xxh64_intdigest(x) ^ words.key for x in texts], dtype=np.uint64)
        place = np.arange(len(units)) - np.repeat(np.cumsum(counts) - counts, counts)
        keys = mixed(np.repeat(first, counts) + place.astype(np.uint64) * np.uint64(PLACE))
        least = 1
        for width in WIDTHS:
            rows = np.flatnonzero((sizes > least) & (sizes <= width))
            least = width
            if rows.size:
                at = starts[rows, None] + np.arange(width)
                inside = np.arange(width) < sizes[rows, None]
                block = np.where(inside, symbols[np.minimum(at, len(symbols) - 1)], np.int32(base + 0x110000))
                words.merge(block, keys[rows])
                symbols[at[inside]] = block[inside]
        wide = np.flatnonzero(sizes > WIDE).tolist()
        alone = {int(starts[k]): array("i", words.pieces(units[k], int(keys[k]))) for k in wide}
        for k in wide:
            symbols[starts[k] : starts[k] + sizes[k]] = -1
            symbols[starts[k]] = 0  # its ids stand at its start
        kept = np.flatnonzero(symbols >= 0)
        points = symbols[kept].astype(np.int64) - base
        long = np.where(points < 0, 1, 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))
        long[np.searchsorted(kept, list(alone))] = list(map(len, alone.values()))
        to = np.cumsum(long) - long
        ids = np.repeat(symbols[kept], long)
        for n in (1, 2, 3, 4):  # characters that are no piece: their UTF-8 bytes
            odd = np.flatnonzero((points >= 0) & (long == n))
            for j in range(n):
                part = points[odd] >> 6 * (n - 1 - j)
                ids[to[odd] + j] = words.bytes[part if n == 1 else part | (0, 0xC0, 0xE0, 0xF0)[n - 1] if j == 0 else part & 0x3F | 0x80]
        for at, own in alone.items():
            k = to[np.searchsorted(kept, at)]
            ids[k : k + len(own)] = own
        sums = np.concatenate([[0], np.cumsum(np.bincount(kept, long, len(symbols)).astype(np.int64))])
        ends = sums[np.append(starts, len(symbols))][np.cumsum(counts)]
        return ids, np.diff(ends, prepend=0)


def mixed(x: np.ndarray) -> np.ndarray:
    """Each number as a hash of itself."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _replaced(schema: StructType, name: str, kind) -> StructType:
    return StructType([*(f for f in schema if f.name != name), StructField(name, kind, False)])


def encode(docs: DataFrame, path: str, rate: float = RATE, seed: int = 0) -> DataFrame:
    """Adds ``ids``, the piece ids of ``text``."""
    schema = _replaced(docs.schema, "ids", ArrayType(IntegerType(), False))
    names = schema.names[:-1]

    def run(batches):
        encoder = Encoder(path, rate, seed)
        for batch, texts in text_batches(batches):
            packed, sizes = encoder.encode_all(texts)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            values = pa.array(packed)
            ids = pa.ListArray.from_arrays(pa.array(ends), values, type=pa.list_(pa.field("element", pa.int32(), False)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), ids], names=[*names, "ids"])

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded``, the text that ``ids`` stand for; the round trip is exact."""
    schema = _replaced(encoded.schema, "decoded", StringType())
    names = schema.names[:-1]

    def run(batches):
        surface = Model(path).surface
        for whole in batches:
            for a in range(0, whole.num_rows, 500):
                batch = whole.slice(a, 500)
                column = batch.column("ids")
                flat, offsets = column.flatten().to_numpy(), column.offsets.to_numpy()
                offsets = offsets - offsets[0]
                texts = [b"".join(map(surface.__getitem__, flat[i:j].tolist()))[1:].decode() for i, j in zip(offsets, offsets[1:])]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string())], names=[*names, "decoded"])

    return encoded.mapInArrow(run, schema)
