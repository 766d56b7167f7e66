"""Token counts by a compiled finite-state tokenizer.

Byte-pair encoding of a word has a property that makes it a deterministic transducer: the last token of each prefix's
encoding, with the encoding of what stands before that token, is the prefix's encoding, and a token may follow another
only if their pair encodes to the two. The state after a prefix is therefore the longest suffix that some token starts
with, and for each place in it the last token and the relative count. ``Transducer`` compiles states and transitions when
they are first met; a transition carries the change of the token count. At a word's end the transducer is back at its
start, so whole words act as one transition and are remembered.

A chunk of a text is a state map: what stands before its first space belongs to a word that began earlier, what stands
after its last one to a word that goes on. (head, count, tail) holds that map for every entry state, and maps compose
associatively, so chunks are counted in any order and place and combined by a pairwise scan. Texts above ``SPLIT``
characters are dealt out to many tasks this way.

Defined results: a null text counts as empty, with 0 bytes and 0 tokens; repeated rows are counted each; only the key
column and ``text`` are read. The special tokens' strings within a text count one token each, as the library's default is.
"""
from __future__ import annotations

import json
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from patronage.llm.shared import text_batches

#: Characters of a chunk; longer texts are split.
SPLIT = 1 << 16
#: States, pairs and words that one task remembers.
STATES, PAIRS, REMEMBERED = 250_000, 300_000, 400_000


class Transducer:
    """Counts the tokens of words. Symbols: a byte, or 256 + byte for the last one of a word."""

    def __init__(self, vocab: dict, merges: list, suffix: str):
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        symbol = {chr(b): chr(b) for b in plain} | {chr(256 + k): chr(b) for k, b in enumerate(others)}

        def own(token):
            ends = token.endswith(suffix) and token != suffix
            s = "".join(symbol[c] for c in (token[: -len(suffix)] if ends else token))
            return s[:-1] + chr(256 + ord(s[-1])) if ends else s

        self.ranks = {(own(a), own(b)): k for k, (a, b) in enumerate(merges)}
        # each token's last merge: its rank (-1 for a symbol) and its two parts
        self.made = {a + b: (k, a, b) for (a, b), k in reversed(self.ranks.items())}
        self.tokens = {t for t in map(own, vocab) if len(t) == 1 or t in self.made and self.whole(t)}
        self.starts = {t[:k] for t in self.tokens for k in range(1, len(t))}
        self.pairs: dict = {}
        self.reset()

    def whole(self, token: str) -> bool:
        """Whether a token's own symbols merge to it: its parts are tokens, and merge only in the end."""
        _, a, b = self.made[token]
        return all(len(t) == 1 or t in self.made for t in (a, b)) and self.joined(a, b, self.made[token][0])

    def joined(self, a: str, b: str, limit: float = float("inf")) -> bool:
        """Whether nothing merges across the border of two tokens before ``limit``.

        Merges are undone from the last one back. Before the last merge inside ``a`` its right part stood at the border,
        and a merge across is due if its rank is lower; at equal ranks the left one goes first, so for ``b`` also if equal.
        """
        while True:
            rank = self.ranks.get((a, b))
            if rank is not None and rank < limit:
                return False
            in_a, in_b = self.made[a] if len(a) > 1 else (-1,), self.made[b] if len(b) > 1 else (-1,)
            if in_a[0] > in_b[0]:
                limit, a = min(limit, in_a[0]), in_a[2]
            elif in_b[0] >= 0:
                limit, b = min(limit, in_b[0] + 1), in_b[1]
            else:
                return True

    def reset(self):
        self.states, self.known, self.steps = [("", ("",), (0,))], {("", ("",), (0,)): 0}, {}

    def follows(self, a: str, b: str) -> bool:
        if not a:
            return True
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self.joined(a, b)
        return known

    def compile(self, state: tuple, c: str) -> tuple:
        """(next state, change of the count) when ``c`` is read."""
        suffix, last, counts = state
        for k in range(len(suffix) + 1):
            token = suffix[k:] + c
            if token in self.tokens and self.follows(last[k], token):
                break
        else:
            raise ValueError("a byte has no token")
        change = counts[k] + 1
        longer, last, counts = suffix + c, (*last, token), (*(n - change for n in counts), 0)
        k = 0
        while k < len(longer) and longer[k:] not in self.starts:
            k += 1
        return (longer[k:], last[k:], counts[k:]), change

    def count(self, word: bytes) -> int:
        symbols = word[:-1].decode("latin-1") + chr(256 + word[-1])
        if len(self.states) > STATES:
            self.reset()
        at = total = 0
        for c in symbols:
            step = self.steps.get((at, c))
            if step is None:
                state, change = self.compile(self.states[at], c)
                to = self.known.get(state)
                if to is None:
                    to = self.known[state] = len(self.states)
                    self.states.append(state)
                step = self.steps[at, c] = (to, change)
            at = step[0]
            total += step[1]
        return total


class Tokenizer(dict):
    """Token counts of texts for a tokenizer file; as a dict, the counts of remembered words."""

    WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
    #: The parts of a tokenizer file that this class implements.
    NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
    SPLITTER = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, words = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        if model["type"] != "BPE" or spec["normalizer"]["normalizers"] != self.NORMALIZER or words[0]["pattern"]["Regex"] != self.SPLITTER or words[1]["type"] != "ByteLevel":
            raise ValueError("not a tokenizer of the kind that this operator compiles")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.transducer = Transducer(model["vocab"], merges, model["end_of_word_suffix"])
        specials = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.marks = specials

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self[word] = self.transducer.count(word.encode())
        return n

    def count(self, text: str) -> int:
        if any(m in text for m in self.marks):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(map(self.plain, parts))
        return self.plain(text)

    def plain(self, text: str) -> int:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # one character at a time, so without the final form
        return sum(map(self.__getitem__, self.WORDS.findall(text.lower())))

    # state maps of chunks
    def state_map(self, chunk: str) -> tuple:
        """(head, count, tail); without a space in the chunk, (chunk, None, '')."""
        places = [p for p in (chunk.find(" "), chunk.find("\n")) if p >= 0]
        if not places:
            return chunk, None, ""
        a, b = min(places), max(chunk.rfind(" "), chunk.rfind("\n"))
        return chunk[:a], self.count(chunk[a:b]), chunk[b:]

    def compose(self, x: tuple, y: tuple) -> tuple:
        if x[1] is None:
            return x[0] + y[0], y[1], y[2]
        if y[1] is None:
            return x[0], x[1], x[2] + y[0]
        return x[0], x[1] + self.count(x[2] + y[0]) + y[1], y[2]

    def total(self, maps: list) -> int:
        """The count of the text whose chunks have these maps."""
        while len(maps) > 1:
            maps = [self.compose(*maps[k : k + 2]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
        head, n, tail = maps[0]
        return self.count(head) + (n or 0) + self.count(tail)


def _counted(path: str):
    def run(batches):
        tokenizer = Tokenizer(path)
        for batch, texts in text_batches(batches):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "n_bytes")), pa.array(map(tokenizer.count, texts), pa.int64())], names=["key", "n_bytes", "n_tokens"])

    return run


def _mapped(path: str):
    def run(batches):
        tokenizer = Tokenizer(path)
        for batch, chunks in text_batches(batches):
            heads, counts, tails = zip(*map(tokenizer.state_map, chunks), strict=True)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "key", "n_bytes", "pos")), pa.array(heads, pa.string()), pa.array(counts, pa.int64()), pa.array(tails, pa.string())],
                                             names=["row", "key", "n_bytes", "pos", "head", "n", "tail"])

    return run


def _composed(path: str):
    def run(batches):
        tokenizer = Tokenizer(path)
        for batch in batches:
            totals = [tokenizer.total([(m["head"], m["n"], m["tail"]) for m in maps]) for maps in batch.column("maps").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "n_bytes")), pa.array(totals, pa.int64())], names=["key", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, key: str, path: str, split: int = SPLIT) -> DataFrame:
    """(``key``, n_bytes, n_tokens) for each row's ``text``.

    Short texts are counted where they are read, without a shuffle. A long text becomes chunk rows that any task may map;
    only their maps, a few characters each, meet again.
    """
    kind = docs.schema[key].dataType.simpleString()
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    short = rows.where(F.length("text") <= split).mapInArrow(_counted(path), f"key {kind}, n_bytes long, n_tokens long")
    places = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / split).cast("int"))
    chunks = rows.where(F.length("text") > split).withColumn("row", F.monotonically_increasing_id()).select(
        "row", "key", "n_bytes", F.posexplode(F.transform(places, lambda k: F.substring("text", k * split + 1, F.lit(split)))).alias("pos", "text"))
    maps = chunks.mapInArrow(_mapped(path), f"row long, key {kind}, n_bytes long, pos int, head string, n long, tail string")
    grouped = maps.groupBy("row", "key", "n_bytes").agg(F.sort_array(F.collect_list(F.struct("pos", "head", "n", "tail"))).alias("maps"))
    long = grouped.mapInArrow(_composed(path), f"key {kind}, n_bytes long, n_tokens long")
    return short.unionByName(long).withColumnRenamed("key", key)
