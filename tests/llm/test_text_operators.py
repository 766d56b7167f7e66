"""Chat formatting, token counts, pieces, quality, personal data: against brute force, libraries and exact round trips."""
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer as Library

from patronage.llm import chat, pieces, pii, quality, tokens
from patronage.llm.queries import QUERIES

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


def texts_of(spark, folder, n=150):
    return [r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("text").limit(n).collect()]


# ---- chat formatting

@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "", "a[/ROLE]\\"]),
                          st.lists(st.sampled_from(["</s>", "<s>", "[INST]", " [/INST]", "\\", "[", "<", "x", " ", "\n", "é", "[/TURN]", "<<SYS>>"]), max_size=8).map("".join)), max_size=6))
@settings(max_examples=300, deadline=None)
def test_formatted_text_reads_back(turns):
    import pyarrow as pa
    template = chat.ChatTemplate()
    batch = pa.RecordBatch.from_arrays([pa.array([1] * len(turns), pa.int64()), pa.array([r for r, _ in turns], pa.string()), pa.array([t for _, t in turns], pa.string())], names=["conv_id", "role", "text"])
    segments = [row for b in chat._format(template)([batch]) for row in b.to_pylist()]
    whole = chat.Scanner(template)
    assert whole.feed("".join(s["text"] for s in segments)) == turns and not whole.rest
    assert "".join(chat.unescape(s["text"]) for s in segments if s["loss"]) == "".join(t for r, t in turns if r == "assistant")


def test_chat_edges(spark):
    rows = [(1, 2, "assistant", None, "x"), (1, 1, "user", "q", "x"), (None, None, None, None, "x"), (2, 1, "assistant", "early", "x"), (2, 1, "assistant", "early", "x"), (3, 0, "tool", "t", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(df)).collect()}
    assert {c: (r.n_turns, r.valid) for c, r in got.items()} == {1: (2, True), None: (1, False), 2: (2, False), 3: (1, False)}
    assert got[1].turns_sha256 == hashlib.sha256(b"user\nq\nassistant\n\n").hexdigest() and got[2].loss_chars == 10
    assert chat.read_back(chat.format_chats(df.where("false"))).count() == 0
    with pytest.raises(ValueError):
        chat.ChatTemplate(turns={"user": ("<u>", "<u>x", False)})


# ---- token counts

def test_counts_equal_the_library(spark, folder):
    own, library = tokens.Tokenizer(WORDS), Library.from_file(WORDS)
    r = random.Random(1)
    pool = ["<|endoftext|>", "<|start", "Σ", "é", "ẛ̣", "\u0085", " ", "'s", "'LL", "12", "½", "!!'s", "漢", "😀", " ", "\n", "İ", "ǅ", "ß", "\x00", "ab"]
    odd = ["".join(r.choice(pool) for _ in range(r.randint(0, 30))) for _ in range(1500)] + ["q" * 3000]
    some = texts_of(spark, folder) + odd
    assert [own.count(t) for t in some] == [len(e.ids) for e in library.encode_batch(some, add_special_tokens=False)]


def test_chunk_maps_compose(spark, folder):
    own, r = tokens.Tokenizer(WORDS), random.Random(2)
    for text in [*texts_of(spark, folder, 12), "nospace" * 50, "", " "]:
        cuts = sorted(r.randint(0, len(text)) for _ in range(9))
        maps = [own.state_map(text[a:b]) for a, b in zip([0, *cuts], [*cuts, len(text)])]
        assert own.total(maps) == own.count(text)
        left = maps[0]
        for m in maps[1:]:
            left = own.compose(left, m)
        assert own.total([left]) == own.count(text)


def test_token_counts_edges(spark, odd_docs):
    library = Library.from_file(WORDS)
    want = sorted((r.doc_id or 0, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in odd_docs.collect())
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in tokens.token_counts(odd_docs, "doc_id", WORDS, split=1000).collect())
    assert got == want
    assert tokens.token_counts(odd_docs.where("false"), "doc_id", WORDS).count() == 0


# ---- pieces

def test_pieces_equal_the_library_without_dropout(spark, folder):
    own, library = pieces.Encoder(PIECES, rate=0.0), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for t in [t for t in texts_of(spark, folder, 60) if t] + ["a  b\n\n c", "漢字\x00é", "x" * 500]:
        assert np.frombuffer(own.encode(t), dtype=np.int32).tolist() == library.encode(t)


def test_dropout_is_seeded_varied_and_lossless(spark, folder):
    some = [t for t in texts_of(spark, folder, 30) if t] + ["▁a ▁▁ b▁", " ", "\n"]
    one, two, again = pieces.Encoder(PIECES, seed=1), pieces.Encoder(PIECES, seed=2), pieces.Encoder(PIECES, seed=1)
    surface = one.model.surface
    back = lambda packed: b"".join(surface[i] for i in np.frombuffer(packed, dtype=np.int32))[1:].decode()
    assert all(back(e.encode(t)) == t for e in (one, two) for t in some)
    assert [one.encode(t) for t in some] == [again.encode(t) for t in some] != [two.encode(t) for t in some]
    unit = "▁thonanatheringwhshth"
    assert len({v[unit] for s in range(8) for v in pieces.Encoder(PIECES, seed=s, rate=0.3).words}) > 3
    long = "▁" + "thonanathering" * 13
    assert all(w.long(long) == w.pieces(long) for w in one.words)


def test_dropout_decides_every_occurrence(spark, folder):
    encoder, unit, n = pieces.Encoder(PIECES, seed=4), "▁thonanathering", 4000
    surface, words = encoder.model.surface, encoder.words[0]
    ids, ways, at = np.frombuffer(encoder.encode(" ".join([unit[1:]] * n)), dtype=np.int32).tolist(), [], 0
    while at < len(ids):
        b = at + 1
        while b"".join(map(surface.__getitem__, ids[at:b])) != unit.replace("▁", " ").encode():
            b += 1
        ways.append(tuple(ids[at:b]))
        at = b
    assert len(ways) == n and len(set(ways)) > 20
    # a way by the dropped occurrences alone, one by one
    plain = tuple(pieces.Encoder(PIECES, rate=0.0).words[0].pieces(unit))
    one_by_one = [tuple(words.pieces(unit, int(k))) for k in pieces.mixed(np.arange(1, n + 1, dtype=np.uint64))]
    shares = [x.count(plain) / n for x in (ways, one_by_one)]
    assert 0.1 < shares[0] < 0.9 and abs(shares[0] - shares[1]) < 0.06


def test_dropout_is_the_same_in_batches_and_one_by_one(spark, folder, monkeypatch):
    texts = [t for t in texts_of(spark, folder, 30) if t] + ["▁a ▁▁ b▁", "", "漢字\x00é " * 40, "-" * 90 + " x", "x" * 500]
    together, sizes = pieces.Encoder(PIECES, seed=4).encode_all(texts)
    alone = [pieces.Encoder(PIECES, seed=4).encode(t) for t in texts]
    assert b"".join(alone) == together.tobytes() and [len(x) // 4 for x in alone] == sizes.tolist()
    monkeypatch.setattr(pieces, "WIDTHS", ())
    monkeypatch.setattr(pieces, "WIDE", 1)
    assert pieces.Encoder(PIECES, seed=4).encode_all(texts)[0].tolist() == together.tolist()


def test_pieces_edges(spark, odd_docs):
    got = pieces.decode(pieces.encode(odd_docs, PIECES), PIECES).collect()
    assert len(got) == odd_docs.count() and all(r.decoded == (r.text or "") for r in got) and got[0].score == "own score"
    assert pieces.encode(odd_docs.where("false"), PIECES).count() == 0


# ---- quality

def test_marginals_equal_brute_force():
    r = np.random.default_rng(3)
    counts = np.array([3, 1, 5])
    s, t = r.normal(size=9), r.normal(size=(2, 2))
    f, b = quality.Chains(counts).run(s, t)
    for a, n in zip([0, 3, 4], counts):
        total = {0: np.zeros(n), 1: np.zeros(n)}
        for code in range(1 << n):
            y = [(code >> k) & 1 for k in range(n)]
            w = np.exp(sum(s[a + k] for k in range(n) if y[k]) + sum(t[y[k], y[k + 1]] for k in range(n - 1)))
            for k in range(n):
                total[y[k]][k] += w
        odds = f[a : a + n, 1] + b[a : a + n, 1] - f[a : a + n, 0] - b[a : a + n, 0]
        assert np.allclose(np.exp(odds), total[1] / total[0])


def test_quality_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    rows = QUERIES["op5_quality"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 50 and np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_quality_edges(spark, odd_docs):
    labels = spark.createDataFrame([(1, 1), (1, 1), (7, 0), (None, 0), (9, None), (8, 0), (5, 1)], "doc_id long, quality int")
    got = quality.score(odd_docs, quality.fit(odd_docs, labels), "own_score").collect()
    assert len(got) == odd_docs.count() and all(0 <= r.own_score <= 1 for r in got) and got[0].score == "own score"
    assert len({r.own_score for r in got if r.doc_id == 5}) == 1 and len({r.own_score for r in got if not r.text}) == 1
    assert quality.fit(odd_docs, labels.where("false")) == {"share": 1.0}
    assert quality.score(odd_docs.where("false"), {"share": 1.0}).count() == 0


# ---- personal data

def brute(x):
    found = [(*m.span(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    found += [(*m.span(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and pii.luhn(d):
            found.append((*m.span(), 2))
    found += [(*m.span(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], s[2]))


def test_base_spans_equal_the_patterns(spark, folder):
    r = random.Random(4)
    pool = [*"aZ9.@-+ ()1234567890%_é\n٣", "1.2.3.4", "a@b.c", "4111 1111 1111 1111", "+1 (706) 555-3138", "..", "@@", "0000300"]
    odd = ["".join(r.choice(pool) for _ in range(r.randint(0, 60))) for _ in range(5000)]
    for x in texts_of(spark, folder, 200) + odd:
        assert pii.base_spans(x) == brute(x)


def test_base_spans_are_linear():
    assert pii.base_spans("1" * 200_000) == [] and pii.base_spans("a" * 200_000) == [] and pii.base_spans("+1 " * 50_000) == []


def test_gradients_of_the_tagger():
    r = np.random.default_rng(1)
    tagger = pii.Tagger(hidden=3)
    x, y = r.integers(0, pii.CLASSES, (2, 6)), r.integers(0, pii.TAGS, (2, 6))

    def loss():
        e = tagger.emissions(x)[0]
        z = pii._lse(tagger.lattice(e)[0][:, -1], 1)
        gold = sum(e[i, k, y[i, k]] for i in range(2) for k in range(6)) + sum(tagger.p["t"][y[i, k], y[i, k + 1]] for i in range(2) for k in range(5))
        return (z.sum() - gold) / 2

    for name, grad in tagger.gradients(x, y).items():
        p = tagger.p[name].reshape(-1)
        for k in r.integers(0, p.size, 4):
            old = p[k]
            p[k] = old + 1e-5
            up = loss()
            p[k] = old - 1e-5
            down = loss()
            p[k] = old
            assert abs((up - down) / 2e-5 - grad.reshape(-1)[k]) < 1e-5, name


def test_tagger_finds_held_out_spans_and_keeps_base():
    r = random.Random(5)
    words = "the and hend tion erth ing oner shble".split()

    def text():
        kinds = [lambda: f"u{r.randint(1, 99)}@mail{r.randint(1, 9)}.example.com", lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)), lambda: f"+1 ({r.randint(200, 999)}) 555-{r.randint(1000, 9999)}"]
        return " ".join([*r.choices(words, k=8), r.choice(kinds)(), *r.choices(words, k=8)])

    seen, new = [text() for _ in range(300)], [text() for _ in range(60)]
    tagger = pii.train(seen)
    want = [pii.base_spans(x) for x in new]
    free = pii.added_spans(new, [[] for _ in new], tagger)
    hits = sum(tuple(s) in set(map(tuple, own)) for base, own in zip(want, free) for s in base)
    assert hits >= 0.8 * sum(map(len, want))
    assert all(not (a[0] < b[1] and b[0] < a[1]) for base, own in zip(want, pii.added_spans(new, want, tagger)) for a in base for b in own)


def test_reconciling_takes_the_best_set():
    found = {(0, 10, 0): 0.95, (0, 4, 1): 0.92, (5, 10, 1): 0.93, (20, 30, 2): 0.99, (28, 33, 2): 0.91}
    assert sorted(pii.reconciled([(40, 50, 0)], found)) == [(0, 4, 1), (5, 10, 1), (20, 30, 2)]
    assert pii.reconciled([(0, 40, 0)], found) == []


def test_windows_cover_every_anchor():
    r = random.Random(6)
    for _ in range(200):
        x = "".join(r.choice("abcdefgh 1@") if r.random() < 0.1 else "z" for _ in range(r.randint(0, 900)))
        starts = pii.windows(x)
        for m in pii.ANCHOR.finditer(x):
            low, high = max(0, m.start() - pii.AROUND), min(len(x), m.start() + pii.AROUND)
            covered = {p for s in starts for p in range(s, s + pii.WINDOW)}
            assert set(range(low, high)) <= covered


def test_pii_edges(spark, odd_docs):
    tagged = pii.tag(odd_docs, pii.fit(odd_docs), "found")
    got = tagged.collect()
    assert len(got) == odd_docs.count() and got[0].spans == "own spans"
    by = {r.doc_id: r for r in got}
    assert len([s for s in by[8].found if s.base]) == 4000 and {s.kind for s in by[9].found if s.base} == {"phone", "ip"}
    clean = {r.doc_id: r.text for r in pii.masked(tagged, "found").collect()}
    assert clean[2] is None and "@" not in clean[8] and clean[9].startswith("call [PHONE] or [IP] and")
    assert pii.fit(odd_docs.where("false")) is None and pii.tag(odd_docs.where("false"), None).count() == 0
