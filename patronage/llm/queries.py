"""The registered queries of this subpackage and the SQL that must agree with them."""
from __future__ import annotations


import public_tokenizers
from pyspark.sql import functions as F

from patronage.llm import chat, jaccard, lattice, mixing, neighbours, periods, pieces, pii, quality, restaurants, tokens, urls, whitening
from patronage.llm.shared import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_chat_format", r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r0, text AS t0 FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(regexp_replace(text, '(\\|<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|<s>|</s>|\[ROLE\]|\[/ROLE\]|\[/TURN\])', '\\\1', 'g'))
    + CASE role WHEN 'system' THEN 17 WHEN 'user' THEN 15 WHEN 'assistant' THEN 9
      ELSE 23 + length(regexp_replace(role, '(\\|<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|<s>|</s>|\[ROLE\]|\[/ROLE\]|\[/TURN\])', '\\\1', 'g')) END AS n,
    CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END AS c
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars,
  regexp_full_match(string_agg(c, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST), 's?(ua)*u?') AS valid
FROM sized GROUP BY conv_id""")
def op1_chat_format(spark, sf_dir):
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.format_chats(chats.unionByName(extra)))


#: Rules of the URL filter, (verdict, host/path).
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


@query("op2_url_filter")
def op2_url_filter(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages"), "page_id", RULES)


@query("op3_mixing")
def op3_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "source", mixing.words_in(F.col("text")).alias("size"))
    return mixing.taken_words(*mixing.mix(docs)).select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken")


@query("op4_sentencepiece")
def op4_sentencepiece(spark, sf_dir):
    """Encodes every whole text, decodes it again and compares; ``ids_hash`` stands for the exact pieces."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = pieces.decode(pieces.encode(docs, path, seed=4), path)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.col("text")).alias("lossless"))


@query("op6_token_counts")
def op6_token_counts(spark, sf_dir):
    counts = tokens.token_counts(table(spark, sf_dir, "documents"), "doc_id", public_tokenizers.path("word_bpe_49k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


@query("op5_quality")
def op5_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op8_pii")
def op8_pii(spark, sf_dir):
    """Counts and ``base_sha256`` are those of the base patterns; ``n_added`` are the tagger's own spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tagged = pii.tag(docs, pii.fit(docs))
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    of = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [of(kind) for kind in pii.KINDS]
    return tagged.select("doc_id", *counts, F.sha2(named(base), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"), (F.size("spans") - F.size(base)).cast("long").alias("n_added"))


@query("op10_lattice_dedup")
def op10_lattice_dedup(spark, sf_dir):
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op9_jaccard_join", r"""
WITH RECURSIVE words AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w
  FROM documents),
cut AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s
  FROM words),
sized AS (SELECT doc_id, count(*) AS n FROM cut GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM cut a JOIN cut b ON a.s = b.s AND a.doc_id < b.doc_id
  JOIN sized m ON m.doc_id = a.doc_id JOIN sized n ON n.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, m.n, n.n HAVING 100 * count(*) >= 80 * (m.n + n.n - count(*))),
links AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN sized s USING (doc_id) JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) c ON c.x = d.doc_id""")
def op9_jaccard_join(spark, sf_dir):
    return jaccard.join(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


@query("op7_curve_neighbours")
def op7_curve_neighbours(spark, sf_dir):
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(20)) == 0)


@query("op12_whitening")
def op12_whitening(spark, sf_dir):
    return whitening.components_of(table(spark, sf_dir, "embeddings"), "embedding", "vec_id")


@query("op13_periodic_runs", r"""
WITH steps AS (SELECT [list_reduce([CAST(b AS BIGINT)] || range(8), lambda x, k: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END)) FOR b IN range(256)] AS t),
sums AS (
  SELECT doc_id, text, xor(4294967295, list_reduce([4294967295::BIGINT] || [ascii(c)::BIGINT FOR c IN string_split(CAST(doc_id AS VARCHAR), '')],
    lambda x, c: xor(x >> 8, t[xor(x, c) % 256 + 1]))) AS h
  FROM documents, steps),
cut AS (SELECT row_number() OVER () AS id, doc_id, h, h // 10 AS g, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w0 FROM sums),
placed AS (SELECT *, len(w0) AS n, CASE WHEN len(w0) > 0 AND h % 10 = 0 THEN g % len(w0) ELSE len(w0) END AS a FROM cut),
docs AS (SELECT id, doc_id, n, [w0[CASE WHEN i < a THEN i + 1 ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1 END] FOR i IN range(n)] AS w FROM placed),
words AS (SELECT id, n, unnest(w) AS word, unnest(range(n)) AS i FROM docs),
equal AS (SELECT x.id, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.id = y.id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT id, q, i, i - row_number() OVER (PARTITION BY id, q ORDER BY i) AS part FROM equal),
stretches AS (SELECT id, q, min(i) AS s, count(*) + q AS l FROM islands GROUP BY id, q, part HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT id, s, l, min(q) AS q FROM stretches GROUP BY id, s, l),
gone AS (SELECT DISTINCT id, unnest(range(s + q, s + l)) AS i FROM runs),
kept AS (SELECT w.id, string_agg(w.word, ' ' ORDER BY w.i) AS t FROM words w LEFT JOIN gone g ON g.id = w.id AND g.i = w.i WHERE g.i IS NULL GROUP BY w.id),
told AS (
  SELECT id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines, arg_min({'s': s, 'l': l, 'q': q}, [-l, s, q]) AS best
  FROM runs GROUP BY id)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_words, coalesce(t.n_runs, 0) AS n_runs, t.best.s AS start, t.best.l AS length, t.best.q AS period, 1000 * t.best.l // t.best.q AS exponent_milli,
  sha256(coalesce(t.lines, '')) AS runs_sha256, sha256(coalesce(k.t, '')) AS collapsed_sha256
FROM docs d LEFT JOIN told t USING (id) LEFT JOIN kept k USING (id)""")
def op13_periodic_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", periods.repeated(F.col("text"), F.col("doc_id")).alias("text"))
    return periods.digests(docs, "doc_id")


@query("op11_restaurants")
def op11_restaurants(spark, sf_dir):
    return restaurants.score(table(spark, sf_dir, "documents"), "doc_id", restaurants.held_out("doc_id"))
