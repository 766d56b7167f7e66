"""N-gram Jaccard join: documents whose sets of word shingles overlap by 80 percent or more, as classes.

Exact, by a grouped prefix join:

1. Shingles are hashed to 64 bits. Documents with equal sets are one node. Shingles that occur often are counted over all
   documents and stand last in the order of all shingles; the others are ordered by hash. Any order gives the same links;
   this one keeps common passages out of the prefixes.
2. Two sets can only reach the threshold if they share a token of their prefixes, the first size - ceil(0.8 * size) + 1
   tokens. A token met by one node only is dropped, which leaves a small part of the rows.
3. Nodes of one token and a similar size form a group. Each node is compared with the group leader that it shares most
   tokens with, in two rounds of groups and leaders, and linked nodes are merged. Large groups of near copies become one
   component here with one comparison per node and round.
4. What is left are pairs of nodes that share a token but belong to different components. Groups with one component are
   dropped whole. In the others, nodes of one component and size with identical shared prefix tokens are one group. Groups of
   two components meet at the rarest tokens that these share, as many as the threshold leaves no pair without; those that
   share enough tokens for it are expanded to their members and verified. So no link between components is lost, and none
   within one is listed.
5. Whole sets are made again from the text for the nodes to be verified only; a bitmap of fixed size tells which. They are
   dealt by node once for both ends of the pairs, and one end goes to the other.

Defined results: a null or empty text, or one of white space, has no shingles and links with nothing; fewer words than a
shingle form one shingle; repeated rows are documents of their own, also with equal ids; a component's id is its smallest
id that is not null, and a document that links with nothing has its own; other columns are ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from patronage.llm.graphs import components
from patronage.llm.shared import free_name, settle, text_batches

WORDS, PERCENT, ROUNDS = 5, 80, 2
#: Bits that mark the texts whose sets are needed: 2 MB are sent to the tasks, whatever the number of texts.
MARKS = 1 << 24
#: How often a shingle must occur in one slice of texts to be counted, and the most shingles that are kept as common. They
#: set the order only; what is left out is ordered by hash.
OFTEN, COMMON = 2, 1 << 17


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The sorted distinct shingle hashes of a text; words are runs of other than ASCII white space, A-Z in lower case."""
    own = text.encode().lower().split()  # bytes: only ASCII letters and white space count
    if not own:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, own), dtype=np.uint64, count=len(own))
    size = min(words, len(h))
    z = np.full(len(h) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        z = _mixed(z * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(z)])
    return np.unique(z)


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def _often(batches):
    for _, texts in text_batches(batches):
        sets = [shingles(t) for t in texts]
        values, counts = np.unique(np.concatenate(sets), return_counts=True)
        some = counts >= OFTEN
        yield pa.RecordBatch.from_arrays([pa.array(values[some].view(np.int64)), pa.array(counts[some])], names=["shingle", "n"])


def common_shingles(docs: DataFrame, most: int = COMMON) -> tuple:
    """(shingles sorted, their counts): the at most ``most`` commonest, counted over all documents."""
    counted = docs.select("text").mapInArrow(_often, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    rows = counted.where(F.col("n") >= 2 * OFTEN).orderBy(F.desc("n"), "shingle").limit(most).toArrow()
    values, counts = rows.column("shingle").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(values)
    return values[order], counts[order]


def ordered(own: np.ndarray, common: tuple) -> np.ndarray:
    """The shingles of a set, rare ones first by hash, then the common ones by count."""
    values, counts = common
    if not len(values) or not len(own):
        return own
    at = np.minimum(np.searchsorted(values, own), len(values) - 1)
    n = np.where(values[at] == own, counts[at], 0)
    return own[np.argsort(n, kind="stable")]


def _nodes(common, percent: int):
    def run(batches):
        names = ["doc_id", "text_key", "node", "n", "prefix"]
        for batch, texts in text_batches(batches):
            nodes, sizes, prefixes = [], [], []
            for own in map(shingles, texts):
                nodes.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                sizes.append(len(own))
                prefixes.append(ordered(own, common.value)[: prefix_size(len(own), percent)].view(np.int64) if len(own) else own.view(np.int64))
            ends = np.cumsum([0, *map(len, prefixes)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefixes)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), lists], names=names)

    return run


def _sets(bits: bytes, size: int):
    """Sets of the texts whose ``row_key`` is marked in ``bits``."""

    def run(batches):
        marked = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), bitorder="little").astype(bool)
        for batch in batches:
            if not batch.num_rows:
                continue
            chosen = np.flatnonzero(marked[batch.column("row_key").to_numpy() % size])
            for _, texts in text_batches([batch.take(pa.array(chosen))] if len(chosen) else []):
                sets = [x.view(np.int64) for x in map(shingles, texts)]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)], dtype=np.int32)), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()), lists], names=["node", "shingles"])

    return run


def _linked(x: Column, y: Column, percent: int) -> Column:
    """Whether two sets, arrays without repeats, overlap as much as it takes."""
    both = F.size(F.array_intersect(x, y)).cast("long")
    return 100 * both >= percent * (F.size(x) + F.size(y) - both)


def _needed(m: Column, n: Column, percent: int) -> Column:
    """How many tokens two sets of sizes m and n must share within their prefixes.

    They share ceil(p (m + n) / (100 + p)) tokens. Those outside of both prefixes lie, in one of the two sets, behind its
    prefix, so they are at most ceil(p m / 100) - 1 or ceil(p n / 100) - 1.
    """
    up = lambda x, y: F.floor((x + (y - 1)) / y).cast("long")
    return up(percent * (m + n), 100 + percent) - up(percent * F.greatest(m, n), 100) + 1


def _similar_sizes(m: Column, n: Column, percent: int) -> Column:
    return 100 * F.least(m, n) >= percent * F.greatest(m, n)


def rarest(meets: DataFrame) -> DataFrame:
    """(token, c, d, most): where members of the components c and d need to meet.

    ``meets`` has every token that c and d share, the number of them, how many of them two members share at ``least``, and as
    ``weight`` the pairs of members that hold the token. Members that share k of s tokens share one of any s - k + 1 of them, so
    the lightest do: a token is of use to pairs that must share at ``most`` so many.
    """
    turned = meets.withColumn("turn", F.row_number().over(Window.partitionBy("c", "d").orderBy("weight", "token")))
    return turned.withColumn("most", F.col("shared") - F.col("turn") + 1).where("most >= least").select("token", "c", "d", "most")


def marked_rows(keys: DataFrame, bits: int = MARKS) -> bytes:
    """A bit for each hash value of ``row_key``, as bytes; their number is fixed, so the result has ``bits`` / 8 bytes."""
    place = F.pmod("row_key", F.lit(bits))
    maps = keys.select(place.alias("at")).groupBy(F.bitmap_bucket_number(F.col("at") + 1).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("at") + 1)).alias("map"))
    out = bytearray(bits // 8)
    for row in maps.collect():
        start = (row["part"] - 1) * len(row["map"])
        out[start : start + len(row["map"])] = row["map"]
    return bytes(out)


def join(docs: DataFrame, key: str = "doc_id", percent: int = PERCENT, rounds: int = ROUNDS) -> DataFrame:
    """(``key``, text_key, n_shingles, component_id, kept) for every row of ``docs`` (``key``, ``text``).

    ``text_key`` is xxhash64 of the text. ``kept`` marks one (key, text_key) of each component, the one with the smallest id.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("doc_id"), "text").withColumn("text_key", F.xxhash64("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    common = spark.sparkContext.broadcast(common_shingles(rows))
    made = rows.mapInArrow(_nodes(common, percent), f"doc_id {kind}, text_key long, node binary, n long, prefix array<long>")
    # one row of each node keeps the prefix, and gets the short number by which the node goes from here on
    turn = F.row_number().over(Window.partitionBy("node").orderBy("doc_id", "text_key"))
    alone = F.monotonically_increasing_id().cast("string").cast("binary")  # documents without shingles are dealt each for itself
    full = F.col("n") > 0
    every = made.withColumn("node", F.coalesce("node", alone)).withColumn("head", full & (turn == 1)).withColumn("node", F.when(full, F.col("node")))
    every = settle(every.withColumns({"prefix": F.when(F.col("head"), F.col("prefix")), "id": F.when(F.col("head"), F.monotonically_increasing_id())}))
    heads = every.where("head")

    # tokens that at least two nodes share, as the lists of their nodes
    entries = heads.select(F.col("id").alias("node"), F.col("n").cast("int").alias("n"), F.explode("prefix").alias("token"))
    entries = entries.withColumn("met", F.count("*").over(Window.partitionBy("token"))).where("met > 1")
    # a node is the more central, the more nodes its tokens meet: what others were copied from comes before its copies
    lists = settle(entries.groupBy("node", "n").agg(F.sum("met").alias("central"), F.collect_list("token").alias("tokens")))

    def verified(pairs: DataFrame) -> DataFrame:
        """(a, b, linked) of (a, b); only the sets of nodes in ``pairs`` are made again and moved."""
        ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        row_key = F.xxhash64("text_key", "doc_id").alias("row_key")
        nodes = settle(heads.join(ids, "id", "left_semi").select("id", "node", row_key))
        found = rows.select("text", row_key).mapInArrow(_sets(marked_rows(nodes.select("row_key")), MARKS), "node binary, shingles array<long>")
        # The sets are dealt by node once, for both ends of the pairs; only those of the first end travel again, to the second.
        sets = found.join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"])
        named = lambda end, to: nodes.select(F.col("id").alias(end), F.col("node").alias(to))
        asked = pairs.join(named("a", "first"), "a").join(named("b", "second"), "b")
        left = sets.select(F.col("node").alias("first"), F.col("shingles").alias("x"))
        right = sets.select(F.col("node").alias("second"), F.col("shingles").alias("y"))
        both = asked.join(left, "first").join(right, "second")
        return settle(both.select("a", "b", _linked(F.col("x"), F.col("y"), percent).alias("linked")))

    # each node with the group leaders that it shares most tokens with
    now = lists.select("node", "n", "central", F.explode("tokens").alias("token")).repartition("token")
    for turn in range(rounds):
        # sizes within a factor, shifted by a part of it in the next round
        step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + turn / rounds)
        group = Window.partitionBy("token", f"step{turn}")
        now = now.withColumn(f"step{turn}", step).withColumn(f"leader{turn}", F.max(F.struct("central", "node", "n")).over(group))
    led = now.select("node", "n", F.posexplode(F.array(*[f"leader{turn}" for turn in range(rounds)])).alias("turn", "leader")).where(F.col("leader.node") != F.col("node"))
    votes = led.groupBy("turn", "node", "n", F.col("leader.node").alias("b"), F.col("leader.n").alias("m")).agg(F.count("*").alias("votes"))
    votes = votes.where(_similar_sizes(F.col("m"), F.col("n"), percent) & (F.col("votes") >= _needed(F.col("m"), F.col("n"), percent)))
    pairs = votes.groupBy("turn", F.col("node").alias("a")).agg(F.max(F.struct("votes", "b")).alias("best")).select("a", F.col("best.b").alias("b"))
    first = verified(settle(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()))
    member = settle(components(first.where("linked").select("a", "b")))

    # pairs across components that share enough tokens
    now = lists.join(member, "node", "left").select("node", "n", F.coalesce("component", "node").alias("component"), F.explode("tokens").alias("token"))
    token = Window.partitionBy("token")
    mixed = now.withColumns({"c0": F.min("component").over(token), "c1": F.max("component").over(token)}).where("c0 <> c1")
    # nodes of one component and size that share the same tokens with others are one group, whose least node stands for it
    lists = mixed.groupBy("node", "n", "component").agg(F.sort_array(F.collect_list("token")).alias("tokens"))
    lists = settle(lists.select("node", "n", "component", "tokens", F.xxhash64("tokens").alias("l1"), F.xxhash64(F.lit(1), "tokens").alias("l2")))
    alike = ["component", "n", "l1", "l2"]
    groups = settle(lists.join(lists.groupBy(*alike).agg(F.min("node").alias("group")), alike).select("node", "group", "n", "component"))
    # Components first: two of them can hold a pair only if they share as many tokens in all as their sizes ask for at least.
    stands = groups.where("node = group").select("node", "n", "component")
    sizes = stands.groupBy("component").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("node").alias("least"), (F.min("node") < F.max("node")).alias("many"))
    standing = settle(lists.select("node", "tokens").join(stands.join(sizes, "component"), "node"))
    own = ["component", "lo", "hi", "least", "many"]
    held = standing.select(*own, F.explode("tokens").alias("token")).groupBy("token", *own).agg(F.count("*").alias("nodes"))
    held = settle(held.withColumnRenamed("least", "node"))
    near = (F.col("s.token") == F.col("t.token")) & (F.col("s.component") < F.col("t.component")) & (100 * F.col("s.hi") >= percent * F.col("t.lo")) & (100 * F.col("t.hi") >= percent * F.col("s.lo"))
    either = F.col("s.many") | F.col("t.many")
    ends = [F.col("s.component").alias("c"), F.col("t.component").alias("d")]
    meets = held.alias("s").join(held.alias("t"), near).select(*ends, F.col("s.node").alias("ga"), F.col("t.node").alias("gb"), either.alias("many"), F.least("s.lo", "t.lo").alias("lo"), F.greatest("s.hi", "t.hi").alias("hi"))
    counts = meets.groupBy(*meets.columns).agg(F.count("*").alias("shared"))
    least, similar = _needed(F.col("lo"), F.col("hi"), percent), _similar_sizes(F.col("lo"), F.col("hi"), percent)
    # Two single nodes are counted for good; between other components, rounding may raise the bound by one above that of sizes between.
    bound = F.when(similar, F.greatest(least - F.when(F.col("many"), 1).otherwise(0), F.lit(1))).otherwise(F.when(F.col("many"), 1))
    possible = settle(counts.withColumn("least", bound).where("shared >= least"))
    meets = held.alias("s").join(held.alias("t"), near & either).select(F.col("s.token").alias("token"), *ends, (F.col("s.nodes") * F.col("t.nodes")).alias("weight"))
    probes = rarest(meets.join(possible.where("many").select("c", "d", "shared", "least"), ["c", "d"]))
    side = lambda x, c: standing.select(F.explode("tokens").alias("token"), F.col("component").alias(c), F.struct("node", "n").alias(x))
    asked = _needed(F.col("s.n"), F.col("t.n"), percent) <= F.col("most")
    across = probes.join(side("s", "c"), ["token", "c"]).join(side("t", "d"), ["token", "d"]).where(_similar_sizes(F.col("s.n"), F.col("t.n"), percent) & asked)
    across = settle(across.select(F.col("s.node").alias("ga"), F.col("t.node").alias("gb")).distinct())
    tokens = lambda x, y: lists.select(F.col("node").alias(x), F.struct("n", "tokens").alias(y))
    counted = across.join(tokens("ga", "s"), "ga").join(tokens("gb", "t"), "gb").withColumn("shared", F.size(F.array_intersect("s.tokens", "t.tokens")))
    enough = counted.where(F.col("shared") >= _needed(F.col("s.n"), F.col("t.n"), percent)).select("ga", "gb")
    enough = enough.unionByName(possible.where("not many").select("ga", "gb"))
    members = enough.join(groups.select(F.col("group").alias("ga"), F.col("node").alias("a")), "ga").join(groups.select(F.col("group").alias("gb"), F.col("node").alias("b")), "gb")
    left = members.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = verified(settle(left.join(first, ["a", "b"], "left_anti")))
    member = components(first.unionByName(rest).where("linked").select("a", "b"))

    numbered = heads.select("node", "id").join(member.withColumnRenamed("node", "id"), "id", "left").select("node", F.coalesce("component", "id").alias("group"))
    named = every.select("doc_id", "text_key", "node", F.col("n").alias("n_shingles")).join(numbered, "node", "left")
    # a node that links with nothing stands alone but for its copies; a document without shingles is its own
    named = settle(named)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key"))
    smallest = named.where(F.col("group").isNotNull()).groupBy("group").agg(first.alias("first"))
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & F.col("text_key").eqNullSafe(F.col("first.text_key"))
    whole = named.where(F.col("group").isNotNull()).join(smallest, "group").select("doc_id", "text_key", "n_shingles", F.col("first.doc_id").alias("component_id"), is_first.alias("kept"))
    empty = named.where(F.col("group").isNull()).select("doc_id", "text_key", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return whole.unionByName(empty).withColumnRenamed("doc_id", key)


def deduplicated(docs: DataFrame, key: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: one of each component, and every row without shingles."""
    k, t, bare, mine, turn = (free_name(docs, x) for x in ("kept_id", "kept_text", "bare", "text_key", "turn"))
    kept = join(docs, key, percent).where("kept").select(F.col(key).alias(k), F.col("text_key").alias(t), (F.col("n_shingles") == 0).alias(bare)).distinct()
    keyed = docs.withColumn(mine, F.xxhash64("text"))
    chosen = keyed.join(kept, F.col(key).eqNullSafe(F.col(k)) & F.col(mine).eqNullSafe(F.col(t)))
    chosen = chosen.withColumn(turn, F.row_number().over(Window.partitionBy(k, t).orderBy(F.lit(0))))
    return chosen.where(F.col(bare) | (F.col(turn) == 1)).select(*docs.columns)
