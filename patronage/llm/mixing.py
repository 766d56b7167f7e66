"""Mixing sources to target weights: what a training mix of a given size takes from every document.

1. The documents of a source stand in a fixed pseudorandom order; their words form one stream that is packed into blocks
   of ``BLOCK`` words. A two-level running sum gives each document its place: within small hashed chunks and over chunks,
   so no source is sorted in one task.
2. The mix is as many blocks as all sources have, scaled to the targets and cut into shards of ``SHARD`` slots. Each shard
   draws multinomial source counts: the whole part of each expected count is given, the remaining slots are drawn by keyed
   hash from the fractional parts (residual multinomial), which keeps every source near its target also in small mixes.
3. The j-th slot of a source is mapped through the source's pseudorandom permutation of its block numbers (swap-or-not
   rounds keyed by seed, source and pass), a new permutation for every pass over the source.
4. Slots and blocks meet by (source, block); a block's words go to the documents that lie in it.

Defined results: a null or empty text has size 0 and is never taken; null sources form one source; repeated rows are
separate documents; with no words at all every target and every taken count is 0. Results depend on contents and seed,
not on partitions. A word is ``[^\\x20\\x09-\\x0D]+``.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from patronage.llm.shared import free_name, settle

BLOCK, SHARD, ROUNDS, REPEATS = 64, 4096, 12, 3
WORD, SPACE = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]"
WEIGHTS = (5, 2, 1)


def words_in(text: Column) -> Column:
    """Number of words; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit(*parts) -> Column:
    """A number in [0, 1) by keyed hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, target) from one row per source with its size.

    Sources by code point, null last, weigh ``weights`` in turn and share the sum of all sizes; none gets more than
    ``repeats`` times its size. Handing the excess on by weight until none is above ends where
    sum(min(level * weight, cap)) is the total, and sources reach their cap in the order of cap / weight.
    """
    by_name, by_cap = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)
    rows = sizes.select("source", "source_size", weight.alias("weight")).withColumn("cap", F.lit(float(repeats)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    # level if this source and all with a higher ratio are below their caps
    level = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levelled = rows.withColumn("level", level)
    first = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(Window.partitionBy())
    return levelled.withColumn("free", first["level"]).select("source", "source_size", F.coalesce(F.least(F.col("free") * F.col("weight"), F.col("cap")), F.lit(0.0)).alias("target"))


def permuted(x: Column, n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of 0..n-1: swap-or-not rounds, each pairing x with (shift - x) mod n."""

    def swap(at: Column, k: Column) -> Column:
        other = F.pmod(F.xxhash64(key, k) - at, n)
        return F.when(F.pmod(F.xxhash64(key, k, F.greatest(at, other)), F.lit(2)) == 0, at).otherwise(other)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x, swap)


def placed(docs: DataFrame, seed: int) -> DataFrame:
    """Adds ``start``, the place of a document's first word in its source's stream; ``docs`` has key, source, size.

    Chunks are hashed by contents; their number is about the square root of the rows, so chunk sums per source and the
    rows of a chunk both stay small.
    """
    n = docs.count()
    chunks = max(16, math.isqrt(n))
    order = F.xxhash64("key", "size", F.lit(seed))
    rows = docs.withColumn("order", order).withColumn("chunk", F.pmod("order", F.lit(chunks)))
    sums = rows.groupBy("source", "chunk").agg(F.sum("size").alias("chunk_size"))
    up_to = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("chunk_size").over(up_to), F.lit(0))).select(F.col("source").alias("s"), F.col("chunk").alias("c"), "offset")
    within = Window.partitionBy("source", "chunk").orderBy("order", "key", "size").rowsBetween(Window.unboundedPreceding, -1)
    inner = rows.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = inner.join(offsets, inner.source.eqNullSafe(offsets.s) & (inner.chunk == offsets.c))
    return joined.withColumn("start", F.col("offset") + F.col("inner")).drop("order", "chunk", "s", "c", "offset", "inner")


def drawn(sources: DataFrame, seed: int, block: int, shard: int, repeats: int) -> DataFrame:
    """(source, block_no, pass): the blocks that the mix takes; ``sources`` has source, source_size, target."""
    blocks = F.ceil(F.col("source_size") / F.lit(float(block))).cast("long")
    wanted = sources.where("source_size > 0").withColumn("blocks", blocks).withColumn("wanted", F.col("target") / F.col("source_size") * F.col("blocks"))
    total = wanted.agg(F.coalesce(F.sum("wanted"), F.lit(0.0))).first()[0]
    slots = round(total)
    shards = math.ceil(slots / shard)
    spark = sources.sparkSession
    if not slots:
        return wanted.select("source", F.lit(0).cast("long").alias("block_no"), F.lit(0).cast("long").alias("pass")).where("false")
    # the whole parts, and for the rest the bounds of each source on the line of fractional parts
    width = F.least(F.lit(shard).cast("long"), F.lit(slots).cast("long") - F.col("shard") * shard)
    line = Window.partitionBy("shard").orderBy(F.col("source").asc_nulls_last())
    share = (
        wanted.withColumn("p", F.col("wanted") / F.lit(total))
        .withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
        .withColumn("width", width)
        .withColumn("whole", F.floor(F.col("width") * F.col("p")).cast("long"))
        .withColumn("part", F.col("width") * F.col("p") - F.col("whole"))
        .withColumn("bound", F.coalesce(F.sum("part").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    )
    rest = share.groupBy("shard").agg((F.first("width") - F.sum("whole")).alias("rest"), F.sum("part").alias("parts"))
    draws = rest.where("rest > 0").select("shard", "parts", F.explode(F.sequence(F.lit(1).cast("long"), "rest")).alias("draw")).select("shard", (unit(F.lit(seed), F.lit("draw"), "shard", "draw") * F.col("parts")).alias("bound"))
    none = wanted.schema["source"].dataType
    marks = share.where("part > 0").select("shard", "bound", F.struct("source").alias("at"), F.lit(0).alias("is_draw")).unionByName(
        draws.select("shard", "bound", F.lit(None).cast(f"struct<source:{none.simpleString()}>").alias("at"), F.lit(1).alias("is_draw")))
    held = marks.withColumn("at", F.last("at", ignorenulls=True).over(Window.partitionBy("shard").orderBy("bound", "is_draw").rowsBetween(Window.unboundedPreceding, 0)))
    extra = held.where("is_draw = 1").groupBy("shard", F.col("at.source").alias("source")).agg(F.count("*").alias("n"))
    counts = share.select("shard", "source", F.col("whole").alias("n")).unionByName(extra).groupBy("shard", "source").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("first", F.coalesce(F.sum("n").over(earlier), F.lit(0))).where("n > 0")
    known = wanted.select(F.col("source").alias("s"), "blocks")
    # few rows become many slots here, so they are dealt out first
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(slots / 500_000))
    slot = (
        counts.join(known, counts.source.eqNullSafe(known.s))
        .select("source", "blocks", "first", "n").repartition(tasks, "source", "first")
        .select("source", "blocks", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("j"))
        .where(F.col("j") < repeats * F.col("blocks"))
    )
    name = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))
    turn = F.floor(F.col("j") / F.col("blocks")).cast("long")
    key = F.xxhash64(F.lit(seed), name, turn)
    return slot.select("source", permuted(F.pmod("j", "blocks"), F.col("blocks"), key).alias("block_no"), turn.alias("pass"))


def mix(docs: DataFrame, seed: int = 11, block: int = BLOCK, shard: int = SHARD, weights: tuple = WEIGHTS, repeats: int = REPEATS, carry: tuple = ()) -> tuple:
    """(documents, pieces) of a mix of ``docs``, which has ``key``, ``source`` and ``size``; columns ``carry`` go along.

    documents: key, source, size, source_size, target, start. pieces: key, start, from_word, to_word, pass: the words of a
    document that one taken block holds, counted within the document.
    """
    rows = settle(placed(settle(docs.select("key", "source", "size", *carry)), seed))
    sources = settle(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeats))
    # A shard's counts are a few rows and become thousands of slots, so their size says nothing: planned by it, the slots would be broadcast.
    taken = drawn(sources, seed, block, shard, repeats).select(F.col("source").alias("s"), "block_no", "pass").hint("merge")
    end = F.col("start") + F.col("size")
    by_block = rows.where("size > 0").select("key", "source", "start", "size", *carry, F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))).alias("at"))
    pieces = by_block.join(taken, by_block.source.eqNullSafe(taken.s) & (by_block["at"] == taken.block_no)).select(
        "key", "source", "start", "size", "pass", *carry,
        F.greatest(F.col("at") * block - F.col("start"), F.lit(0)).alias("from_word"), F.least((F.col("at") + 1) * block - F.col("start"), "size").alias("to_word"))
    named = sources.select(F.col("source").alias("s"), "source_size", "target")
    return rows.join(named, rows.source.eqNullSafe(named.s)).drop("s"), pieces


def taken_words(documents: DataFrame, pieces: DataFrame) -> DataFrame:
    """Adds ``taken``, the words that the mix takes of each document, repeats counted."""
    sums = pieces.groupBy("key", "source", "start").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    sums = sums.select(F.col("key").alias("k"), F.col("source").alias("s"), F.col("start").alias("b"), "taken")
    some = documents.where("size > 0").join(sums, documents.key.eqNullSafe(sums.k) & documents.source.eqNullSafe(sums.s) & (documents.start == sums.b), "left").drop("k", "s", "b")
    return some.unionByName(documents.where("size = 0").withColumn("taken", F.lit(0).cast("long"))).fillna({"taken": 0})


def mixed(docs: DataFrame, seed: int = 11, block: int = BLOCK) -> DataFrame:
    """The mix itself, with the columns of ``docs``: for each pass over a document's source one row with the words taken.

    Runs of words keep the white space between them; words of blocks that the mix leaves out are missing, and a document
    none of whose blocks is taken has no row. ``n_chars``, where there is one, is the length of the new text.
    """
    mine, k, runs_ = (free_name(docs, x) for x in ("mix_row", "mix_taken", "mix_runs"))
    keyed = settle(docs.withColumn(mine, F.monotonically_increasing_id()))  # written, so a row keeps its number
    key = F.xxhash64("doc_id", "text")  # the order of the mix hangs on contents alone
    _, pieces = mix(keyed.select(key.alias("key"), "source", words_in(F.col("text")).alias("size"), F.col(mine).alias("row")), seed, block, carry=("row",))
    runs = pieces.groupBy("row", "pass").agg(F.sort_array(F.collect_list(F.struct("from_word", "to_word"))).alias(runs_))
    both = keyed.join(runs.select(F.col("row").alias(k), runs_), F.col(mine) == F.col(k))
    words = F.split(F.regexp_replace("text", f"^{SPACE}+", ""), f"(?<={SPACE})(?={WORD[:-1]})")
    # the words are bound to a variable: as a column, the optimizer would split the text once more for every run
    taken = lambda w: F.array_join(F.flatten(F.transform(runs_, lambda r: F.slice(w, (r["from_word"] + 1).cast("int"), (r["to_word"] - r["from_word"]).cast("int")))), "")
    both = both.withColumn("text", F.transform(F.array(words), taken)[0])
    if "n_chars" in docs.columns:
        both = both.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return both.select(*docs.columns)
