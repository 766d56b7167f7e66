"""Periodic runs of words: scale-tiled search with boundary Z-functions, stitched by document and period.

A run is a stretch of words with smallest period q and length of at least ``max(6, 4 q)`` that cannot be made longer with
that period. Octave k holds the periods from 2^k to 2^(k+1) - 1. For it a document is cut at every multiple b of 2^k into
overlapping tiles from b - 2*2^k to b + 6*2^k, and each tile is solved alone: the Z-function of its words from b on tells
how far they equal the words q behind them, the one of the reversed words how far that goes on to the left of b. Together they
give the fragment with period q around b, clipped to the tile.

* A tile needs solving only if the 2^(k+1) words from b equal those q further on; rolling window hashes find these pairs
  (equal words have equal hashes, the Z-functions refute the rest). Every run holds such a boundary less than 2^k behind its
  start, one less than 2^k + q + 2^(k+1) before its end, and all between. So its tiles reach over both ends, and neighbours
  overlap by more than q. Neighbouring tiles of one task with the same period are joined before they are solved.
* Fragments are shuffled by (document, period); those that overlap by q words or more are one stretch. A stretch found
  with a multiple of its smallest period covers the same words as the run itself, so the smallest period wins.
* Documents of more than ``LONG`` words are exploded: strips of neighbouring tiles, one list for each octave, go as rows
  to any task. The tiles of a shorter document travel together, as one row, and are solved where the text is read.

Defined results: null, empty and blank texts have no words and no runs; repeated rows and rows with a null key are
documents of their own; an empty table gives no rows. Only the named columns are read, so others may have any name.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from patronage.llm.shared import settle, text_batches

#: Words up to which a document's tiles stay together; words of a strip; pairs of windows that are compared at once.
LONG, STRIP, BLOCK = 1 << 16, 1 << 14, 1 << 20
#: A run has at least this many words, and this many times its period.
LEAST, TIMES = 6, 4
FRAGMENT = StructType([StructField("period", LongType()), StructField("start", LongType()), StructField("end", LongType())])
STRIPS = StructType([StructField("octave", IntegerType()), StructField("offset", LongType()), StructField("codes", BinaryType())])


def words_in(texts: list) -> tuple:
    """(all words as one Arrow array, numbers of words by text); words are divided by ASCII white space only."""
    lists = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
    flat = lists.flatten()
    real = pc.greater(pc.binary_length(flat), 0)
    parents = pc.list_parent_indices(lists).filter(real).to_numpy(zero_copy_only=False)
    return flat.filter(real), np.bincount(parents, minlength=len(texts)).astype(np.int64)


def z_function(s: list) -> list:
    """For each place, how many items from there equal those from the start."""
    n, left, right = len(s), 0, 0
    z = [n] + [0] * (n - 1)
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def window_hashes(codes: np.ndarray):
    """Hashes of the 2, 4, 8, ... words from each place, one array after another."""
    h, width = codes.astype(np.uint64), 1
    while len(h) > width:
        a, b = h[:-width], h[width:]
        h = (a ^ (a >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
        width *= 2
        yield h


def matches(hashes: np.ndarray, octave: int, first: np.ndarray, last: np.ndarray, covered: tuple) -> tuple:
    """(document number, boundary, period), in this order, where the words from a boundary may equal those a period of the octave further on.

    ``covered`` holds, by place, period and end of a stretch found in a lower octave: inside it a multiple of its period is none of its own.
    """
    scale = 1 << octave
    counts = np.maximum((last - first - 3 * scale) // scale + 1, 0)
    doc = np.repeat(np.arange(len(first)), counts)
    at = first[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)) * scale
    periods = np.arange(scale, 2 * scale)
    found = []
    for a in range(0, len(at), max(1, BLOCK // scale)):
        b = at[a : a + max(1, BLOCK // scale)]
        other = b[:, None] + periods
        row, q = np.nonzero(hashes[b][:, None] == hashes[np.minimum(other, len(hashes) - 1)])
        q = periods[q]
        good = b[row] + q + 2 * scale <= last[doc[a + row]]
        good &= (q % covered[0][b[row]] != 0) | (b[row] + q + 2 * scale > covered[1][b[row]])
        found.append((doc[a + row[good]], b[row[good]], q[good]))
    return tuple(map(np.concatenate, zip(*found))) if found else tuple(np.zeros((3, 0), np.int64))


def joined_tiles(doc: np.ndarray, boundary: np.ndarray, period: np.ndarray, scale: int):
    """(document, boundary, periods, last boundaries): tiles of neighbouring boundaries with the same period are joined, those that begin at one boundary solved together."""
    order = np.lexsort((boundary, period, doc))
    doc, boundary, period = doc[order], boundary[order], period[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (period[1:] != period[:-1]) | (boundary[1:] != boundary[:-1] + scale)])
    start = np.flatnonzero(new)
    doc, first, last, period = doc[start], boundary[start], boundary[np.append(start[1:], len(boundary)) - 1], period[start]
    order = np.lexsort((period, first))
    doc, first, last, period = (x[order].tolist() for x in (doc, first, last, period))
    a = 0
    for b in range(1, len(first) + 1):
        if b == len(first) or first[b] != first[a]:
            yield doc[a], first[a], period[a:b], last[a:b]
            a = b


def tile_fragments(codes: np.ndarray, boundary: int, first: int, last: int, octave: int, periods: list, ends: list) -> list:
    """(period, start, end) around a boundary, solved on its tile alone; ``ends`` are the last boundaries of joined tiles."""
    scale = 1 << octave
    start, end = max(first, boundary - 2 * scale), min(last, max(ends) + 6 * scale)
    ahead = z_function(codes[boundary:end].tolist())
    s, b = codes[start : boundary + periods[-1]].tolist(), boundary - start
    back = z_function(s[:b][::-1] + [-1] + s[::-1])
    found = []
    for q, far in zip(periods, ends):
        f, g = ahead[q], back[b + 1 + len(s) - b - q]
        if f + g >= q:
            found.append((q, boundary - g, boundary + q + f))
        if boundary + f < far + 2 * scale:  # a hash of unequal words was equal: the tiles behind it count alone
            for at in range(boundary + scale, far + 1, scale):
                found += tile_fragments(codes, at, first, last, octave, [q], [at])
    return found


def stitched(fragments) -> list:
    """Fragments (period, start, end) of one document, those of a period that overlap by it made one."""
    out: list = []
    for q, start, end in sorted(fragments):
        if out and out[-1][0] == q and start <= out[-1][2] - q:
            out[-1] = (q, out[-1][1], max(end, out[-1][2]))
        else:
            out.append((q, start, end))
    return out


def fragments(codes: np.ndarray, sizes: np.ndarray, octaves=None) -> list:
    """For each document, the stitched fragments of all octaves (or of the given one); ``codes`` holds all words one after another."""
    last = np.cumsum(sizes)
    first, found = last - sizes, [[] for _ in sizes]
    covered = np.full(len(codes), 1 << 62), np.zeros(len(codes), np.int64)
    for octave, hashes in enumerate(window_hashes(codes)):
        if len(sizes) == 0 or max(LEAST, TIMES << octave) > sizes.max():
            break
        if octaves is not None and octave not in octaves:
            continue
        doc, boundary, period = matches(hashes, octave, first, last, covered)
        made: dict = {}
        for i, b, own, ends in joined_tiles(doc, boundary, period, 1 << octave) if len(doc) else ():
            made.setdefault(i, []).extend(tile_fragments(codes, b, first[i], last[i], octave, own, ends))
        for i, new in made.items():
            new = stitched(new)
            found[i] += new
            for q, s, e in new:
                inside = slice(s, e)
                wider = covered[1][inside] < e
                covered[0][inside][wider], covered[1][inside][wider] = q, e
    return [[(q, s - a, e - a) for q, s, e in own] for own, a in zip(found, first.tolist())]


def strips_of(codes: np.ndarray):
    """Strips of neighbouring tiles (octave, offset, words) that cover a long document in every octave."""
    octave = 0
    while max(LEAST, TIMES << octave) <= len(codes):
        scale = 1 << octave
        step = max(STRIP, 8 * scale)
        for at in range(0, len(codes), step):
            yield octave, max(0, at - 2 * scale), codes[max(0, at - 2 * scale) : at + step + 6 * scale].tobytes()
        octave += 1


def _read(batches):
    for batch, texts in text_batches(batches):
        words, sizes = words_in(texts)
        codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int32) if len(words) else np.zeros(0, np.int32)
        ends = np.cumsum(sizes)
        short = sizes <= LONG
        found = fragments(codes[np.repeat(short, sizes)], np.where(short, sizes, 0))
        joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int64()), words), pa.scalar(" ", pa.large_string())).to_pylist()
        open_ = [bool(own) or not s for own, s in zip(found, short.tolist())]
        kept = [t if o else None for t, o in zip(joined, open_)]
        plain = [None if o else hashlib.sha256(t.encode()).hexdigest() for t, o in zip(joined, open_)]
        strips = [[] if s else list(strips_of(codes[a:b])) for s, a, b in zip(short.tolist(), (ends - sizes).tolist(), ends.tolist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("key"), pa.array(sizes, pa.int64()), pa.array(kept, pa.string()), pa.array(plain, pa.string()),
             pa.array([[dict(zip(("period", "start", "end"), x)) for x in own] for own in found], pa.list_(pa.struct([("period", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))),
             pa.array([[dict(zip(("octave", "offset", "codes"), x)) for x in own] for own in strips], pa.list_(pa.struct([("octave", pa.int32()), ("offset", pa.int64()), ("codes", pa.binary())])))],
            names=["row", "key", "n", "words", "plain", "fragments", "strips"])


def _solve_strips(batches):
    for batch in batches:
        for row, octave, offset, codes in zip(*(batch.column(c).to_pylist() for c in ("row", "octave", "offset", "codes"))):
            own = np.frombuffer(codes, np.int32)
            found = fragments(own, np.array([len(own)]), {octave})[0]
            if found:
                yield pa.RecordBatch.from_pydict({"row": [row] * len(found), "period": [q for q, _, _ in found], "start": [s + offset for _, s, _ in found], "end": [e + offset for _, _, e in found]})


def stitch(found: DataFrame) -> DataFrame:
    """(row, start, length, period): the runs among fragments (row, period, start, end), clipped tiles put together again."""
    order = Window.partitionBy("row", "period").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.withColumn("new", F.when(reach.isNull() | (F.col("start") > reach - F.col("period")), 1).otherwise(0))
    whole = marked.withColumn("part", F.sum("new").over(order)).groupBy("row", "period", "part").agg(F.min("start").alias("start"), (F.max("end") - F.min("start")).alias("length"))
    long = whole.where(F.col("length") >= F.greatest(F.lit(LEAST), TIMES * F.col("period")))
    return long.groupBy("row", "start", "length").agg(F.min("period").alias("period"))


def search(docs: DataFrame, key: str, text: str = "text") -> tuple:
    """(documents, runs): one row a document (row, key, n, and its ``words`` where a run is possible, else ``plain``), and its runs (row, start, length, period)."""
    schema = StructType([StructField("row", LongType()), StructField("key", docs.schema[key].dataType), StructField("n", LongType()), StructField("words", StringType()),
                         StructField("plain", StringType()), StructField("fragments", ArrayType(FRAGMENT)), StructField("strips", ArrayType(STRIPS))])
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    read = settle(numbered.mapInArrow(_read, schema))
    near = read.select("row", F.explode("fragments").alias("f")).select("row", "f.period", "f.start", "f.end")
    strips = read.select("row", F.explode("strips").alias("s")).select("row", "s.octave", "s.offset", "s.codes")
    far = strips.repartition("row", "octave", "offset").mapInArrow(_solve_strips, "row long, period long, start long, end long")
    return read.select("row", "key", "n", "words", "plain"), stitch(near.unionByName(far))


def _digests(batches):
    for batch in batches:
        runs_sha, collapsed = [], []
        for words, runs in zip(batch.column("words").to_pylist(), batch.column("runs").to_pylist()):
            own = [(r["start"], r["period"], r["length"]) for r in runs or []]
            runs_sha.append(hashlib.sha256("".join(f"{s},{n},{q}\n" for s, q, n in sorted(own)).encode()).hexdigest())
            kept = words.split(" ")
            drop = np.zeros(len(kept) + 1, dtype=np.int64)
            for s, q, n in own:
                drop[s + q] += 1
                drop[s + n] -= 1
            out = np.cumsum(drop)[:-1] > 0
            collapsed.append(hashlib.sha256(" ".join(w for w, gone in zip(kept, out) if not gone).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "words"), pa.array(runs_sha), pa.array(collapsed)], names=[c for c in batch.schema.names if c != "words"] + ["runs_sha256", "collapsed_sha256"])


def digests(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, n_words, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256), one row a document."""
    read, runs = search(docs, key, text)
    by_row = runs.groupBy("row").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    none, empty = F.col("words").isNull(), hashlib.sha256(b"").hexdigest()
    joined = read.where(~none).join(by_row, "row", "left").select("key", "n", "words", "runs")
    schema = StructType([*(f for f in joined.schema.fields if f.name != "words"), StructField("runs_sha256", StringType()), StructField("collapsed_sha256", StringType())])
    open_ = joined.mapInArrow(_digests, schema)
    closed = read.where(none).select("key", "n", F.lit(None).cast(schema["runs"].dataType).alias("runs"), F.lit(empty).alias("runs_sha256"), F.col("plain").alias("collapsed_sha256"))
    best = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("a"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    rows = open_.unionByName(closed).withColumn("best", best)
    length = -F.col("best.a")
    return rows.select(F.col("key").alias(key), F.col("n").alias("n_words"), F.coalesce(F.size("runs"), F.lit(0)).cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"),
                       F.floor(1000 * length / F.col("best.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def repeated(text: Column, key: Column) -> Column:
    """The text in which, for one key of ten (by checksum), the words from a place on repeat the first few of them."""
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words).cast("long")
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    times = (F.ceil((n - a) / p)).cast("int")
    made = F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), times)), F.lit(1), (n - a).cast("int"))), " ")
    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), made).otherwise(text)
