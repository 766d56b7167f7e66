"""Which machine opinions a person overrules, replayed in arrival order; arrivals may be taken back later.

A machine row is refused while the current row of its (customer, course) is a staff row that is sticky or not older.

*Without retractions* the state of a pair is small: the leading staff row, and whether a machine row is ahead of it (open, with
its time) or not (closed). What a stretch of arrivals does to an open or closed pair is a map of three values that composes:
closed goes to ``end``; open at m goes to open at ``max(m, top)`` if m is after ``bar``, else to ``end``. So ``staff_verdicts`` deals
arrivals by ranges of (pair, arrival), folds each stretch to its map, composes the few maps of a pair that spans ranges,
and runs through the stretches again with the state that each begins in. No pair is gathered anywhere.

*With voids and erasures* (``replay``) a leading row may fall away and an older one lead again, so the state is the set of
live rows. Only pairs that a void, an erasure or a second revision touches are run through that way, arrival by arrival; all
others take the composable scan.
"""
import heapq
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType, TimestampType

from patronage.operators.intents import PAIR, _rank_struct
from patronage.sources.store import settle

ARRIVAL = ["created_at", "intent_id"]
EARLY = datetime(1, 1, 1, tzinfo=timezone.utc)
#: ``end`` and the state: null is closed; the maps of stretches.
MAPS = StructType([StructField("customer_id", StringType()), StructField("course_code", StringType()), StructField("_range", StringType()),
                   StructField("bar", TimestampType()), StructField("top", TimestampType()), StructField("end", TimestampType())])


def _later(a, b):
    return b if a is None else a if b is None else max(a, b)


def _rank(t, confidence, created, row_id):
    """Order of staff rows as a tuple that compares without nulls."""
    return (t or EARLY, confidence is not None, confidence or 0.0, created or EARLY, row_id or "")


def _steps(batches):
    """Rows in order: (first of a stretch, row, leading staff row or None) as dictionaries; the lead is that before the row."""
    key = lead = None
    for batch in batches:
        for row in batch.select(["customer_id", "course_code", "_range", "intent_id", "source", "lock_kind", "observed_at", "confidence", "created_at", "_past", "_open"]).to_pylist():
            now = (row["customer_id"], row["course_code"], row["_range"])
            first = now != key
            if first:
                key, past = now, row["_past"]
                lead = past and (_rank(past["observed_at"], past["confidence"], past["created_at"], past["intent_id"]), past["sticky"])
            yield first, row, lead
            if row["source"] == "staff":
                own = (_rank(row["observed_at"], row["confidence"], row["created_at"], row["intent_id"]), row["lock_kind"] == "sticky")
                lead = own if lead is None or own[0] > lead[0] else lead
        yield None, batch, None


def _opens(row, lead) -> bool:
    return lead is None or (not lead[1] and (row["observed_at"] or EARLY) > lead[0][0])


def _moved(state, row, lead):
    """The state after a row: a staff row closes what it leads, a machine row that is taken opens."""
    t = row["observed_at"] or EARLY
    if row["source"] == "staff":
        now = t if lead is None else max(t, lead[0][0])
        return state if state is not None and state > now else None
    return max(state, t) if state is not None else t if _opens(row, lead) else None


def _fold(batches):
    """The map of each stretch."""
    key, bar, top, end, out = None, None, None, None, []

    def told():
        return pa.RecordBatch.from_pylist([dict(zip(MAPS.names, (*key, bar, top, end)))], schema=pa.schema(
            [(n, pa.string()) for n in MAPS.names[:3]] + [(n, pa.timestamp("us", tz="UTC")) for n in MAPS.names[3:]]))

    for first, row, lead in _steps(batches):
        if first is None:
            continue
        if first:
            if key:
                yield told()
            key, bar, top, end = (row["customer_id"], row["course_code"], row["_range"]), None, None, None
        end = _moved(end, row, lead)
        t = row["observed_at"] or EARLY
        if row["source"] == "staff":
            led = t if lead is None else max(t, lead[0][0])
            bar = bar if top is not None and top > led else _later(bar, led)
        else:
            top = _later(top, t)
    if key:
        yield told()


def _judge(names):
    def run(batches):
        state, verdicts = None, []
        for first, row, lead in _steps(batches):
            if first is None:
                yield pa.RecordBatch.from_arrays([*(row.column(c) for c in names), pa.array(verdicts, pa.string())], names=[*names, "rejection"])
                verdicts = []
                continue
            if first:
                state = row["_open"]
            refused = row["source"] == "ai" and state is None and lead is not None
            verdicts.append(None if not refused else "staff_sticky" if lead[1] else "staff_decided" if not _opens(row, lead) else None)
            state = _moved(state, row, lead)

    return run


def staff_verdicts(df: DataFrame, arrival: list = ARRIVAL) -> DataFrame:
    """Replay arrivals in ``arrival`` order, (created_at, intent_id) as a rule; adds ``rejection``: ``staff_sticky``, ``staff_decided`` or null."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = settle(df.where("customer_id is not null").repartitionByRange(n, *PAIR, *arrival).withColumn("_range", F.format_string("%09d", F.spark_partition_id())))
    staff = F.when(F.col("source") == "staff", _rank_struct((F.col("lock_kind") == "sticky").alias("sticky")))
    past = Window.partitionBy(*PAIR).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy(*PAIR, "_range").agg(F.max(staff).alias("lead"))
    # Pairs that span ranges: as many rows as ranges, however many arrivals.
    spans = settle(parts.withColumns({"_past": F.max("lead").over(past), "parts": F.count("*").over(Window.partitionBy(*PAIR))}).where("parts > 1").drop("lead", "parts"))
    order = [*PAIR, "_range", *arrival]

    def begun(rows, starts, how):
        """Rows with what their stretch begins in, stretch by stretch and in order."""
        s = starts.select(F.col("customer_id").alias("_c"), F.col("course_code").alias("_k"), F.col("_range").alias("_r"), "_past", "_open")
        same = (F.col("customer_id") == F.col("_c")) & F.col("course_code").eqNullSafe(F.col("_k")) & (F.col("_range") == F.col("_r"))
        return rows.join(s, same, how).drop("_c", "_k", "_r").repartition(n, "_range").sortWithinPartitions(*order)

    closed = F.lit(None).cast("timestamp")
    maps = begun(ranged, spans.withColumn("_open", closed), "inner").mapInArrow(_fold, MAPS)
    listed = maps.groupBy(*PAIR).agg(F.array_sort(F.collect_list(F.struct("_range", "bar", "top", "end"))).alias("maps"))

    def through(state, m):
        kept = state.isNotNull() & (m["bar"].isNull() | (state > m["bar"]))
        return F.when(kept, F.greatest(state, m["top"])).otherwise(m["end"])

    # The state before each of a pair's ranges: one fold over its ranges.
    step = lambda acc, m: F.struct(through(acc["now"], m).alias("now"), F.concat(acc["seen"], F.array(F.struct(m["_range"].alias("_range"), acc["now"].alias("_open")))).alias("seen"))
    zero = F.struct(closed.alias("now"), F.array().cast("array<struct<_range:string,_open:timestamp>>").alias("seen"))
    states = listed.select(*PAIR, F.explode(F.aggregate("maps", zero, step, lambda a: a["seen"])).alias("s")).select(*PAIR, F.col("s._range").alias("_range"), F.col("s._open").alias("_open"))
    st = states.select(F.col("customer_id").alias("_c"), F.col("course_code").alias("_k"), F.col("_range").alias("_r"), "_open")
    starts = settle(spans.join(st, (F.col("customer_id") == F.col("_c")) & F.col("course_code").eqNullSafe(F.col("_k")) & (F.col("_range") == F.col("_r")), "left").drop("_c", "_k", "_r"))
    judged = begun(ranged, starts, "left").mapInArrow(_judge(df.columns), StructType([*df.schema.fields, StructField("rejection", StringType())]))
    return judged.unionByName(df.where("customer_id is null").withColumn("rejection", F.lit(None).cast("string")))


# --- retractions -----------------------------------------------------------------------------


def _replayed(batches):
    """Arrival by arrival over the live rows of a pair; ``kind``: intent, void, erase."""
    key, live, heap = None, {}, []
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            now = (r["customer_id"], r["course_code"])
            if now != key:
                key, live, heap = now, {}, []
            reason, done = None, True
            if r["kind"] == "intent":
                staff = r["source"] == "staff"
                while heap and live.get(heap[0][-1], (None,))[0] != heap[0]:
                    heapq.heappop(heap)
                top = heap[0] if heap else None
                if top is not None and top[-1] == r["event_id"]:  # a revision is compared with the others
                    others = sorted(v[0] for k, v in live.items() if k != r["event_id"] and v[0] is not None)
                    top = others[0] if others else None
                if not staff and top is not None and top[1]:
                    sticky = live[top[-1]][1]
                    reason = "staff_sticky" if sticky else "staff_decided" if (r["observed_at"] or EARLY).timestamp() <= -top[0] else None
                if reason is None:
                    gone = r["event_id"] in live and live[r["event_id"]][0] is None
                    entry = None if gone else (-(r["observed_at"] or EARLY).timestamp(), -int(staff), -(r["confidence"] or 0.0), -r["seq"], r["event_id"])
                    live[r["event_id"]] = (entry, r["lock_kind"] == "sticky")
                    if entry:
                        heapq.heappush(heap, entry)
            elif r["kind"] == "void":
                done = r["event_id"] in live
                if done:
                    live[r["event_id"]] = (None, False)
            else:
                done, live, heap = bool(live), {}, []
            out.append({"seq": r["seq"], "kind": r["kind"], "event_id": r["event_id"], "customer_id": r["customer_id"], "course_code": r["course_code"], "rejection": reason, "hit": done})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("seq", pa.int64()), ("kind", pa.string()), ("event_id", pa.string()), ("customer_id", pa.string()), ("course_code", pa.string()), ("rejection", pa.string()), ("hit", pa.bool_())]))


REPLAY = "seq long, kind string, event_id string, customer_id string, course_code string, rejection string, hit boolean"


def replay(arrivals: DataFrame) -> DataFrame:
    """(seq, kind, event_id, customer_id, course_code, rejection, hit) of every arrival, with what later arrivals take back.

    ``arrivals``: seq, kind (intent, void, erase), event_id (of the row itself, or of the row that a void takes back), customer_id,
    course_code, source, lock_kind, observed_at, confidence. ``rejection`` is for intents, ``hit`` says whether a void or an erasure
    met something that is held.
    """
    intents = arrivals.where("kind = 'intent'")
    pairs = intents.select(*PAIR).distinct()
    where = intents.groupBy("event_id").agg(F.min(F.struct("seq", *PAIR)).alias("at")).select("event_id", F.col("at.customer_id").alias("customer_id"), F.col("at.course_code").alias("course_code"))
    voids = arrivals.where("kind = 'void'").drop(*PAIR).join(where, "event_id")
    erased = arrivals.where("kind = 'erase'").drop("course_code").join(pairs, "customer_id")
    back = settle(voids.select(*arrivals.columns).unionByName(erased.select(*arrivals.columns)))
    revised = intents.groupBy(*PAIR, "event_id").agg(F.count("*").alias("n")).where("n > 1").select(*PAIR)
    touched = settle(back.select(*PAIR).unionByName(revised).distinct())
    same = lambda a: (a["customer_id"] == F.col("_c")) & a["course_code"].eqNullSafe(F.col("_k"))
    t = touched.select(F.col("customer_id").alias("_c"), F.col("course_code").alias("_k"))
    one_by_one = intents.join(t, same(intents), "left_semi").unionByName(back)
    told = one_by_one.repartition(*PAIR).sortWithinPartitions(*PAIR, "seq", "kind", "event_id").mapInArrow(_replayed, REPLAY)
    rest = intents.join(t, same(intents), "left_anti").withColumns({"intent_id": F.col("event_id"), "created_at": F.timestamp_seconds("seq")})
    scanned = staff_verdicts(rest).select("seq", "kind", "event_id", *PAIR, "rejection", F.lit(True).alias("hit"))
    return told.unionByName(scanned)
