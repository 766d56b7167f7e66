"""Structured Streaming twins of the batch jobs.

Late rows are handled by commuting rules (minimum, maximum, revision), not by dropping them; only
deduplication and rate windows use a watermark, which also bounds their state. Tables that a stream maintains
are change rows: batch n adds the new state of the keys it touches as version n, and replaces that version when it is replayed.
"""
from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from patronage.operators.events import land_webhooks
from patronage.operators.intents import PAIR, _rank_struct, current_intents
from patronage.operators.precedence import ARRIVAL, staff_verdicts
from patronage.sources.store import settle, shared_folder


def workspace(spark, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/stream-{name}-{uuid.uuid4().hex}"


class ChangeRows:
    """A keyed table as change rows under a shared folder, one partition a micro-batch; a key's largest version is its state.

    A batch writes as many rows as keys it touches, whatever the size of the table. Nothing is kept in the driver: after a
    restart the versions are found in the folder.
    """

    def __init__(self, empty: DataFrame, folder: str, key: list):
        self.empty, self.folder, self.key = empty, folder, key

    def _rows(self) -> DataFrame:
        spark, schema = self.empty.sparkSession, StructType([*self.empty.schema.fields, StructField("version", LongType())])
        try:
            return spark.read.schema(schema).parquet(self.folder)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], schema)

    def _state(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in self.empty.columns if c not in self.key]
        return rows.groupBy(*self.key).agg(F.max_by(F.struct(*rest), "version").alias("r")).select(*self.key, "r.*").select(*self.empty.columns)

    def before(self, batch_id: int, touched: DataFrame) -> DataFrame:
        """What the keys of ``touched`` hold before a batch."""
        keys = touched.select(*[F.col(k).alias(f"_{k}") for k in self.key]).distinct()
        rows = self._rows().where(F.col("version") < batch_id)
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in self.key])
        return self._state(rows.join(keys, same, "left_semi"))

    def write(self, df: DataFrame, batch_id: int) -> None:
        (df.select(*self.empty.columns).withColumn("version", F.lit(batch_id).cast("long")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(self.folder))

    def latest(self) -> DataFrame:
        return self._state(self._rows())

    def compact(self, to: str) -> "ChangeRows":
        """The same table in a new folder, with one row a key."""
        new = ChangeRows(self.empty, to, self.key)
        version = self._rows().agg(F.max("version")).first()[0]
        if version is not None:
            new.write(self.latest(), version)
        return new


def drain(query) -> None:
    """Wait for an availableNow query and surface its failure."""
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def ingest(raw: DataFrame, out: str, checkpoint: str):
    """Webhook bodies to deduplicated, content-free inbound rows."""
    rows = land_webhooks(raw).withWatermark("received_at", "30 days").dropDuplicatesWithinWatermark(["event_id", "provider"])
    return (rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())


def fold_contacts(events: DataFrame, table: ChangeRows, checkpoint: str):
    """First and last contact per chat user; a late event still moves the first contact back."""
    msg = F.when(F.col("event_type") == "message", F.col("occurred_at"))
    totals = events.where(F.col("event_type").isin("follow", "unfollow", "message") & F.col("line_user_id").isNotNull()).groupBy("line_user_id").agg(
        F.min("occurred_at").alias("first_interaction_at"), F.max("occurred_at").alias("last_interaction_at"), F.min(msg).alias("first_message_at"))

    return totals.writeStream.outputMode("update").foreachBatch(table.write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_current_intents(intents: DataFrame, table: ChangeRows, checkpoint: str):
    """Current opinion per (customer, course): stored winners compete with the batch."""
    def merge(batch: DataFrame, batch_id: int) -> None:
        table.write(current_intents(table.before(batch_id, batch).unionByName(batch)), batch_id)

    return intents.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


VERDICT = "intent_id string, rejection string"
LOCKED = ["intent_id", "observed_at", "created_at", "source", "confidence", "lock_kind"]


def staff_lock(intents: DataFrame, out: str, checkpoint: str):
    """Verdict on every machine opinion against the person's lock, one folder a batch under ``out``.

    What is kept is the current row of each pair, as change rows beside the checkpoint. It arrives before the batch's rows, which
    are then replayed as in the batch job: a hot pair spreads over many tasks.
    """
    owned = intents.where("customer_id is not null and voided_at is null").select(*PAIR, *LOCKED)
    held = ChangeRows(intents.sparkSession.createDataFrame([], owned.schema), f"{checkpoint}-held", PAIR)

    def judge(batch: DataFrame, batch_id: int) -> None:
        new = settle(batch)
        rows = held.before(batch_id, new).withColumn("_turn", F.lit(0)).unionByName(new.withColumn("_turn", F.lit(1)))
        judged = settle(staff_verdicts(rows, ["_turn", *ARRIVAL]))
        top = judged.where("rejection is null").groupBy(*PAIR).agg(F.max(_rank_struct("source", "lock_kind")).alias("w"))
        held.write(top.select(*PAIR, *[f"w.{c}" for c in LOCKED]), batch_id)
        judged.where("_turn = 1").select("intent_id", "rejection").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return owned.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def request_counts(log: DataFrame, key: str, at: str, limit: int, window: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Calls per key and window with the number over the limit."""
    g = log.withWatermark(at, late).groupBy(F.window(at, window), key).agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("window_start"), key, "n", F.greatest(F.lit(0), F.col("n") - limit).alias("refused"))


def error_spikes(errors: DataFrame, at: str, threshold: int, window: str = "15 minutes", slide: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Sliding windows in which errors reach the threshold."""
    g = errors.withWatermark(at, late).groupBy(F.window(at, window, slide)).agg(F.count("*").alias("n"))
    return g.where(F.col("n") >= threshold).select(F.col("window.start").alias("window_start"), "n")


def run_to_table(df: DataFrame, name: str, key: list) -> DataFrame:
    """Run a windowed stream over what is available and return its rows; windows behind the watermark leave the state."""
    spark = df.sparkSession
    folder = workspace(spark, name)
    table = ChangeRows(spark.createDataFrame([], df.schema), f"{folder}/rows", key)
    drain(df.writeStream.outputMode("update").foreachBatch(table.write).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start())
    return table.latest()


def mirror(changes: DataFrame, table: ChangeRows, key: str, scrub, checkpoint: str):
    """Scrubbed mirror fed by a change stream of source rows; the newest version of a row wins."""
    def merge(batch: DataFrame, batch_id: int) -> None:
        rest = [c for c in batch.columns if c not in (key, "updated_at")]
        newest = batch.groupBy(key).agg(F.max(F.struct("updated_at", F.struct(*rest).alias("r"))).alias("t")).select(key, "t.updated_at", "t.r.*")
        old = table.before(batch_id, newest).select(key, F.col("source_updated_at").alias("_held"))
        fresh = newest.join(old, key, "left").where("_held is null or updated_at >= _held").drop("_held")
        table.write(scrub(fresh), batch_id)

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
