"""Settled intermediates, keyed snapshots and manifests on plain parquet."""
import tempfile
import uuid

from pyspark.sql import DataFrame, functions as F


def shared_folder(spark) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="patronage-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def spread(df: DataFrame) -> DataFrame:
    """Let row-heavy parsing use every core when a small input arrives in fewer splits than cores.

    Meant for plain scans. A large input has more splits than cores and passes without a shuffle.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def settle(df: DataFrame) -> DataFrame:
    """Write a result that several later steps read, and continue from the written table.

    It is computed once, survives lost executors and keeps later plans short.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def upsert(old: DataFrame, new: DataFrame, key: list) -> DataFrame:
    """Whole-row replace by key: the snapshot after ``new`` is written over ``old``."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def replace_children(old: DataFrame, new: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """Drop every child row of a changed parent, then add the current ones."""
    return old.join(changed.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def prune(mirror: DataFrame, source: DataFrame, key: str) -> tuple:
    """Mirror rows whose source still exists, and the ones that vanished."""
    ids = source.select(key)
    return mirror.join(ids, key, "left_semi"), mirror.join(ids, key, "left_anti")


def mapping_upsert(mappings: DataFrame, updates: DataFrame) -> tuple:
    """Lead mapping maintenance: rows with an unknown course code are refused, the rest upserted."""
    from patronage.functions.courses import known_code
    ok = F.col("course_code").isNull() | known_code(F.col("course_code")).isNotNull()
    return (upsert(mappings, updates.where(ok), ["match_on", "match_value"]), updates.where(~ok))


def run_manifest(people: DataFrame, payments: DataFrame, enrollments: DataFrame, skipped: DataFrame, run_id: str) -> DataFrame:
    """One row of counts for an import run."""
    n = lambda df: df.agg(F.count("*")).scalar()
    return people.sparkSession.range(1).select(
        F.lit(run_id).alias("run_id"), n(people).alias("people"), n(payments).alias("payments"),
        n(enrollments).alias("enrollments"), n(skipped).alias("skipped"))
