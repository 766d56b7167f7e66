"""Helpers that several of the operators use."""
from __future__ import annotations

import tempfile
import uuid

import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Texts of one processing slice inside a task, in bytes; bounds the working memory of numpy code.
SLICE_BYTES = 2 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset, as in tests, a new local one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    The table outlives any executor, so later steps neither recompute nor lose it.
    """
    path = f"{shared_folder(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def slices(sizes, limit: int = SLICE_BYTES):
    """Consecutive (start, end) index ranges whose sizes add up to about ``limit``; a larger item stands alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def text_batches(batches, column: str = "text"):
    """Cut Arrow batches so that each holds about ``SLICE_BYTES`` of text; yields (batch, list of texts, null as empty)."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        for a, b in slices(lengths):
            part = batch.slice(a, b - a)
            yield part, [x or "" for x in part.column(column).to_pylist()]
