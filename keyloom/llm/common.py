"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, the
    warehouse, or in local mode, where there is one machine only, a temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        local = spark.sparkContext.master.startswith("local")
        at = "file://" + tempfile.mkdtemp(prefix="keyloom-") if local else spark.conf.get("spark.sql.warehouse.dir")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/keyloom/{tag}-{uuid.uuid4().hex}"
    # What is written is durable, so the shuffle files behind it go at once rather than at some later GC.
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and whole text, null texts as empty ones; small Arrow batches as texts can be long."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def named(docs: DataFrame) -> DataFrame:
    """texts() with doc_id as a string: pandas would turn numbers beside a null into floats."""
    return texts(docs).withColumn("doc_id", F.col("doc_id").cast("string"))


def renumbered(out: DataFrame, like: DataFrame, *names: str) -> DataFrame:
    """Columns that travelled as strings get the type of doc_id (or of the named column of like) again."""
    for c in names or ("doc_id",):
        out = out.withColumn(c, F.col(c).cast(like.schema[c].dataType if c in like.columns else "long"))
    return out


MIX = np.uint64(0x9E3779B97F4A7C15)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys.view(np.uint64) * MIX) >> np.uint64(24)) % np.uint64(buckets)


def packed(keys: np.ndarray, buckets: int, *columns: np.ndarray) -> pd.DataFrame:
    """One row per bucket of keys: the bytes of the keys and of the columns beside them, as a, b, c ..."""
    bucket = bucket_of(keys, buckets)
    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
    rows = []
    for k in np.flatnonzero(np.diff(bounds)):
        at = order[bounds[k] : bounds[k + 1]]
        rows.append((int(k), *[c[at].tobytes() for c in (keys, *columns)]))
    return pd.DataFrame(rows, columns=["bucket", *"abcdef"[: 1 + len(columns)]])
