"""Tables between the steps of a job, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="keyloom-")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset the warehouse, or, with one machine only, a folder of this process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = _own_folder() if spark.sparkContext.master.startswith("local") else spark.conf.get("spark.sql.warehouse.dir")
    return at.rstrip("/") + "/keyloom"


def kept(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: what is used several times is computed once, and a lost
    executor takes nothing with it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
