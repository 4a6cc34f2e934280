"""Running a stream over tables to its present end, as often as asked, on one checkpoint."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.sources.kept import shared_folder

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A table as a stream of its files; path may be a folder, a file or a pattern."""
    schema = spark.read.parquet(path).schema
    source = path if "*" in path or not path.endswith(".parquet") else path.removesuffix(".parquet") + "*.parquet"
    return spark.readStream.schema(schema).options(**options).parquet(source)


def place(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def drained(stream: DataFrame, at: str, mode: str = "append") -> DataFrame:
    """Processes what is there, in as many batches as the source makes of it, and returns all rows so far. Checkpoint and
    rows lie at `at`: a second call with the same one resumes there. State is in RocksDB, so it may exceed memory."""
    spark = stream.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").option("path", f"{at}/rows").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


def timed(events: DataFrame, column: str = "ts") -> DataFrame:
    """The column as an instant; timestamps without a zone are read in the session's."""
    return events.withColumn(column, F.col(column).cast("timestamp"))
