"""Sources: tables, text lines, tab-separated records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores at least: a small file is one split, whatever is done with its rows.
    A table of many splits stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, pos, line), pos from 0."""
    return spread(docs.select("doc_id", "lang", "text")).select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def typing_record(spark: SparkSession, path: str) -> DataFrame:
    """source, at, pad, target, keys, millis; rows with another number of fields are dropped, and a number that
    is none is null."""
    f = F.split("value", "\t", -1)
    rows = spark.read.text(path).where((F.size(f) == 6) & ~F.col("value").startswith("source\t"))
    return rows.select(f[0].alias("source"), f[1].try_cast("int").alias("at"), f[2].alias("pad"), f[3].alias("target"), f[4].alias("keys"), F.transform(F.filter(F.split(f[5], ","), lambda x: x != ""), lambda x: x.try_cast("long")).alias("millis"))


def query_corpus(spark: SparkSession, path: str) -> DataFrame:
    """query, language, note; blank lines, comments and the header are skipped."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").startswith("#") & ~F.col("value").startswith("query\t"))
    return rows.select(f[0].alias("query"), F.get(f, F.lit(1)).alias("language"), F.get(f, F.lit(2)).alias("note"))
