"""Global ranks without a global task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import dealt, joined


def ranked(rows: DataFrame, by: list[str], order: list[Column | str], name: str = "rank") -> DataFrame:
    """rows with their rank, from 0, within the groups of by. Rows are dealt out by ranges of by and order, so that a
    large group lies in many tasks; each numbers its own, and adds how many of the group lie in tasks before it."""
    t = dealt(rows, by, order)
    own = t.groupBy(*by, "_part").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    own = own.select(*by, "_part", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return joined(t, own, [*by, "_part"]).select(*rows.columns, (F.col("_before") + F.col("_id") - F.col("_first")).alias(name))
