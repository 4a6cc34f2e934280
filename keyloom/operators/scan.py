"""Ordered scans of groups that may be larger than a task.

Rows are dealt out by ranges of group and order, so that a large group lies in many tasks. Each part is scanned by itself;
what it hands on (its last row, its sum, the composition of its steps) makes a few rows a group, and these are scanned in
turn to say what each part starts from.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.sources.kept import kept

BLOCK = 256  # rows whose steps are composed in one row


def dealt(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    """rows in order, with _part, where they lie, and _id, which ascends within the group."""
    t = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    # Written, as ranges drawn anew for a second reading could differ. The id holds the partition and the place in it.
    return kept(t.withColumn("_id", F.monotonically_increasing_id()), "dealt").withColumn("_part", F.shiftright("_id", 33))


def joined(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """A join in which null groups are groups like others."""
    b = b.select(*[F.col(c).alias(f"_on_{c}") for c in on], *[c for c in b.columns if c not in on])
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on])
    return a.join(b, same).drop(*[f"_on_{c}" for c in on])


def previous(t: DataFrame, by: list[str], *columns: str) -> DataFrame:
    """dealt rows with, for each of the columns, its value in the row before, as before_<column>; null in a group's first."""
    row = F.struct(*columns)
    ends = t.groupBy(*by, "_part").agg(F.max_by(row, "_id").alias("_end"))
    ends = ends.select(*by, "_part", F.lag("_end").over(Window.partitionBy(*by).orderBy("_part")).alias("_handed"))
    own = Window.partitionBy(*by, "_part").orderBy("_id")
    t = joined(t.select("*", F.lag(row).over(own).alias("_own"), F.row_number().over(own).alias("_nth")), ends, [*by, "_part"])
    row = F.when(F.col("_nth") == 1, F.col("_handed")).otherwise(F.col("_own"))
    return t.select("*", *[row[c].alias(f"before_{c}") for c in columns]).drop("_own", "_nth", "_handed")


def running(t: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """dealt rows with the sum of value up to and with each."""
    sums = t.groupBy(*by, "_part").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_handed"))
    own = F.sum(value).over(Window.partitionBy(*by, "_part").orderBy("_id"))
    return joined(t.withColumn("_own", own), sums, [*by, "_part"]).withColumn(name, F.col("_own") + F.col("_handed")).drop("_own", "_handed")


def _starts(steps: Column, start: Column) -> Column:
    """The state before each step of an array of steps; a step is an array that holds the next state of each state."""
    empty = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
    run = F.aggregate(steps, empty, lambda a, s: F.struct(F.get(s, a["at"]).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))
    return run["out"]


def _composed(steps: Column, n: int) -> Column:
    """One step that does them all."""
    return F.aggregate(steps, F.array(*[F.lit(k) for k in range(n)]), lambda m, s: F.transform(m, lambda x: F.get(s, x)))


def states(rows: DataFrame, by: list[str], order: list, step: Column, n: int, start: int = 0) -> DataFrame:
    """rows with `state`, that of a machine with n states before each row of its group. step: an array with the next state
    of each state. Steps compose in any grouping, so blocks of rows, parts and groups are each one step of the next."""
    t = dealt(rows.withColumn("_step", step), by, order)
    row = F.struct(*rows.columns)
    blocks = t.groupBy(*by, "_part", F.expr(f"_id div {BLOCK}").alias("_block")).agg(F.array_sort(F.collect_list(F.struct("_id", "_step", row.alias("row")))).alias("rows"))
    of = lambda c, name: F.transform(c, lambda x: x[name])
    blocks = kept(blocks.withColumn("_map", _composed(of("rows", "_step"), n)), "blocks")
    parts = blocks.groupBy(*by, "_part").agg(F.array_sort(F.collect_list(F.struct("_block", "_map"))).alias("blocks"))
    parts = parts.withColumn("_map", _composed(of("blocks", "_map"), n))
    groups = parts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_part", "_map"))).alias("parts"))
    begun = F.arrays_zip(of("parts", "_part").alias("_part"), _starts(of("parts", "_map"), F.lit(start)).alias("start"))
    groups = groups.select(*by, F.explode(begun).alias("x")).select(*by, F.col("x._part").alias("_part"), F.col("x.start").alias("start"))
    parts = joined(parts, groups, [*by, "_part"])
    begun = F.arrays_zip(of("blocks", "_block").alias("_block"), _starts(of("blocks", "_map"), F.col("start")).alias("start"))
    parts = parts.select(*by, "_part", F.explode(begun).alias("x")).select(*by, "_part", F.col("x._block").alias("_block"), F.col("x.start").alias("start"))
    t = joined(blocks, parts, [*by, "_part", "_block"])
    each = F.arrays_zip(of("rows", "row").alias("row"), _starts(of("rows", "_step"), F.col("start")).alias("state"))
    return t.select(F.explode(each).alias("x")).select("x.row.*", F.col("x.state").alias("state"))
