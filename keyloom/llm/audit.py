"""Filter interaction audit: what each of five filters removes, at every place of every order of them.

Documents become counts by part and pattern of failures; a CUBE over the part and the five flags turns these into the
survivors of every subset of filters: they are the rows of the grouping set that has just the flags of the
subset, where all of them are false. A step removes what survives the subset before it and not the one after it, so
steps join pairs of subsets. Only patterns, never documents, reach the cube.

Defined results: a null text is empty; a null lang is the empty part; documents with the same doc_id and text are
rows of their own, none earlier than the other; a null doc_id is earlier than none and none is earlier than it; repeated
labels of a doc_id count once, 1 if any of them is 1. Texts are told apart by their SHA-256. No documents, no rows.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

FILTERS = "ABCDE"
SUBSETS = range(1 << len(FILTERS))
COUNTS = ["n", "good", "toxic"]


def failures(text: Column) -> dict[str, Column]:
    """The conditions of the filters that look at one text."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {"A": n < 100, "B": 100 * distinct < 80 * n, "C": 100 * capitals > 10 * F.length(text), "D": text.rlike(r"[#$%&*|]")}


def flagged(docs: DataFrame) -> DataFrame:
    """doc_id, part, hash of the text, the flags A to D, and the number of such rows."""
    t = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("hash"), *[c.alias(k) for k, c in failures(F.col("text")).items()])
    return t.groupBy(*t.columns).agg(F.count("*").alias("n"))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    one = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.join(one, "doc_id", "left").select(*rows.columns, known("good"), known("toxic"))


def patterns(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, flags A to E, and how many documents, good ones and toxic ones have them. Copies of a text differ by part and
    labels only, so each text is down to a few rows before its first copy is looked for."""
    rows = labelled(flagged(docs), labels)
    same = ["hash", "part", *FILTERS[:-1], "good", "toxic"]
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    lost = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0))
    copies = rows.groupBy(*same).agg(F.sum("n").alias("n"), first.alias("first"), lost.alias("unnumbered"))
    copies = copies.withColumn("least", F.min("first.doc_id").over(Window.partitionBy("hash")))
    firsts = F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0) + F.col("unnumbered")
    each = copies.select(*same[1:], F.explode(F.array(F.struct(F.lit(False).alias("E"), firsts.alias("n")), F.struct(F.lit(True).alias("E"), (F.col("n") - firsts).alias("n")))).alias("x"))
    each = each.select(*same[1:], "x.*").where("n > 0")
    return each.groupBy("part", *FILTERS).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def bit(f: str) -> int:
    return 1 << FILTERS.index(f)


def survivors(found: DataFrame) -> DataFrame:
    """For each part and subset of filters (a bit each): how many documents, good and toxic ones pass them all."""
    cube = found.cube("part", *FILTERS).agg(F.grouping("part").alias("pooled"), *[F.grouping(f).alias(f"all_{f}") for f in FILTERS], *[F.sum(c).alias(c) for c in COUNTS])
    passed = [(F.col(f"all_{f}") == 1) | ~F.col(f) for f in FILTERS]
    subset = sum((F.when(F.col(f"all_{f}") == 0, bit(f)).otherwise(0) for f in FILTERS), F.lit(0))
    for c in passed:
        cube = cube.where(c)
    got = cube.where("pooled = 0").select("part", subset.alias("subset"), *COUNTS)
    every = got.where("subset = 0").select("part", F.explode(F.array(*[F.lit(s) for s in SUBSETS])).alias("subset"))
    return every.join(got, ["part", "subset"], "left").select("part", "subset", *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS])


def steps() -> list[tuple[str, int, int, int]]:
    """Every order, its steps, and the subsets of filters before and after each step."""
    out = []
    for order in permutations(FILTERS):
        held = 0
        for k, f in enumerate(order, 1):
            out.append(("".join(order), k, held, held | bit(f)))
            held |= bit(f)
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    spark = docs.sparkSession
    # A few rows, written as the subsets below are read from it several times: the texts are read once.
    got = survivors(written(patterns(docs, labels), "patterns"))
    whole = (1 << len(FILTERS)) - 1
    # The pairs of subsets that a filter joins, with how many orders take that step: 5 * 16 rows a part.
    pairs = [(f, s, s | bit(f), factorial(s.bit_count()) * factorial(len(FILTERS) - 1 - s.bit_count())) for f in FILTERS for s in SUBSETS if not s & bit(f)]
    pairs = spark.createDataFrame(pairs, "filter string, before int, after int, orders int")
    ends = lambda side: got.select("part", F.col("subset").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in COUNTS])
    moved = pairs.join(ends("before"), "before").join(ends("after"), ["part", "after"])
    moved = moved.select("part", "filter", "before", "after", F.col("n_after").alias("kept"), (F.col("n_before") - F.col("n_after")).alias("removed"), "orders", *[(F.col(f"{c}_before") - F.col(f"{c}_after")).alias(f"{c}_lost") for c in COUNTS[1:]])
    over = Window.partitionBy("part", "filter")
    alone = F.max(F.when(F.col("before") == 0, F.col("removed"))).over(over)  # all that fail the filter
    last = F.max(F.when(F.col("after") == whole, F.col("removed"))).over(over)  # those that fail no other
    moved = moved.select("*", (alone - F.col("removed")).alias("redundant"), last.alias("unique_fails"), F.sum(F.col("orders") * F.col("removed")).over(over).alias("shapley"))
    taken = spark.createDataFrame(steps(), "filter_order string, step int, before int, after int")
    out = taken.join(moved, ["before", "after"])
    return out.select("part", "filter_order", "step", *[F.col(c).cast("long").alias(c) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")])
