"""Drills: the pool of words to practise, lines of text, and the balance of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions import keypad

POOL, SHORTEST, LONGEST, PER_LINE = 12_000, 3, 9, 8


def pool(lex: DataFrame, most: int = POOL) -> DataFrame:
    """The best readable words of a lexicon; the limit is the feature. rank from 1."""
    good = lex.where(F.length("word").between(SHORTEST, LONGEST) & keypad.readable(F.col("word")))
    top = good.select("word", "seq", "score").orderBy(F.desc("score"), "word").limit(most)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "word")))


def lines(words: DataFrame, per_line: int = PER_LINE) -> DataFrame:
    """words(rank, word): lines of so many words, in order."""
    t = words.withColumn("line", F.expr(f"(rank - 1) div {per_line}"))
    return t.groupBy("line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]), " ").alias("text"))


def balance(words: DataFrame) -> DataFrame:
    """words(seq): presses of each key and their share in percent. At most ten rows reach the window."""
    n = words.select(F.explode(F.split("seq", "")).alias("key")).where("key <> ''").groupBy("key").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 9))


def report(words: DataFrame) -> DataFrame:
    """words(seq): all presses, the rarest and the commonest key (of equals the least), and how many presses repeat the
    one before them. One row; at most ten keys meet."""
    n = balance(words).select("key", "n")
    keys = n.agg(
        F.sum("n").alias("presses"), F.min_by("key", F.struct("n", "key")).alias("rarest"), F.min("n").alias("rarest_n"),
        F.min_by("key", F.struct(-F.col("n"), F.col("key"))).alias("commonest"), F.max("n").alias("commonest_n"),
    )
    doubled = words.agg(F.sum(keypad.repeats_in(F.col("seq"))).alias("doubled"))
    share = F.coalesce(F.round(100.0 * F.col("doubled") / F.nullif("presses", F.lit(0)), 9), F.lit(0.0))
    return keys.crossJoin(F.broadcast(doubled)).select("*", share.alias("doubled_share"))  # one row each
