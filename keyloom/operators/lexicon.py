"""Lookups over a lexicon of key sequences."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COMPLETIONS = 4096


def prefixes(lex: DataFrame) -> DataFrame:
    """Each word under every proper prefix of its sequence, so that prefix lookups are equi-joins."""
    return lex.select("*", F.explode(F.sequence(F.lit(1), F.length("seq"))).alias("k")).withColumn("query", F.expr("substring(seq, 1, k)"))


def candidates(asked: DataFrame, lex: DataFrame, limit: int = 8) -> DataFrame:
    """asked(query): exact words in stored order, then the best of the first completions by pos."""
    hit = asked.where("query <> ''").join(prefixes(lex), "query").withColumn("exact", F.col("query") == F.col("seq"))
    # Words are placed by their keys, so the completions of a query stand together: the first of them lie below a place.
    start = hit.where("not exact").groupBy("query").agg(F.min("pos").alias("start"))
    hit = hit.join(start, "query", "left").where(F.col("exact") | (F.col("pos") < F.col("start") + COMPLETIONS))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("exact"), F.when(F.col("exact"), F.col("pos")), F.desc("score"), "pos"))
    return hit.withColumn("rank", rank).where(F.col("rank") <= limit).select("query", "rank", "word", "score", "exact")


def exact_ranks(lex: DataFrame, limit: int = 8) -> DataFrame:
    """(query, word, rank, exact): the exact words of every sequence among its candidates; they come first there."""
    rank = F.row_number().over(Window.partitionBy("seq").orderBy("pos"))
    return lex.select(F.col("seq").alias("query"), "word", rank.alias("rank"), F.lit(True).alias("exact")).where(F.col("rank") <= limit)


def contains(words: DataFrame, lex: DataFrame) -> DataFrame:
    return words.join(lex.select("word"), "word", "left_semi")


def has_prefix(asked: DataFrame, lex: DataFrame) -> DataFrame:
    """live: some sequence starts with the first 15 keys of the query."""
    known = prefixes(lex).where("k <= 15").select(F.col("query").alias("p")).distinct().withColumn("hit", F.lit(True))
    return asked.withColumn("p", F.expr("substring(query, 1, 15)")).join(known, "p", "left").select("query", ((F.col("query") == "") | F.coalesce("hit", F.lit(False))).alias("live"))


def user_words(events: DataFrame, cap: int = 1000) -> DataFrame:
    """events(user_id, word): uses, for stores that stay within their capacity."""
    return events.groupBy("user_id", "word").agg(F.least(F.count("*"), F.lit(cap)).alias("uses"))


def first_words(lex: DataFrame) -> DataFrame:
    return lex.groupBy("seq").agg(F.min_by("word", "pos").alias("word"), F.min_by("score", "pos").alias("score"))


def exact_reading(asked: DataFrame, lex: DataFrame) -> DataFrame:
    """asked(keys): best exact word per group between zeros; null where a group has none. Keys without groups have no row.

    The vocabulary is bounded, so it is sent to the keys, each of which stays in one row: groups taken apart would meet the
    words by a join, the commonest in one task, and would be shuffled to come together again."""
    sent = asked.sparkSession.sparkContext.broadcast(first_words(lex).select("seq", "word").toArrow())

    def run(batches):
        word = dict(zip(*[sent.value.column(c).to_pylist() for c in ("seq", "word")]))
        for b in batches:
            some, out = [], []
            for keys in b.column(0).to_pylist():
                if got := [word.get(g) for g in (keys or "").split("0") if g]:
                    some.append(keys)
                    out.append(None if None in got else " ".join(got))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array(out, pa.string())], ["keys", "reading"])

    return asked.select("keys").mapInArrow(run, "keys string, reading string")
