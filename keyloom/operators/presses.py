"""Press streams in batch: multitap, marks, debounce."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.keypad import KEYS, MARKS, SYMBOLS

from . import scan


def presses(events: DataFrame, *also: str) -> DataFrame:
    """(user_id, event_id, ms, digit), and columns that come along."""
    return events.select("user_id", "event_id", *also, F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), (2 + F.pmod("event_id", F.lit(8))).cast("int").cast("string").alias("digit"))


def numbered(p: DataFrame, new: Column) -> DataFrame:
    """Presses with `run`, which grows where new holds. new reads before_ms and before_digit; a user of very many presses is
    dealt out to many tasks."""
    t = scan.previous(scan.dealt(p, ["user_id"], ["ms", "event_id"]), ["user_id"], "ms", "digit")
    return scan.running(t.withColumn("new", F.when(new, 1).otherwise(0)), ["user_id"], "new", "run")


def multitap(p: DataFrame, timeout_ms: int) -> DataFrame:
    """One letter per run of presses of a key that follow each other within the timeout."""
    same = (F.col("digit") == F.col("before_digit")) & (F.col("ms") - F.col("before_ms") <= timeout_ms)
    runs = numbered(p, ~F.coalesce(same, F.lit(False))).groupBy("user_id", "run").agg(F.min("digit").alias("digit"), F.count("*").alias("n"))
    letters = F.element_at(F.create_map(*[F.lit(x) for kv in KEYS.items() for x in kv]), F.col("digit"))
    return runs.select("user_id", "run", "digit", "n", F.substring(letters, (F.pmod(F.col("n") - 1, F.length(letters)) + 1).cast("int"), F.lit(1)).alias("letter"))


def marks(n):
    """The mark that n presses of key 1 in a row show."""
    return F.substring(F.lit(MARKS), (F.pmod(n - 1, F.lit(len(MARKS))) + 1).cast("int"), F.lit(1))


def debounced(p: DataFrame, pause_ms: int) -> DataFrame:
    """Groups of presses with no pause longer than pause_ms: when each is decoded."""
    near = F.col("ms") - F.col("before_ms") < pause_ms
    g = numbered(p, ~F.coalesce(near, F.lit(False))).withColumnRenamed("run", "g")
    return g.groupBy("user_id", "g").agg(F.count("*").alias("n"), F.max("ms").alias("last_ms"))


def symbols(digit, n):
    """The symbol that n presses of a key show in the symbol layer."""
    four = F.element_at(F.create_map(*[F.lit(x) for kv in SYMBOLS.items() for x in kv]), digit)
    return F.substring(four, (F.pmod(n - 1, F.length(four)) + 1).cast("int"), F.lit(1))
