"""Keystrokes per character."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.functions import keypad

from .lexicon import exact_ranks
from .users import spelt


def word_cost(words: DataFrame, lex: DataFrame, limit: int = 8) -> DataFrame:
    """words(word): presses when found among the candidates, else when spelt letter by letter."""
    asked = words.select("word", keypad.sequence_of(F.col("word")).alias("query")).distinct()
    t = asked.join(exact_ranks(lex, limit).drop("exact"), ["query", "word"], "left")
    return t.select("word", F.coalesce(F.length("query") + F.col("rank") - 1, spelt(F.col("word"))).cast("long").alias("presses"), F.col("rank").isNull().alias("spelt"))
