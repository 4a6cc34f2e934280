"""Letter case of a stream of words: lower, the next word only, or locked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions import keypad

from .scan import states

CASES = ["lower", "once", "locked"]  # fixed values, in the order in which the key goes through them
SHIFT, WORD, OTHER = "shift", "word", "other"


def step(kind: Column) -> Column:
    """Next states of the three: the key moves on and around; a word spends `once`; all else leaves the case alone."""
    to = lambda *s: F.array(*[F.lit(x) for x in s])
    return F.when(kind == SHIFT, to(1, 2, 0)).when(kind == WORD, to(0, 0, 2)).otherwise(to(0, 1, 2))


def applied(word: Column, case: Column) -> Column:
    return F.when(case == CASES[1], keypad.once(word)).when(case == CASES[2], F.upper(word)).otherwise(word)


def cased(gestures: DataFrame, by: list[str], order: list) -> DataFrame:
    """gestures(*by, kind, word, ...): the case that each meets, and the word as it is written. However many gestures a
    user has, they are dealt out to many tasks."""
    t = states(gestures, by, order, step(F.col("kind")), len(CASES))
    case = F.element_at(F.array(*[F.lit(c) for c in CASES]), F.col("state") + 1)
    return t.withColumn("case", case).withColumn("written", F.when(F.col("kind") == WORD, applied(F.col("word"), F.col("case")))).drop("state")
