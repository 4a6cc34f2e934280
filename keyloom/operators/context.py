"""Readings in context: the best path through the words that the keys could mean, pair by pair."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .languages import ALTERNATIVES, CONTEXT, FREQUENCY, log_probability


def choices(lexs: DataFrame, most: int = ALTERNATIVES) -> DataFrame:
    """(lang, seq, word, j, worth): the first words of each sequence of a language, and what each is worth alone."""
    j = F.row_number().over(Window.partitionBy("lang", "seq").orderBy("pos")) - 1
    t = lexs.withColumn("j", j).where(F.col("j") < most)
    return t.select("lang", "seq", "word", "j", (FREQUENCY * log_probability(F.col("score"))).alias("worth"))


def path(groups: list[list], known: dict, lang: str) -> tuple[list[str], float]:
    """groups of (word, worth) and scores of (lang, before, word): the words of the best path and its score; of equals the one
    whose last word stands first, then the one before it. A pair that is not known is worth nothing more."""
    state = [(worth, [word]) for word, worth in groups[0]]
    for words in groups[1:]:
        ends = []
        for word, worth in words:
            over = [score + (worth + known.get((lang, got[-1], word), 0.0)) for score, got in state]
            best = max(over)
            ends.append((best, [*state[over.index(best)][1], word]))
        state = ends
    best = max(score for score, _ in state)
    return next((got, score) for score, got in state if score == best)


def read_in_context(asked: DataFrame, lexs: DataFrame, pairs: DataFrame, weight: float = CONTEXT) -> DataFrame:
    """asked(lang, keys), each once: the best reading of its groups of keys in its language, with its score; none where a
    group spells nothing. Vocabularies and pair tables are bounded and sent to the tasks: joined to the groups, each group
    would carry the pairs of all its words through a shuffle."""
    context = asked.sparkSession.sparkContext
    sent = context.broadcast((choices(lexs).select("lang", "seq", "j", "word", "worth").toArrow(), pairs.select("lang", "prev", "word", (weight * F.col("score")).alias("score")).toArrow()))

    def run(batches):
        some, table = sent.value
        words: dict[tuple, list] = {}
        for lang, seq, word, worth in zip(*[some.sort_by("j").column(c).to_pylist() for c in ("lang", "seq", "word", "worth")]):
            words.setdefault((lang, seq), []).append((word, worth))
        known = {(lang, prev, word): score for lang, prev, word, score in zip(*[table.column(c).to_pylist() for c in ("lang", "prev", "word", "score")])}
        for b in batches:
            out = []
            for lang, keys in zip(b.column("lang").to_pylist(), b.column("keys").to_pylist()):
                groups = [words.get((lang, g)) for g in keys.split("0") if g]
                if groups and None not in groups:
                    got, score = path(groups, known, lang)
                    out.append((lang, keys, " ".join(got), score))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.string(), pa.float64()))], ["lang", "keys", "reading", "score"])

    return asked.select("lang", "keys").mapInArrow(run, "lang string, keys string, reading string, score double").withColumn("score", F.round("score", 9))
