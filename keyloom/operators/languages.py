"""Lexicons of several languages side by side, and what they read from the keys of a word."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions import keypad
from keyloom.sources.kept import kept
from keyloom.sources.tables import lines

from .corpus import PAIR_FLOOR, PAIR_KEEP, TITLE_WEIGHT, VOCABULARY, fnv, titles
from .ranks import ranked

ALTERNATIVES = 4  # words of one source that share the keys
ACTIVE, OTHER = 0.65, 0.35  # how far the language in use and each other one are trusted
FREQUENCY, CONTEXT = 0.5, 1.0  # weights of a word's frequency and of the word before it
NATS = 15.0  # what the steps of a score span, as a log-probability
LEAST, MOST = -2.0, 8.0  # bounds of the information in a pair


def worded(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, pos, words): the words of each line, read by the alphabet of its language. A null lang is the empty one."""
    t = lines(docs.withColumn("lang", F.coalesce("lang", F.lit(""))))
    words = F.filter(F.split(keypad.normalise_in(F.col("line"), F.col("lang")), " "), lambda w: w != "")
    return t.select("doc_id", "lang", "pos", words.alias("words"))


def tokens_of(rows: DataFrame) -> DataFrame:
    """(doc_id, lang, pos, i, word, seq) of worded lines; seq is null where a token can't be typed."""
    return rows.select("doc_id", "lang", "pos", F.posexplode("words").alias("i", "word")).withColumn("seq", keypad.sequence_in_any(F.col("word")))


def tokens(docs: DataFrame) -> DataFrame:
    return tokens_of(worded(docs))


@dataclass
class Corpus:
    """Lines as words, and counts, each written once, and what is built from them."""

    lines: DataFrame  # doc_id, lang, pos, words: a row a line, so that what stands in a line needs no shuffle
    tokens: DataFrame
    counts: DataFrame  # lang, word, n: of words that can be typed
    lexicons: DataFrame  # lang, word, n, seq, score, pos


def build(docs: DataFrame, benchmark: DataFrame, vocabulary: int = VOCABULARY) -> Corpus:
    rows = kept(worded(docs), "lines")
    toks = tokens_of(rows)
    some = [(toks, 1), (tokens(titles(benchmark)), TITLE_WEIGHT)]
    both = [t.where("seq is not null").groupBy("lang", "word").agg(F.sum(F.lit(w)).alias("n")) for t, w in some]
    counts = kept(both[0].unionByName(both[1]).groupBy("lang", "word").agg(F.sum("n").alias("n")), "counts")
    return Corpus(rows, toks, counts, kept(lexicons(counts, vocabulary), "lexicons"))


def score(n: Column, most: Column) -> Column:
    return F.least(F.lit(255), F.greatest(F.lit(1), 1 + (254 * F.log(1 + n) / F.log(1 + most)).cast("int")))


def lexicons(counts: DataFrame, vocabulary: int = VOCABULARY) -> DataFrame:
    """The commonest words of each language, all languages at once, placed by their keys, then by use."""
    top = ranked(counts, ["lang"], [F.desc("n"), F.col("word")]).where(F.col("rank") < vocabulary).drop("rank")
    most = top.groupBy("lang").agg(F.max("n").alias("most"))  # a row a language
    top = top.join(most, "lang").select("lang", "word", "n", keypad.sequence_in_any(F.col("word")).alias("seq"), score(F.col("n"), F.col("most")).alias("score"))
    return ranked(top, ["lang"], [F.col("seq"), F.desc("n"), F.col("word")], "pos")


def entries(lexs: DataFrame) -> DataFrame:
    """(seq, entries): for each sequence its words in every language, by language and place. As many rows as the
    vocabularies, which are bounded, have sequences."""
    e = F.struct("lang", "pos", "word", "score")
    return lexs.groupBy("seq").agg(F.array_sort(F.collect_list(e)).alias("entries"))


def sources(found: Column) -> Column:
    """Of entries: one struct a language: its first word, that word's score, and up to ALTERNATIVES words."""
    names = F.array_distinct(F.transform(found, lambda e: e["lang"]))

    def one(name: Column) -> Column:
        mine = F.filter(found, lambda e: e["lang"] == name)
        return F.struct(name.alias("source"), mine[0]["word"].alias("word"), mine[0]["score"].alias("score"), F.transform(F.slice(mine, 1, ALTERNATIVES), lambda e: e["word"]).alias("alternatives"))

    return F.transform(names, one)


def log_probability(points: Column) -> Column:
    return (points - 255) * NATS / 254.0


def worth(points: Column, prior: Column) -> Column:
    return FREQUENCY * log_probability(points) + F.log(prior)


def best(choices: Column, prior) -> Column:
    """The word of the source that is worth most; of equals, of the first language. prior: of a source's name."""
    by = F.transform(choices, lambda s: F.struct((-worth(s["score"], prior(s["source"]))).alias("cost"), s["source"].alias("source"), s["word"].alias("word")))
    return F.array_min(by)["word"]


def trusted(active: Column, share: float = ACTIVE, rest: float = OTHER):
    return lambda source: F.when(source == active, F.lit(share)).otherwise(F.lit(rest))


def exact_readings(asked: DataFrame, lexs: DataFrame) -> DataFrame:
    """asked(lang, seq): a row for each source that spells seq: its reading, the alternatives to it, and what the
    frequency of the reading and the trust in the source, given the language in use, are worth."""
    t = asked.join(entries(lexs).select("seq", sources(F.col("entries")).alias("found")), "seq").select("lang", "seq", F.explode("found").alias("s"))
    prior = trusted(F.col("lang"))(F.col("s.source"))
    return t.select("lang", "seq", "s.source", "s.word", F.array_join("s.alternatives", " ").alias("alternatives"), F.round(log_probability(F.col("s.score")), 9).alias("frequency"), F.round(F.log(prior), 9).alias("prior"))


def pairs(toks: DataFrame, lexs: DataFrame) -> DataFrame:
    """(lang, prev, word, n): adjacent words of a line, from tokens or, without a window over them, from worded lines; a token
    outside the vocabulary ends a pair."""
    if "words" in toks.columns:
        return adjacent(toks, lexs.select("lang", "word"))
    # The vocabularies are bounded, so they are sent to the tokens: a join by word would meet the commonest in one task.
    seen = toks.join(F.broadcast(lexs.select("lang", "word", F.lit(True).alias("known"))), ["lang", "word"], "left")
    w = Window.partitionBy("doc_id", "pos").orderBy("i")
    near = seen.select("lang", "word", "known", F.lag("word").over(w).alias("prev"), F.lag("known").over(w).alias("before"))
    return near.where("known and before").groupBy("lang", "prev", "word").agg(F.count("*").alias("n"))


def adjacent(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(by, prev, word, n) of rows(words): vocabulary(by, word) is bounded and sent to the pairs, so only those of known words
    are shuffled, and each task counts its own first."""
    by = [c for c in vocabulary.columns if c != "word"]
    two = F.transform(F.slice("words", F.lit(2), F.size("words")), lambda w, i: F.struct(F.get("words", i).alias("prev"), w.alias("word")))
    t = rows.select(*by, F.explode(two).alias("p")).select(*by, "p.prev", "p.word")
    known = lambda c: F.broadcast(vocabulary.select(*by, F.col("word").alias(c)))
    t = t.join(known("prev"), [*by, "prev"], "left_semi").join(known("word"), [*by, "word"], "left_semi")
    return t.groupBy(*by, "prev", "word").agg(F.count("*").alias("n"))


def pair_table(found: DataFrame, counts: DataFrame, floor: int = PAIR_FLOOR, keep: int = PAIR_KEEP) -> DataFrame:
    """(lang, prev, word, n, pmi, step, hash, place): the commonest pairs of each language, with their information in
    254 steps between the least and the greatest of the language, placed by signed hash. Fails where there is none."""
    t = ranked(found.where(F.col("n") >= floor), ["lang"], [F.desc("n"), F.col("prev"), F.col("word")]).where(F.col("rank") < keep).drop("rank")
    total = counts.groupBy("lang").agg(F.sum("n").alias("t"))  # a row a language
    one = lambda name, n: counts.select("lang", F.col("word").alias(name), F.col("n").alias(n))
    t = t.join(one("prev", "a"), ["lang", "prev"]).join(one("word", "b"), ["lang", "word"]).join(total, "lang")
    x = F.log((F.col("n") / F.col("t")) / ((F.col("a") / F.col("t")) * (F.col("b") / F.col("t"))))
    t = kept(t.select("lang", "prev", "word", "n", F.round(F.least(F.lit(MOST), F.greatest(F.lit(LEAST), x)), 9).alias("pmi")), "pairs")
    span = t.groupBy("lang").agg(F.min("pmi").alias("lo"), F.max("pmi").alias("hi"))
    if span.isEmpty():
        raise ValueError(f"no pair occurs {floor} times")
    width = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(F.lit(1.0))
    step = F.least(F.lit(255), F.greatest(F.lit(1), 1 + (254 * (F.col("pmi") - F.col("lo")) / width).cast("int")))
    t = t.join(span, "lang").select("lang", "prev", "word", "n", "pmi", step.alias("step"), fnv(F.concat_ws(" ", "prev", "word")).alias("hash"), F.round(F.col("lo") + (step - 1) * width / 254.0, 9).alias("score"))
    return ranked(t, ["lang"], ["hash", "prev", "word"], "place")
