"""Corpus to lexicon: tokens, weighted counts, pairs, scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions import keypad
from keyloom.sources.tables import lines

from . import scan
from .ranks import ranked

TITLE_WEIGHT, VOCABULARY, PAIR_FLOOR, PAIR_KEEP = 20, 120_000, 3, 400_000  # fixed values
LONG = 15  # fixed value: from here on a length needs an escape


def normalised(docs: DataFrame) -> DataFrame:
    return lines(docs).withColumn("line", keypad.normalise(F.col("line")))


def worded(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, pos, words): the words of each line."""
    return normalised(docs).select("doc_id", "lang", "pos", F.filter(F.split("line", " "), lambda w: w != "").alias("words"))


def tokens_of(rows: DataFrame) -> DataFrame:
    """(doc_id, lang, pos, i, word, seq) of worded lines; seq is null where a token can't be typed."""
    return rows.select("doc_id", "lang", "pos", F.posexplode("words").alias("i", "word")).withColumn("seq", keypad.sequence_of(F.col("word")))


def tokens(docs: DataFrame) -> DataFrame:
    return tokens_of(worded(docs))


def cut(words, n: int):
    """An array in pieces of n, the last one shorter: a row each, with its number as part."""
    pieces = F.transform(F.sequence(F.lit(0), ((F.size(words) - 1) / n).cast("int")), lambda k: F.slice(words, k * n + 1, F.lit(n)))
    return F.posexplode(F.when(F.size(words) > 0, pieces)).alias("part", "words")


def fragments(docs: DataFrame, n: int = 4) -> DataFrame:
    """(doc_id, lang, pos, part, words): the typeable words of each line in groups of n. A line is one row, so nothing is
    shuffled."""
    t = normalised(docs)
    typeable = F.filter(F.split("line", " "), lambda w: (w != "") & keypad.typeable(w))
    t = t.select("doc_id", "lang", "pos", typeable.alias("ws"))
    return t.select("doc_id", "lang", "pos", cut(F.col("ws"), n))


def titles(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").alias("doc_id"), F.lit("en").alias("lang"), "text")


def word_count(docs: DataFrame, benchmark: DataFrame, weight: int = TITLE_WEIGHT) -> DataFrame:
    return counted(tokens(docs), benchmark, weight)


def counted(toks: DataFrame, benchmark: DataFrame, weight: int = TITLE_WEIGHT) -> DataFrame:
    both = toks.select("lang", "word", "seq", F.lit(1).alias("weight")).unionByName(tokens(titles(benchmark)).select("lang", "word", "seq", F.lit(weight).alias("weight")))
    return both.where("seq is not null").groupBy("lang", "word").agg(F.sum("weight").alias("n"))


def lexicon(counts: DataFrame, limit: int = VOCABULARY) -> DataFrame:
    """(word, n, seq, score, pos) of one language: the commonest words, placed by their keys, then by use."""
    # Ranks are written, so what is read again below is the ranked table, not the counts.
    top = ranked(counts.select("word", "n"), [], [F.desc("n"), F.col("word")]).where(F.col("rank") < limit)
    most = top.agg(F.max("n").alias("most"))  # one row
    score = F.least(F.lit(255), F.greatest(F.lit(1), 1 + (254 * F.log(1 + F.col("n")) / F.log(1 + F.col("most"))).cast("int")))
    top = top.crossJoin(F.broadcast(most)).select("word", "n", keypad.sequence_of(F.col("word")).alias("seq"), score.alias("score"))
    return ranked(top, [], [F.col("seq"), F.desc("n"), F.col("word")], "pos").withColumn("pos", F.col("pos").cast("int"))


def pair_count(docs: DataFrame, lex: DataFrame) -> DataFrame:
    return paired(tokens(docs), lex)


def paired(toks: DataFrame, lex: DataFrame) -> DataFrame:
    """Adjacent pairs on a line; a token outside the vocabulary ends a pair."""
    # The vocabulary is bounded, so it is sent to the tokens: a join by word would meet the commonest in one task.
    seen = toks.join(F.broadcast(lex.select("word", F.lit(True).alias("known"))), "word", "left")
    w = Window.partitionBy("doc_id", "pos").orderBy("i")
    pairs = seen.select("word", "known", F.lag("word").over(w).alias("prev"), F.lag("known").over(w).alias("before"))
    return pairs.where("known and before").groupBy("prev", "word").agg(F.count("*").alias("n"))


def pmi(pairs: DataFrame, counts: DataFrame, floor: int = PAIR_FLOOR, keep: int = PAIR_KEEP) -> DataFrame:
    total = counts.agg(F.sum("n").alias("t"))
    top = pairs.where(F.col("n") >= floor).orderBy(F.desc("n"), "prev", "word").limit(keep)
    one = lambda name, n: counts.select(F.col("word").alias(name), F.col("n").alias(n))
    rows = top.join(one("prev", "a"), "prev").join(one("word", "b"), "word").crossJoin(F.broadcast(total))  # one row
    x = F.log((F.col("n") / F.col("t")) / ((F.col("a") / F.col("t")) * (F.col("b") / F.col("t"))))
    return rows.select("prev", "word", "n", F.round(F.least(F.lit(8.0), F.greatest(F.lit(-2.0), x)), 9).alias("pmi"))


def ambiguity(counts: DataFrame) -> DataFrame:
    by = counts.groupBy(keypad.sequence_of(F.col("word")).alias("seq")).agg(F.count("*").alias("words"), F.sum("n").alias("n"), F.max("n").alias("first"))
    return by.agg(F.count("*").alias("sequences"), F.sum(F.when(F.col("words") > 1, F.col("words")).otherwise(0)).alias("sharing"), F.round(100.0 * F.sum("first") / F.sum("n"), 9).alias("first_choice"))


def fnv(c) -> object:
    """Signed FNV-1a 64 over the code points (whole, not bytes), in decimals so that nothing overflows."""
    units = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x))

    def step(h, b):
        low = F.pmod(h, F.lit(65536).cast("decimal(38,0)")).cast("int")
        mixed = (h - low.cast("decimal(20,0)") + low.bitwiseXOR(b).cast("decimal(20,0)")).cast("decimal(20,0)")
        wide = F.pmod(mixed * F.lit("435").cast("decimal(3,0)") + F.pmod(mixed, F.lit("16777216").cast("decimal(20,0)")) * F.lit("1099511627776").cast("decimal(14,0)"), F.lit("18446744073709551616").cast("decimal(20,0)"))
        return wide.cast("decimal(20,0)")

    h = F.aggregate(units, F.lit("14695981039346656037").cast("decimal(20,0)"), step)
    return F.when(h >= F.lit("9223372036854775808").cast("decimal(20,0)"), h - F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(h).cast("long")


def front_coded(lex: DataFrame, every: int = 32) -> DataFrame:
    """pos, word and the letters shared with the previous word (0 at each checkpoint); bounded vocabulary."""
    prev = F.lag("word", 1, "").over(Window.partitionBy(F.expr(f"pos div {every}")).orderBy("pos"))
    t = lex.select("pos", "word", prev.alias("p"))
    n = F.least(F.length("word"), F.length("p"))
    tests = [F.when((n >= k) & (F.substring("word", 1, k) == F.substring("p", 1, k)), k).otherwise(0) for k in range(1, 33)]
    return t.select("pos", "word", reduce(lambda a, b: F.greatest(a, b), tests).alias("shared"))


def layout(lex: DataFrame, every: int = 32) -> DataFrame:
    """The front-coded entries of a lexicon: letters shared with the word before (none at a checkpoint), letters that follow,
    whether either needs an escape, the bytes of the entry (a head of one byte, or three, the letters, the score) and
    where it starts. Offsets come from an ordered scan."""
    prev = F.lag("word", 1, "").over(Window.partitionBy(F.expr(f"pos div {every}")).orderBy("pos"))
    t = lex.select("pos", "word", prev.alias("p"))
    same = F.zip_with(F.split("word", ""), F.split("p", ""), lambda a, b: F.coalesce(a == b, F.lit(False)))
    apart = F.array_position(same, False)
    shared = F.when(F.col("p") == "", F.lit(0)).otherwise(F.when(apart > 0, apart - 1).otherwise(F.length("word"))).cast("int")
    t = t.select("pos", "word", shared.alias("shared")).withColumn("suffix", (F.length("word") - F.col("shared")).cast("int"))
    t = t.withColumn("escaped", (F.col("shared") >= LONG) | (F.col("suffix") >= LONG)).withColumn("size", F.when(F.col("escaped"), 3).otherwise(1) + F.col("suffix") + 1)
    t = scan.running(scan.dealt(t, [], ["pos"]), [], "size", "end")
    return t.select("pos", "word", "shared", "suffix", "escaped", "size", (F.col("end") - F.col("size")).alias("offset"))
