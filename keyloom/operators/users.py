"""The learnt layer: words of each user, their lookup, the merge with a lexicon, and what typing costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions import keypad

from .lexicon import candidates, exact_ranks, prefixes

MOST_USES, LIMIT = 1000, 8
# Fields in which nothing is learnt.
PRIVATE = ("password", "email", "uri", "no_suggestions", "no_personalised_learning")


def learnable(events: DataFrame) -> DataFrame:
    """events(field, enabled, ...): those that may teach a word."""
    return events.where(F.col("enabled") & ~F.col("field").isin(*PRIVATE))


def store(events: DataFrame) -> DataFrame:
    """events(user_id, at, word, forget): uses of each word since it was last forgotten, for stores within
    their capacity; words that no keys spell are refused, upper case is folded."""
    e = events.withColumn("word", F.lower("word")).withColumn("seq", keypad.sequence_of(F.col("word"))).where("seq is not null and word <> ''")
    # One row per user, word and moment suffices: what is counted is those after the last tombstone.
    gone = e.where("forget").groupBy("user_id", "word").agg(F.max("at").alias("gone"))
    kept = e.where("not forget").join(gone, ["user_id", "word"], "left").where("gone is null or at > gone")
    return kept.groupBy("user_id", "word", "seq").agg(F.least(F.count("*"), F.lit(MOST_USES)).alias("uses"))


def listing(words: DataFrame) -> DataFrame:
    """The words of each user by rank: most used first, then by word."""
    w = Window.partitionBy("user_id").orderBy(F.desc("uses"), "word")
    return words.select("user_id", F.row_number().over(w).alias("rank"), "word", "uses")


def user_candidates(asked: DataFrame, words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """asked(user_id, query): exact words, then completions, by score; of equal scores by word."""
    rows = words.select("user_id", "word", "seq", F.least(F.lit(255), 200 + 20 * F.col("uses")).cast("int").alias("score"))
    hit = asked.where("query <> ''").join(prefixes(rows), ["user_id", "query"]).withColumn("exact", F.col("query") == F.col("seq"))
    w = Window.partitionBy("user_id", "query").orderBy(F.desc("exact"), F.desc("score"), "word")
    return hit.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("user_id", "query", "rank", "word", "score", "exact")


def merged(asked: DataFrame, mine: DataFrame, base: DataFrame, limit: int = LIMIT) -> DataFrame:
    """mine(user_id, query, rank, ...) and base(query, rank, ...), both within the limit. A word of both has
    the higher score and the place of the user's; then exact ones first, by score, in the order met."""
    both = mine.withColumn("layer", F.lit(0)).unionByName(asked.join(base, "query").withColumn("layer", F.lit(1)))
    one = both.groupBy("user_id", "query", "word").agg(F.max("score").alias("score"), F.max("exact").alias("exact"), F.min(F.struct("layer", "rank")).alias("met"))
    w = Window.partitionBy("user_id", "query").orderBy(F.desc("exact"), F.desc("score"), "met")
    return one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("user_id", "query", "rank", "word", "score", "exact")


def best_of_all(lex: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(query, base): what a lexicon offers for each prefix of its sequences, best first. A vocabulary is bounded, and so is this."""
    queries = prefixes(lex).select("query").distinct()
    best = candidates(queries, lex, limit).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "word", "score", "exact"))).alias("base"))
    return best.select("query", F.transform("base", lambda x: F.struct(x["word"].alias("word"), x["score"].alias("score"), x["exact"].alias("exact"))).alias("base"))


def mixed(mine: Column, base: Column, limit: int = LIMIT) -> Column:
    """Two arrays of (word, score, exact), best first, as one: a word of both has the higher score and the place of the
    user's; then exact ones first, by score, in the order met."""
    none = F.array().cast("array<struct<word:string,score:int,exact:boolean>>")
    entry = lambda layer: lambda x, i: F.struct((~x["exact"]).alias("later"), (-x["score"]).alias("lower"), F.lit(layer).alias("layer"), i.alias("i"), x["word"].alias("word"))

    def both(mine, base):
        lifted = F.transform(mine, lambda x: F.aggregate(base, x, lambda a, y: F.when(y["word"] == a["word"], F.struct(a["word"].alias("word"), F.greatest(a["score"], y["score"]).alias("score"), (a["exact"] | y["exact"]).alias("exact"))).otherwise(a)))
        held = F.transform(mine, lambda x: x["word"])
        others = F.filter(F.transform(base, entry(1)), lambda y: ~F.array_contains(held, y["word"]))
        return F.slice(F.array_sort(F.concat(F.transform(lifted, entry(0)), others)), 1, limit)

    # Each array is worked out once: an array of the two is taken apart inside.
    pair = F.array(F.struct(F.coalesce(mine, none).alias("mine"), F.coalesce(base, none).alias("base")))
    out = F.transform(pair, lambda p: both(p["mine"], p["base"]))[0]
    return F.transform(out, lambda x: F.struct(x["word"].alias("word"), (-x["lower"]).alias("score"), (~x["later"]).alias("exact")))


def asked_of_own(words: DataFrame, lex: DataFrame, short: int = 3, limit: int = LIMIT) -> DataFrame:
    """words(user_id, word, seq, uses): the merged candidates of each user's own words, asked for by their first keys and whole.

    Words stand under each prefix of their keys, dealt out once by user and first key, which all that can meet has in common;
    what is asked and what is found come out of one grouping. What the lexicon offers is bounded and sent to the rows, so no
    query that every user asks brings its rows together."""
    rows = words.select("user_id", F.substring("seq", 1, 1).alias("head"), "word", "seq", F.least(F.lit(255), 200 + 20 * F.col("uses")).cast("int").alias("score"))
    rows = rows.repartition("user_id", "head")
    by = ["user_id", "head", "query"]
    hit = prefixes(rows).withColumn("exact", F.col("k") == F.length("seq"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("exact"), F.desc("score"), "word"))
    hit = hit.withColumn("rank", rank).where(F.col("rank") <= limit)
    mine = hit.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("rank", "word", "score", "exact"))).alias("mine"))
    # Exact words come first, so a query that is some word's whole keys has one in front.
    mine = mine.where((F.length("query") == short) | F.col("mine")[0]["exact"])
    both = mine.join(F.broadcast(best_of_all(lex, limit)), "query", "left")
    # Rows without a user have no words of their own: they get what the lexicon offers.
    own = F.filter(F.transform("mine", lambda x: F.struct(x["word"].alias("word"), x["score"].alias("score"), x["exact"].alias("exact"))), lambda x: F.col("user_id").isNotNull())
    out = F.when(F.col("base").isNull(), own).otherwise(mixed(own, F.col("base"), limit))
    return both.select("user_id", "query", F.posexplode(out).alias("at", "x")).select("user_id", "query", (F.col("at") + 1).alias("rank"), "x.*")


COST = ["presses", "characters", "words", "matched", "first", "next_presses", "spelt"]


def word_costs(words: DataFrame, found: DataFrame, *by: str) -> DataFrame:
    """words(*by, word); found(*by, query, rank, word, exact): the seven parts of the cost of each word."""
    t = words.select(*by, "word", keypad.sequence_of(F.col("word")).alias("query"))
    exact = found.where("exact").select(*by, "query", "word", "rank")
    t = t.join(exact, [*by, "query", "word"], "left")
    return _costs(t, "query", *by)


def _costs(t: DataFrame, query: str, *also: str) -> DataFrame:
    hit = F.col("rank").isNotNull()
    return t.select(
        *also, "word", F.when(hit, F.length(query) + F.col("rank") - 1).otherwise(spelt(F.col("word"))).cast("long").alias("presses"),
        F.length("word").cast("long").alias("characters"), F.lit(1).cast("long").alias("words"), hit.cast("long").alias("matched"),
        F.coalesce((F.col("rank") == 1).cast("long"), F.lit(0)).cast("long").alias("first"), F.coalesce(F.col("rank") - 1, F.lit(0)).cast("long").alias("next_presses"), (~hit).cast("long").alias("spelt"),
    )


def spelt(word):
    """Presses to spell a word letter by letter: one to switch, and the place of each letter on its key."""
    table = F.create_map(*[F.lit(x) for k in keypad.KEYS.values() for n, c in enumerate(k, 1) for x in (c, n)])
    return 1 + F.aggregate(F.filter(F.split(word, ""), lambda c: c != ""), F.lit(0), lambda s, c: s + F.coalesce(F.try_element_at(table, F.lower(c)), F.lit(1)))


def _spaced(sums: DataFrame) -> DataFrame:
    spaces = F.col("words") - 1
    return sums.withColumn("presses", F.col("presses") + spaces).withColumn("characters", F.col("characters") + spaces)


def warm_costs(words: DataFrame, lex: DataFrame, *by: str, limit: int = LIMIT) -> DataFrame:
    """words(*by, word, one row for each time it is typed): the sums of the parts of the cost of each query after its own words
    were learnt in a store of its own, with one press and one character for each space between words; kspc is 0 where nothing
    is typed. Only words of the same keys decide a word's place, as exact ones come first, so the words of a query are dealt out
    once, by their keys, and what the lexicon has for these is bounded and sent to them."""
    t = words.dropna(subset=list(by)).select(*by, "word", keypad.sequence_of(F.col("word")).alias("seq")).repartition(*by, "seq")
    score = F.least(F.lit(255), 200 + 20 * F.least("n", F.lit(MOST_USES))).cast("int")
    t = t.groupBy(*by, "seq", "word").agg(F.count("*").alias("n"))
    t = t.groupBy(*by, "seq").agg(F.array_sort(F.collect_list(F.struct((-score).alias("lower"), "word", "n"))).alias("own"))
    base = exact_ranks(lex, limit).join(lex.select("word", "score"), "word").groupBy(F.col("query").alias("seq"))
    base = base.agg(F.array_sort(F.collect_list(F.struct("rank", "word", "score"))).alias("base")).where("seq <> ''")
    exact = lambda c, score: F.transform(c, lambda x: F.struct(x["word"].alias("word"), score(x).alias("score"), F.lit(True).alias("exact")))
    t = t.join(F.broadcast(base), "seq", "left")
    mine = F.slice(exact("own", lambda x: -x["lower"]), 1, limit)
    found = F.when(F.col("seq").isNotNull(), F.transform(mixed(mine, exact("base", lambda x: x["score"]), limit), lambda x: x["word"]))
    t = t.select(*by, "seq", "own", F.explode(F.array(found)).alias("found")).select(*by, "seq", "found", F.explode("own").alias("x")).select(*by, "seq", "x.word", "x.n", F.nullif(F.array_position("found", F.col("x.word")), F.lit(0)).alias("rank"))
    costs = _costs(t, "seq", *by, "n")
    return kspc(_spaced(costs.groupBy(*by).agg(*[F.sum(F.col("n") * F.col(c)).alias(c) for c in COST])))


def kspc(costs: DataFrame) -> DataFrame:
    return costs.withColumn("kspc", F.coalesce(F.round(F.col("presses") / F.nullif(F.col("characters"), F.lit(0)), 9), F.lit(0.0)))


def pooled(costs: DataFrame) -> DataFrame:
    """The costs of all queries in one row."""
    return kspc(costs.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in COST]))
