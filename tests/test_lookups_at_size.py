"""Lookups whose vocabulary is sent to the rows: nothing is joined by a word or a sequence that very many rows have."""

import contextlib
import io
import random
from itertools import product

from pyspark.sql import functions as F

from keyloom.functions import keypad
from keyloom.operators import lexicon, users
from keyloom.plans import more, registry

WORDS = ["".join(w) for n in (1, 2, 3, 4) for w in product("abcd", repeat=n)][:220]  # very many have the same keys
LEX = "word string, n long, seq string, score int, pos int"


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def test_exact_reading_keeps_keys_in_one_row(spark):
    lex = spark.createDataFrame([("cat", 5, "228", 9, 0), ("act", 3, "228", 8, 1), ("the", 9, "843", 10, 2)], LEX)
    asked = spark.createDataFrame([("8430228",), ("228",), ("8430",), ("00843002280",), ("84302",), ("0",), ("",), (None,)], "keys string")
    got = lexicon.exact_reading(asked, lex)
    assert {r["keys"]: r.reading for r in got.collect()} == {"8430228": "the cat", "228": "cat", "8430": "the", "00843002280": "the cat", "84302": None}
    assert "Join" not in plan(got) and "Exchange" not in plan(got)


def written(spark, at, turns):
    rows = [(c, t, "assistant" if t and t % 2 else "user", text) for c, t, text in turns]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{at}/conversations.parquet")
    rng = random.Random(1)
    said = " ".join(rng.choice(WORDS[::2]) for _ in range(300))
    spark.createDataFrame([(0, "en", said), (1, "pl", "kot")], "doc_id long, lang string, text string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(0, "ad")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def turns(seed=3):
    rng = random.Random(seed)
    said = lambda: " ".join(rng.choice([*WORDS, "don't", "42"]) for _ in range(rng.randint(0, 60)))
    return [(c, t, said()) for c in range(4) for t in range(6)] + [(0, 0, "ad be ad"), (None, 0, "ad"), (7, None, "ad be"), (8, 0, None), (9, 0, "abc " * 1100)]


def test_warm_costs_equal_the_merged_candidates(spark, tmp_path):
    d = written(spark, tmp_path, turns())
    words, lex, by = more._query_words(spark, d), registry._lex(spark, d).localCheckpoint(), ["conv_id", "turn"]
    seq = keypad.sequence_of(F.col("word"))
    uses = words.withColumn("seq", seq).where("seq is not null").groupBy(*by, "word", "seq").agg(F.least(F.count("*"), F.lit(1000)).alias("uses"))
    key = F.struct(*by).alias("user_id")
    asked = uses.select(key, F.col("seq").alias("query")).distinct()
    mine = users.user_candidates(asked, uses.select(key, "word", "seq", "uses"))
    found = users.merged(asked, mine, lexicon.candidates(asked.select("query").distinct(), lex)).select("user_id.*", "query", "rank", "word", "exact")
    costs = users.word_costs(words.distinct(), found, *by)
    sums = words.join(costs, [*by, "word"]).groupBy(*by).agg(*[F.sum(c).alias(c) for c in users.COST])
    want = {(r.conv_id, r.turn): (r.presses + r.words - 1, r.characters + r.words - 1, r.words, r.matched, r["first"], r.next_presses, r.spelt) for r in sums.collect()}
    got = {(r.conv_id, r.turn): tuple(r[c] for c in users.COST) for r in registry.queries()["o81_warm_cost"](spark, d).collect()}
    assert got == want and len(got) > 10 and any(w[6] for w in want.values())


def test_own_words_equal_the_merged_candidates(spark, tmp_path):
    d = written(spark, tmp_path, turns(4))
    asked = more._asked(spark, d)
    want = users.merged(asked, more._mine(spark, d), lexicon.candidates(asked.select("query").distinct(), registry._lex(spark, d)))
    got = registry.queries()["o36_merged"](spark, d)
    assert {r.user_id for r in got.collect()} >= {None, 0, 1, 2, 3, 9}
    assert got.columns == want.columns and [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_users_do_not_meet_by_what_they_ask(spark, tmp_path):
    d = written(spark, tmp_path, turns(5))
    at = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("o36_merged", "o81_warm_cost"):
            # Joins by a query that are no broadcast: none may have rows of users on a side.
            lines = plan(registry.queries()[name](spark, d)).splitlines()
            near = ["".join(lines[k : k + 6]) for k, x in enumerate(lines) if "SortMergeJoin" in x and "query" in x]
            assert not [x for x in near if "user_id" in x or "conv_id" in x], name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", at)
