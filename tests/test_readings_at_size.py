"""Readings, failures and pairs of lines that stay in one row: equal to plain ones, without a shuffle of words."""

from collections import Counter

from pyspark.sql import functions as F

from keyloom.operators import accuracy, context, languages

ROWS = [(1, "en", "the cat sat on the mat\nthe cat 12 sat"), (2, "fr", "le chat et le chat"), (3, None, "the 7up cat"), (4, "en", "")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def lexicon(spark, rows):
    t = spark.createDataFrame(rows, "lang string, word string, score int")
    return t.select("*", F.lit(1).alias("n"), F.translate("word", "abcdefghijklmnopqrstuvwxyz", "22233344455566677778889999").alias("seq"), F.row_number().over(languages.Window.partitionBy("lang").orderBy("word")).alias("pos"))


def test_attempts_and_readings_shuffle_nothing(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, lang string, text string").repartition(64).localCheckpoint()
    t = accuracy.attempts(languages.worded(docs))
    got = accuracy.readings(t, lexicon(spark, [("en", "cat", 255), ("en", "the", 240)]).localCheckpoint())
    assert "Exchange" not in plan(t) and "Exchange" not in plan(got) and "Join" not in plan(got)
    assert {(r.doc_id, r.pos, r.part): (r.wanted, r["keys"]) for r in t.collect()} == {
        (1, 0, 0): (["the", "cat", "sat", "on"], "8430228072806" + "6"), (1, 0, 1): (["the", "mat"], "8430628"), (1, 1, 0): (["the", "cat", "sat"], "8430228" + "0728"),
        (2, 0, 0): (["le", "chat", "et", "le"], "530242803805" + "3"), (2, 0, 1): (["chat"], "2428"), (3, 0, 0): (["the", "cat"], "8430228"),
    }
    assert {r.doc_id: (r.known, r.typed, r.read) for r in got.where("doc_id = 3").collect()} == {3: ([True, True], None, ["the", "cat"])}


def test_failures_are_counted_in_the_tasks_that_find_them(spark):
    lexs = lexicon(spark, [("en", "cat", 255)])
    t = spark.createDataFrame([(k, 0, 0, "en", ["act"], "228") for k in range(500, 0, -1)], "doc_id long, pos int, part int, lang string, wanted array<string>, keys string").repartition(3)
    rows = spark.createDataFrame([("x", k % 50, 0, 0, k, str(k)) for k in range(300)], "kind string, doc_id long, pos int, part int, at int, example string").coalesce(1)
    few = accuracy.counted(rows, 2).collect()
    assert sum(r.n for r in few) == 300 and [r.example for r in few][:2] == ["0", "50"] and len(few) == 2
    assert {r.kind: r.n for r in accuracy.failures(accuracy.readings(t, lexs)).collect()}["not in the dictionary"] == 500


def test_pairs_of_lines_need_no_window(spark):
    rows = languages.worded(spark.createDataFrame(ROWS, "doc_id long, lang string, text string"))
    lexs = spark.createDataFrame([("en", w) for w in "the cat sat on mat".split()] + [("fr", "le"), ("fr", "chat")], "lang string, word string")
    got = languages.pairs(rows, lexs)
    assert "Window" not in plan(got)
    want = Counter([("en", "the", "cat")] * 2 + [("en", "cat", "sat"), ("en", "sat", "on"), ("en", "on", "the"), ("en", "the", "mat")] + [("fr", "le", "chat")] * 2)
    assert {(r.lang, r.prev, r.word): r.n for r in got.collect()} == want
    assert {(r.lang, r.prev, r.word): r.n for r in languages.pairs(languages.tokens_of(rows), lexs).collect()} == want


def test_context_is_read_without_joining_pairs_to_groups(spark):
    lexs = lexicon(spark, [("en", "act", 200), ("en", "cat", 200), ("en", "the", 240)]).localCheckpoint()
    pairs = spark.createDataFrame([("en", "the", "cat", 2.0)], "lang string, prev string, word string, score double").localCheckpoint()
    asked = spark.createDataFrame([("en", "8430228"), ("en", "228"), ("en", "9999"), ("fr", "228")], "lang string, keys string")
    got = context.read_in_context(asked, lexs, pairs)
    assert "Join" not in plan(got) and "Exchange" not in plan(got)
    assert {r["keys"]: r.reading for r in got.collect()} == {"8430228": "the cat", "228": "act"}
