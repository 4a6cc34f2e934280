"""Small reports: measured error model, pads, pace, drills, entry layout, word jumps, record and query files."""

import math
import statistics

import pytest
from pyspark.sql import functions as F

from keyloom.functions import keypad
from keyloom.operators import align, corpus, drill, evaluate, lexicon
from keyloom.sources.tables import query_corpus, spread, typing_record


def test_error_model_is_what_the_records_show(spark):
    rows = [("a", "2230", "220"), ("b", "4560", "4560"), ("c", "22", "2"), ("d", "78", "58"), ("e", "12", "19"), ("f", "9", "99"), ("g", "505", "55")]
    m = align.error_model(align.aligned(spark.createDataFrame(rows, "id string, wanted string, typed string"))).first()
    steps = [(w, *s) for _, w, t in rows for s in align.align(w, t)]
    wanted = sum(len(w) for _, w, _ in rows)
    ok = sum(s[1] == "ok" for s in steps)
    assert m.correct == pytest.approx(ok / wanted) and m.extra == pytest.approx(1 / wanted) and m.skipped_space == pytest.approx(1 / 3)
    assert m.no_space_cost == pytest.approx(math.log((1 / 3) / (2 / 3)), abs=1e-8) and m.extra_cost == pytest.approx(math.log(1 / ok), abs=1e-8)
    assert m.swallowed == pytest.approx(1 / 2)  # "22" lost one of its two; the pair in "2230" arrived
    none = align.error_model(align.aligned(spark.createDataFrame([("a", "2", "2")], "id string, wanted string, typed string"))).first()
    assert none.correct == 1 and none.extra_cost is None and none.swallowed is None


def test_zero_lies_under_other_keys_on_a_numpad():
    near = lambda pad: {k for k, (r, c) in align.places(pad).items() if max(abs(r - 3), abs(c - 1)) == 1}
    assert near("remote") == {"7", "8", "9"} and near("numpad") == {"1", "2", "3"}


def test_pace_by_index(spark):
    gaps = [5, 1, 1, 9, 30, 2, 2, 2, 8, 100, 7]
    got = align.pace(spark.createDataFrame([([0, *gaps[:6]],), ([3, *gaps[6:]],), ([],)], "millis array<long>")).first()
    s = sorted(gaps)
    assert (got.median, got.p10, got.p90, got.longest, got.gaps) == (statistics.median(s), s[len(s) // 10], s[9 * len(s) // 10], 100, 11)
    assert align.pace(spark.createDataFrame([([4],)], "millis array<long>")).count() == 0


def test_drill_report(spark):
    r = drill.report(spark.createDataFrame([("2233",), ("244",), ("9",)], "seq string")).first()
    assert (r.presses, r.rarest, r.rarest_n, r.commonest, r.commonest_n, r.doubled, r.doubled_share) == (8, "9", 1, "2", 3, 3, 37.5)


def test_layout_of_entries(spark):
    words = ["a", "ab", "abc", "a" * 16, "a" * 40, "b"] + ["c" + "d" * k for k in range(60)]
    lex = spark.createDataFrame(list(enumerate(words)), "pos int, word string")
    at, last = 0, ""
    for r in corpus.layout(lex).orderBy("pos").collect():
        w = words[r.pos]
        last = "" if r.pos % 32 == 0 else last
        shared = next((k for k, (x, y) in enumerate(zip(w, last)) if x != y), min(len(w), len(last)))
        long = shared >= 15 or len(w) - shared >= 15
        assert (r.shared, r.suffix, r.escaped, r.size, r.offset) == (shared, len(w) - shared, long, (3 if long else 1) + len(w) - shared + 1, at), w
        at, last = at + r["size"], w


@pytest.mark.parametrize(("line", "caret", "ahead", "behind"), [("one two  three", 3, 7, 0), ("one two  three", 7, 14, 4), ("one two  three", 8, 14, 4), ("", 0, 0, 0), ("one", 3, 3, 0), ("  x", 0, 3, 0), ("ab cd", 4, 5, 3)])
def test_word_jumps(spark, line, caret, ahead, behind):
    t = spark.createDataFrame([(line, caret)], "line string, caret int")
    assert tuple(t.select(keypad.word_after(F.col("line"), F.col("caret")), keypad.word_before(F.col("line"), F.col("caret"))).first()) == (ahead, behind)


def test_files_of_records_and_queries(spark, tmp_path):
    (tmp_path / "r.tsv").write_text("source\tat\tpad\ttarget\tkeys\tmillis\nbook\t0\tremote\tkot\t568\t0,120,70\nshort\t1\nbook\tx\tremote\tkot\t5\t0,y\nbook\t2\tremote\t\t\t\n")
    got = {r["at"]: r for r in typing_record(spark, str(tmp_path / "r.tsv")).collect()}
    assert got[0].millis == [0, 120, 70] and got[0]["keys"] == "568" and got[None].millis == [0, None] and got[2].millis == [] and len(got) == 3
    (tmp_path / "q.tsv").write_text("query\tlanguage\tnote\n# a comment\n\npink floyd\ten\nkino\tmixed\ta note\n")
    assert [tuple(r) for r in query_corpus(spark, str(tmp_path / "q.tsv")).collect()] == [("pink floyd", "en", None), ("kino", "mixed", "a note")]


def test_costs_of_words_use_their_place_among_the_candidates(spark):
    lex = corpus.lexicon(spark.createDataFrame([("los", 900000), ("kos", 4000), ("kop", 300)], "word string, n long"))
    got = {r.word: (r.presses, r.spelt) for r in evaluate.word_cost(spark.createDataFrame([("los",), ("kop",), ("lot",), ("x1",)], "word string"), lex).collect()}
    found = {r.word: r["rank"] for r in lexicon.candidates(spark.createDataFrame([("567",)], "query string"), lex).collect()}
    assert got["los"] == (3, False) and got["kop"] == (3 + found["kop"] - 1, False) and got["lot"][1] and got["x1"][1]


def test_small_tables_are_spread_and_large_ones_left(spark):
    cores = spark.sparkContext.defaultParallelism
    assert spread(spark.range(100).coalesce(1)).rdd.getNumPartitions() == cores
    assert spread(spark.range(0, 100, 1, cores + 3)).rdd.getNumPartitions() == cores + 3
