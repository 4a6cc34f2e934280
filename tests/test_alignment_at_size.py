"""Reports on alignments, without a row per step: equal to those on steps, and nothing but counts is shuffled."""

import random

import pytest
from pyspark.sql import functions as F

from keyloom.operators import accuracy, align, corpus


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    keys = lambda n: "".join(rng.choice("02233") for _ in range(n))
    some = [(str(k), rng.choice(["a", "b", None]), keys(rng.randrange(1, 30)), keys(rng.randrange(30))) for k in range(300)] + [("long", "a", keys(200), keys(180)), ("same", "b", "22", "22")]
    return spark.createDataFrame(some, "id string, source string, wanted string, typed string").cache()


def table(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


@pytest.mark.parametrize("report", [align.missed, align.confusion, align.confused, align.worst_slips, align.error_model])
def test_a_tally_reports_what_the_steps_do(rows, report):
    assert table(report(align.tally(rows))) == table(report(align.aligned(rows)))


def test_phrases_report_what_the_steps_do(rows):
    assert table(align.error_counts(align.phrases(rows))) == table(align.error_counts(align.aligned(rows)))
    assert table(align.by_source(align.phrases(rows, "source"))) == table(align.by_source(align.aligned(rows, "source")))


def test_only_counts_are_shuffled(spark, rows):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan(align.missed(align.tally(rows))) and "step" not in plan(align.by_source(align.phrases(rows, "source")))
    docs = spark.createDataFrame([(7, "en", "a cat 12x sat on the mat\n\nit is x"), (8, None, "12 34")], "doc_id long, lang string, text string").repartition(64).localCheckpoint()
    t = corpus.fragments(docs)
    assert "Exchange" not in plan(t)
    assert [(r.doc_id, r.pos, r.part, r.words) for r in t.orderBy("pos", "part").collect()] == [(7, 0, 0, ["a", "cat", "sat", "on"]), (7, 0, 1, ["the", "mat"]), (7, 2, 0, ["it", "is", "x"])]


def test_slips_by_place(spark):
    rows = [(k, 0, 1, "20345067892" * 3) for k in range(40)] + [(None, 0, 0, "2345")]
    got = accuracy.slipped(spark.createDataFrame(rows, "doc_id long, pos int, part int, keys string")).collect()

    def pressed(key, at):
        return "" if at % 11 == 0 else "1234567890"[int(key)] if at % 13 == 0 else key * 2 if at % 17 == 0 else key

    for r, (k, pos, part, keys) in zip(got, rows):
        assert r["keys"] == (keys if k is None else "".join(pressed(c, i + k + pos + part) for i, c in enumerate(keys)))
