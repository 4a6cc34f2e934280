"""Ordered scans against plain loops: large and small groups, null groups, many parts."""

import random

import pytest
from pyspark.sql import functions as F

from keyloom.operators import casing, presses, scan

ROWS = "g long, at long, v long, kind string, word string"


def rows(seed, n):
    rng = random.Random(seed)
    return [(rng.choice([1] * 8 + [2, 3, None]), k, rng.randint(0, 3), rng.choice(["shift", "word", "word", "other"]), rng.choice(["łódź", "kot", "ok"])) for k in range(n)]


def by_group(data):
    out = {}
    for r in sorted(data, key=lambda r: r[1]):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.fixture(autouse=True)
def small_parts(spark, monkeypatch):
    monkeypatch.setattr(scan, "BLOCK", 7)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_previous_row_and_running_sum(spark):
    data = rows(1, 500)
    t = scan.dealt(spark.createDataFrame(data, ROWS), ["g"], ["at"])
    assert t.where("g = 1").select("_part").distinct().count() > 4  # one group in many tasks
    got = {r["at"]: r for r in scan.running(scan.previous(t, ["g"], "at", "v"), ["g"], "v", "total").collect()}
    assert len(got) == 500
    for mine in by_group(data).values():
        total, last = 0, (None, None)
        for r in mine:
            total += r[2]
            x = got[r[1]]
            assert (x.before_at, x.before_v, x.total) == (*last, total)
            last = (r[1], r[2])


def test_states_compose(spark):
    data = rows(2, 900)
    got = {r["at"]: r for r in casing.cased(spark.createDataFrame(data, ROWS), ["g"], ["at"]).collect()}
    for mine in by_group(data).values():
        case = 0
        for r in mine:
            x = got[r[1]]
            assert x.case == casing.CASES[case] and (x.g, x.v, x.kind) == (r[0], r[2], r[3])
            want = {0: r[4], 1: r[4][0].upper() + r[4][1:], 2: r[4].upper()}[case] if r[3] == "word" else None
            assert x.written == want
            case = (case + 1) % 3 if r[3] == "shift" else 0 if r[3] == "word" and case == 1 else case
    assert casing.cased(spark.createDataFrame([], ROWS), ["g"], ["at"]).count() == 0


def test_one_user_of_very_many_gestures_runs_in_many_tasks(spark):
    e = spark.range(200_000).select(F.lit(1).alias("u"), "id", F.when(F.col("id") % 5 == 0, "shift").otherwise("word").alias("kind"), F.lit("kot").alias("word"))
    scan.BLOCK = 256
    out = casing.cased(e, ["u"], ["id"])
    n = {r.written: r["count"] for r in out.groupBy("written").count().collect()}
    # A shift and four words: once, lower, lower, lower; every time anew.
    assert n == {None: 40_000, "Kot": 40_000, "kot": 120_000}


def test_presses_of_one_user_in_many_parts(spark):
    rng = random.Random(3)
    data, ms = [], 0
    for k in range(600):
        ms += rng.choice([100, 1200, 1300])
        data.append((rng.choice([1, 1, 1, None]), k, ms, rng.choice("22223")))
    p = spark.createDataFrame(data, "user_id long, event_id long, ms long, digit string")
    got = {}
    for r in presses.multitap(p, 1200).collect():
        got.setdefault(r.user_id, []).append((r.run, r.digit, r.n))
    groups = {r.user_id: r.n for r in presses.debounced(p, 1200).groupBy("user_id").agg(F.count("*").alias("n")).collect()}
    for user in (1, None):
        mine = [r for r in data if r[0] == user]
        runs, pauses = [], 1
        for a, b in zip([None, *mine], mine):
            if a and a[3] == b[3] and b[2] - a[2] <= 1200:
                runs[-1][1] += 1
            else:
                runs.append([b[3], 1])
            pauses += bool(a and b[2] - a[2] >= 1200)
        assert sorted(got[user]) == [(k, d, n) for k, (d, n) in enumerate(runs, 1)] and groups[user] == pauses
