"""Typing records: goldens, restarts, a batch that runs twice, resuming on what was recorded."""

import glob
import os
import random

from pyspark.sql import functions as F

from keyloom.streaming import records, runs

EVENT = "source string, event_id long, ms long, kind string, digit string, pad string, target string"


def script(source, text):
    """Words like 5@1000, undo@2000, accept@3000."""
    out = []
    for k, word in enumerate(text.split()):
        what, ms = word.split("@")
        digit = what if what.isdigit() else None
        out.append((source, k, int(ms), "press" if digit else what, digit, "remote", "kot"))
    return out


def plain(events):
    """source to {at: (keys, times)}."""
    done, state = {}, {}
    for source, _, ms, kind, digit, *_ in sorted(events, key=lambda e: (e[0], e[2], e[1])):
        rows = done.setdefault(source, {})
        at, keys, times = state.get(source, (0, "", []))
        if kind == "press":
            keys, times = keys + digit, [*times, ms]
        elif kind == "undo":
            keys, times = keys[:-1], times[:-1]
        elif kind == "restart":
            keys, times = "", []
        elif kind == "take_back" and at:
            at, (keys, times) = at - 1, rows.pop(at - 1, ("", []))
            times = [t - times[-1] + ms for t in times]
        elif kind in ("accept", "skip"):
            if keys and kind == "accept":
                rows[at] = (keys, times)
            at, keys, times = at + 1, "", []
        state[source] = (at, keys, times)
    return {s: r for s, r in done.items() if r}


def run(spark, tmp_path, parts, before=None):
    at = f"file://{tmp_path}/job"
    for part in parts:
        spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        records.appended(records.recorded(runs.read(spark, f"{tmp_path}/in"), before), at)
    return at


def held(spark, at):
    out = {}
    for r in records.records(spark, at).collect():
        out.setdefault(r.source, {})[r["at"]] = (r["keys"], list(r.times))
    return out


def test_goldens(spark, tmp_path):
    rows = script("book", "5@1000 6@1120 8@1190 accept@1300") + script("again", "5@1000 6@1150 accept@1200 take_back@9000 8@9400 accept@9500") + script("first", "take_back@5 2@10 undo@20 accept@30 skip@40 3@50 accept@60")
    at = run(spark, tmp_path, [rows])
    t = records.records(spark, at).select("source", "at", "pad", "target", "keys", F.array_join(records.gaps(F.col("times")), ",").alias("millis"))
    assert sorted(map(tuple, t.collect())) == [("again", 0, "remote", "kot", "568", "0,150,400"), ("book", 0, "remote", "kot", "568", "0,120,70"), ("first", 2, "remote", "kot", "3", "0")]
    assert {r.source: r.position for r in records.resumed(records.records(spark, at)).collect()} == {"again": 1, "book": 1, "first": 3}


def test_restarts_and_a_batch_that_runs_twice(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), k, 100 * k, rng.choice(["press"] * 6 + ["undo", "accept", "accept", "skip", "restart", "take_back", "take_back"]), rng.choice("2345"), "remote", "x") for k in range(400)]
    rows = [(*r[:4], r[4] if r[3] == "press" else None, *r[5:]) for r in rows]
    at = run(spark, tmp_path, [rows[:150], rows[150:300], rows[300:]])
    want = plain(rows)
    assert held(spark, at) == want
    # As after a crash between the write and the commit: the last batch runs again, into the same folder.
    n = len(records.records(spark, at).collect())
    last = max(glob.glob(f"{tmp_path}/job/checkpoint/commits/[0-9]*"), key=lambda p: int(os.path.basename(p)))
    os.remove(last)
    for crc in glob.glob(f"{tmp_path}/job/checkpoint/commits/.*.crc"):
        os.remove(crc)
    records.appended(records.recorded(runs.read(spark, f"{tmp_path}/in")), at)
    assert held(spark, at) == want and len(records.records(spark, at).collect()) == n


def test_a_new_sitting_resumes_and_can_take_back(spark, tmp_path):
    first = run(spark, tmp_path / "a", [script("book", "2@10 accept@20 skip@25 3@30 4@40 accept@50 skip@60")])
    before = records.records(spark, first)
    at = run(spark, tmp_path / "b", [script("book", "take_back@1000 5@1100 accept@1200 6@1300 accept@1400") + script("new", "7@1 accept@2")], before)
    # It resumes at 3, one past the highest phrase recorded; the take-back then reopens phrase 2, recorded before.
    assert held(spark, at) == {"book": {2: ("345", [990, 1000, 1100]), 3: ("6", [1300])}, "new": {0: ("7", [1])}}
