"""Streams against their batch queries: rows out of order and late, several runs on one checkpoint."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from keyloom.operators import presses as batch
from keyloom.streaming import presses, runs

PRESS = "user_id long, event_id long, ts timestamp, ms long, digit string"
START = 1_700_000_000_000


def press(user, k, ms, digit):
    return (user, k, dt.datetime.fromtimestamp((START + ms) / 1000, dt.timezone.utc), START + ms, digit)


def fed(spark, tmp_path, parts, make, schema=PRESS, **options):
    """Each part is a file that arrives before one run; all runs share a checkpoint."""
    folder, at = str(tmp_path / "in"), f"file://{tmp_path}/job"
    out = None
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        out = runs.drained(make(runs.read(spark, folder, **options)), at)
    return out


def folded(rows, timeout):
    """Letters in hand and settled, press by press."""
    text, hand = [], None
    for _, k, _, ms, digit in sorted(rows, key=lambda r: (r[3], r[1])):
        open_ = hand and ms - hand[3] <= timeout
        if digit == "<":
            if hand and not open_:
                text.append(hand)
                hand = None
            if hand:
                hand = None
            elif text:
                text.pop()
        elif open_ and digit == hand[0]:
            hand = (digit, hand[1] + 1, hand[2], ms)
        else:
            if hand:
                text.append(hand)
            hand = (digit, 1, ms, ms)
    return text, hand


def shown(out):
    """What remains on the screen of each user: rows that are undone cancel the letter that started then."""
    rows = sorted(out.collect(), key=lambda r: (r.user_id, r.started))
    gone = {(r.user_id, r.started) for r in rows if r.undone}
    return [(r.user_id, r.digit, r.n, r.started, r.last) for r in rows if (r.user_id, r.started) not in gone]


@pytest.mark.parametrize(("at", "want"), [([(0, "2"), (1200, "2"), (2401, "2")], "ba"), ([(0, "9"), (100, "9"), (200, "9"), (300, "9"), (400, "9")], "ź"), ([(0, "2"), (50, "2"), (100, "3"), (150, "<")], "b"), ([(0, "2"), (1300, "<"), (1400, "3")], "d")])
def test_letters_settle_at_1200_ms(spark, tmp_path, at, want):
    rows = [press(1, k, ms, d) for k, (ms, d) in enumerate(at)] + [press(2, 99, 60_000, "4")]
    out = fed(spark, tmp_path, [rows], presses.multitap)
    left = [x for x in shown(out) if x[0] == 1]
    letter = {r.started: r.letter for r in out.collect()}
    assert "".join(letter[x[3]] for x in left) == want


def test_multitap_equals_the_batch_and_survives_a_restart(spark, tmp_path):
    rng = random.Random(1)
    rows, ms = [], 0
    for k in range(240):
        ms += rng.choice([100, 400, 1200, 1201, 3000])
        rows.append(press(rng.randint(1, 3), k, ms, rng.choice("2233<" if k % 5 == 0 else "2234")))
    plain = [r for r in rows if r[4] != "<"]
    # Neighbours swapped within the time that rows may be late, one row sent twice, three runs on one checkpoint.
    mixed = sorted(rows, key=lambda r: r[3] + rng.randint(0, 4000))
    third = len(mixed) // 3
    parts = [mixed[:third], mixed[third : 2 * third] + mixed[:1], mixed[2 * third :] + [press(9, 999, ms + 100_000, "2")]]
    out = fed(spark, tmp_path, parts, presses.multitap)
    got = [x for x in shown(out) if x[0] != 9]
    want = []
    for user in (1, 2, 3):
        text, hand = folded([r for r in rows if r[0] == user], 1200)
        want += [(user, *x) for x in [*text, *([hand] if hand else [])]]
    assert got == sorted(((u, d, n, s, last) for u, d, n, s, last in want), key=lambda x: (x[0], x[3]))

    out = fed(spark, tmp_path / "plain", [[*plain, press(9, 999, ms + 100_000, "2")]], presses.multitap)
    letters = [(r.user_id, r.digit, r.n, r.letter) for r in sorted(out.collect(), key=lambda r: (r.user_id, r.started)) if r.user_id != 9]
    b = batch.multitap(spark.createDataFrame(plain, PRESS).select("user_id", "event_id", "ms", "digit"), 1200).orderBy("user_id", "run").collect()
    assert letters == [(r.user_id, r.digit, r.n, r.letter) for r in b]


def test_a_text_left_alone_is_forgotten(spark, tmp_path):
    rows = [press(1, 0, 0, "2"), press(1, 1, 100_000, "<"), press(1, 2, 100_100, "3"), press(2, 3, 900_000, "2")]
    out = fed(spark, tmp_path, [rows], lambda t: presses.multitap(t, 1200, 50_000))
    assert [(r.digit, r.undone) for r in out.collect() if r.user_id == 1] in ([("2", False), ("3", False)], [("3", False), ("2", False)])


def test_pauses_end_groups_and_late_rows_join_or_are_dropped(spark, tmp_path):
    make = lambda t: presses.debounced(t, 300)
    first = [press(1, 0, 0, "2"), press(1, 1, 299, "2"), press(1, 2, 600, "2"), press(1, 3, 20_000, "3")]
    # 12 s is late but not behind the watermark of 10 s; 5 s is behind it.
    second = [press(1, 4, 12_000, "4"), press(1, 5, 12_100, "4"), press(1, 6, 5_000, "4"), press(2, 7, 60_000, "5")]
    out = fed(spark, tmp_path, [first, second, [press(2, 8, 120_000, "5")]], make)
    got = sorted((r.user_id, r.first_ms - START, r.last_ms - START, r.n) for r in out.collect())
    assert got == [(1, 0, 299, 2), (1, 600, 600, 1), (1, 12_000, 12_100, 2), (1, 20_000, 20_000, 1), (2, 60_000, 60_000, 1)]
    kept = [r for r in [*first, *second] if r[1] != 6]
    b = batch.debounced(spark.createDataFrame(kept, PRESS).select("user_id", "event_id", "ms", "digit"), 300)
    assert sorted((r.user_id, r.last_ms - START, r.n) for r in b.collect()) == sorted((u, last, n) for u, _, last, n in got)


def test_streams_read_the_tables(spark):
    t = runs.timed(runs.read(spark, "/root/testdata/sf0.001/events.parquet"))
    assert t.isStreaming and dict(t.dtypes)["ts"] == "timestamp"
    assert t.select(F.col("ts")).isStreaming
