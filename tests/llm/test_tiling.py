"""Greedy string tiling against a plain version, short items, and texts that repeat one word."""

import random
import time

import numpy as np

from keyloom.llm import decontam


def plain(doc, item, least):
    """Words that greedy tiling marks, by comparing all places in every round."""
    busy_d, busy_i, marked = [False] * len(doc), [False] * len(item), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and not busy_d[i + n] and not busy_i[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return marked
        busy_d[i : i + n] = busy_i[j : j + n] = [True] * n
        marked += n


def test_tiling_by_brute_force():
    r = random.Random(3)
    for trial in range(300):
        words = "abc"[: r.randint(1, 3)] if trial % 2 else "abcdefgh"
        items = [(k, [r.choice(words) for _ in range(r.randint(1, 24))]) for k in range(4)]
        doc = [r.choice(words) for _ in range(r.randint(0, 20))] + items[0][1][4:15] + ["z"] + items[1][1][:12]
        share = r.choice([0.3, 0.6, 1.0])
        index = decontam.Index([(k, " ".join(w)) for k, w in items], 3)
        got = dict(index.covered(" ".join(doc), share))
        want = {}
        for k, w in items:
            if len(w) >= 3:
                want[k] = plain(doc, w, 3) / len(w)
            else:
                want[k] = float(any(doc[i : i + len(w)] == w for i in range(len(doc))))
        want = {k: c for k, c in want.items() if c}
        assert all(want[k] == c for k, c in got.items())
        assert {k for k, c in want.items() if c >= share} <= set(got)
        if want:
            assert min(want, key=lambda k: (-want[k], k)) in got


def test_short_items_stand_whole(spark):
    docs = spark.createDataFrame([(1, "the answer is forty two indeed"), (2, "forty and two"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(9, "Forty two"), (8, ""), (7, None)], "item_id long, text string")
    got = {r.doc_id: r for r in decontam.decontaminate(docs, bench).collect()}
    assert (got[1].best_item, got[1].coverage, got[1].contaminated) == (9, 1.0, True)
    assert not got[2].contaminated and not got[3].contaminated


def test_repeated_words_take_linear_time():
    start = time.time()
    for item, doc in (("a " * 20_000, "a " * 80_000), ("a b " * 10_000, "a b a b a b c " * 12_000), ("a " * 20_000 + "b", ("a " * 50 + "c ") * 2_000)):
        assert list(decontam.Index([(1, item)], 5).covered(doc, 0.6))
    many = decontam.Index([(k, f"one two three four five x{k} y{k} z{k}") for k in range(20_000)], 5)
    got = list(many.covered("so one two three four five it is", 0.9))
    assert got == [(0, 5 / 8)]
    assert time.time() - start < 20


def test_rolling_hashes_tell_thue_morse_words_apart():
    s = [0]
    while len(s) < 4096:
        s += [1 - x for x in s]
    a = np.array(s, np.int64)
    assert decontam.Rolling(a).at(np.array([0]), 4096)[0] != decontam.Rolling(1 - a).at(np.array([0]), 4096)[0]
    assert decontam.Rolling(a).at(np.array([0]), 1000)[0] == decontam.Rolling(np.concatenate([[5], a])).at(np.array([1]), 1000)[0]
