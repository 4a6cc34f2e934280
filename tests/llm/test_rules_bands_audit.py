"""op11, op12 and op13 against brute force, on ordinary and on odd rows."""

import math
import random
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from keyloom.llm import audit, bands, repetition

DOCS = "doc_id long, text string, lang string"


# --- op11 -------------------------------------------------------------------------------------------
def plain(text):
    """COUNTS and COVERED, window by window."""
    text = text or ""
    words, word = [], ""
    for c in text + " ":
        if c in " \t\n\v\f\r":
            words, word = words + [word] * bool(word), ""
        else:
            word += c
    dup = {}
    for n in repetition.COVERAGE:
        seen = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
        dup[n] = {j for i in range(len(words) - n + 1) if seen[tuple(words[i : i + n])] > 1 for j in range(i, i + n)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    again = [x for k, x in enumerate(lines) if x in lines[:k]]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(again), len(dup[5]),
        sum(map(len, lines)), sum(map(len, again)), *[sum(len(words[j]) for j in d) for d in dup.values()],
    )


def texts():
    rng = random.Random(3)
    out = [None, "", " \n\t", "a", "a b c d e", "a b c d e a b c d e", "x\n" * 40, "é ü ñ — … ł " * 9, "no break space \u0085 x", "a\x1cb\x1fc d\x00e"]
    out += ["\n".join(" ".join(rng.choice("abcd€") for _ in range(rng.randint(0, 9))) + rng.choice(["", " ", " #$%"]) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    return out


def test_rules_equal_brute_force(spark):
    rows = [(i if i % 7 else None, t, "en") for i, t in enumerate(texts())] + [(1, "a b", "en")] * 2
    got = repetition.quality_rules(spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as n_words", "true as kept")).collect()
    names = [*repetition.COUNTS, *repetition.COVERED]
    key = lambda r: (r[0] is None, r)
    want = [(i, plain(t), *repetition.verdict(plain(t))) for i, t, _ in rows]
    assert sorted(((r.doc_id, tuple(r[c] for c in names), r.base_failed, r.kept) for r in got), key=str) == sorted(want, key=str)
    assert key((None,)) > key((1,))
    assert [f.dataType.simpleString() for f in repetition.quality_rules(spark.createDataFrame(rows, DOCS)).schema][:8] == ["bigint"] * 6 + ["boolean"] * 2


def test_colliding_hashes_are_counted_by_words():
    ids = np.array([0, 1, 2, 3, 0, 1, 4, 5])
    assert repetition.repeated(np.zeros(7, np.uint64), ids, 2, np.arange(7)).tolist() == [0, 4]


def test_rules_keep_clean_texts_and_long_ones_take_linear_time(spark):
    rng = random.Random(5)
    clean = " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400))
    failed, kept = repetition.verdict(repetition.measured(clean))
    assert not failed and kept
    long = repetition.measured("same words again and again " * 200_000)
    assert long[0] == long[4] == 1_000_000
    bad = repetition.verdict(repetition.measured(clean + "\n" + "\n".join([clean[:60]] * 30)))
    assert bad == (False, False) or bad[0]
    docs = spark.createDataFrame([(1, clean, "en"), (2, None, "en"), (3, "spam spam spam spam spam " * 9, "en")], DOCS)
    assert [r.doc_id for r in repetition.keep(docs).collect()] == [1]
    assert repetition.quality_rules(docs.limit(0)).count() == 0


# --- op12 -------------------------------------------------------------------------------------------
LINES = "sale_id long, line_no int, item_id long, quantity int, amount double, price double, u string"
ITEMS = "item_id long, name string, price double"


def pairs(lines, items):
    out = []
    near = lambda x: None if x is None or not math.isfinite(x) or abs(100 * x) >= bands.LARGEST else math.floor(100 * x + 0.5)
    for item, _, price in items:
        p, found = near(price), []
        for sale, no, other, q, amount, *_ in lines:
            a = near(amount)
            if p is None or None in (sale, other, q, a) or q == 0 or (item is not None and item == other):
                continue
            u = (2 * a + q) // (2 * q)
            if abs(u - p) <= 10 or 1000 * abs(u - p) <= 2 * p:
                crc = zlib.crc32(f"{sale},{'' if no is None else no},{other}".encode())
                found.append((abs(u - p), u, sale, -1 if no is None else no, other, crc))
        found.sort()
        sums = (len(found), sum(x[0] for x in found), sum(x[5] for x in found))
        out += [(item, k, *x[:3], None if x[3] == -1 else x[3], x[4], *sums) for k, x in enumerate(found[:5], 1)] or [(item, 0, *[None] * 5, *sums)]
    return sorted(out, key=str)


def joined(spark, lines, items):
    out = bands.near_lines(spark.createDataFrame(lines, LINES), spark.createDataFrame(items, ITEMS))
    assert out.columns == ["item_id", "rank", "gap", "u", "sale_id", "line_no", "line_item_id", "n_pairs", "gap_sum", "lines_crc"]
    return sorted((tuple(r) for r in out.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_band_join_equals_all_pairs(spark, seed):
    rng = random.Random(seed)
    some = lambda x, p=0.05: None if rng.random() < p else x
    price = lambda: rng.choice([round(rng.uniform(1, 3), 2), round(rng.uniform(60, 61), 2), round(rng.uniform(399, 402), 2), 2.0])
    lines = []
    for k in range(700):
        q = rng.choice([1, 1, 2, 3, 7])
        # Two items of five hold most lines, so that their own lines must be passed over.
        lines.append((some(k // 3), some(rng.randint(1, 3)), some(rng.choice([1, 1, 1, 2, 2, 3, 4, rng.randint(5, 40)])), some(q), some(round(price() * q, 2)), None, "x"))
    lines += lines[:40] + [(5, 1, 9, 0, 4.0, None, ""), (5, 2, 9, -2, -4.0, None, ""), (5, 3, 9, 1, -2.0, None, ""), (5, 4, 9, 1, float("nan"), None, ""), (5, 5, 9, 1, float("inf"), None, ""), (5, 6, 9, 1, 1e300, None, "")]
    items = [(some(i), "x", some(price())) for i in range(60)] + [(1, "x", 2.0)] * 3 + [(None, None, 2.0), (77, "y", -2.0), (78, "y", 0.0), (79, "y", 1e9), (80, "y", float("nan")), (1, "z", 60.5)]
    assert joined(spark, lines, items) == pairs(lines, items)


def test_band_join_of_one_price_and_of_nothing(spark):
    lines = [(k, 1, 1 if k % 3 else k, 1, 5.0, None, "") for k in range(300)]
    items = [(k, "", 5.0) for k in range(30)]
    assert joined(spark, lines, items) == pairs(lines, items)
    assert joined(spark, [], items[:2]) == [(0, 0, *[None] * 5, 0, 0, 0), (1, 0, *[None] * 5, 0, 0, 0)]
    assert joined(spark, lines, []) == []


def test_cover_is_exact(spark):
    """The nodes of a band are disjoint and hold just the prices of the band."""
    prices = [1, 2, 10, 200, 5000, 40_343, 123_457, -7]
    levels = 10
    held = {}
    for r in bands.cover(spark.createDataFrame([(p,) for p in prices], "p long"), levels).collect():
        held.setdefault(r.p, []).extend(range(r.node << r.level, (r.node + 1) << r.level))
    for p in prices:
        w = max(10, 2 * p // 1000)
        assert sorted(held[p]) == list(range(p - w, p + w + 1))


# --- op13 -------------------------------------------------------------------------------------------
def audited(docs, labels):
    out = []
    rows = []
    for i, text, lang in docs:
        t = text or ""
        ws = "".join(" " if c in " \t\n\v\f\r" else c for c in t).split(" ")
        ws = [w for w in ws if w]
        own = [x for x in labels if x[0] == i and i is not None]
        f = ("A" if len(ws) < 100 else "") + ("B" if 100 * len(set(ws)) < 80 * len(ws) else "") + ("C" if 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t) else "")
        f += ("D" if any(c in "#$%&*|" for c in t) else "") + ("E" if i is not None and any(j is not None and j < i and (x or "") == t for j, x, _ in docs) else "")
        rows.append((lang or "", f, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    for part in {r[0] for r in rows}:
        mine, total = [r for r in rows if r[0] == part], Counter()
        lines = []
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for k, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                every = [r for r in mine if f in r[1]]
                lines.append((part, order, k, len(left), len(gone), len(every) - len(gone), sum(r[1] == f for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)))
                total[f] += len(gone)
        out += [(*x, total[x[1][x[2] - 1]]) for x in lines]
    return sorted(out)


def test_audit_equals_filters_in_turn(spark):
    rng = random.Random(7)
    pool = [" ".join(rng.choice([f"w{rng.randint(0, m)}", "Up", "x"]) for _ in range(rng.choice([3, 99, 100, 150]))) + rng.choice(["", "", "$", " ABCDEFGH" * 9]) for m in (5, 900) for _ in range(12)]
    pool += ["", None, "ß  É" * 60, "A" * 200]
    docs = [(rng.choice([None, *range(80)]), rng.choice(pool), rng.choice(["en", "de", None, ""])) for _ in range(150)]
    labels = [(rng.choice([None, *range(80)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(70)]
    frame = spark.createDataFrame([(*r, 1, True) for r in docs], DOCS + ", n long, good boolean")
    out = audit.audit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert out.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(r) for r in out.collect()) == audited(docs, labels)
    assert audit.audit(frame.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0
