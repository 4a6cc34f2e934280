"""The decoder: against a plain search, in rows as in readings, and how many states it puts in order."""

import random

import pytest
from pyspark.sql import functions as F

from keyloom.operators import corpus, decode

LETTERS = dict(zip("abcdefghijklmnopqrstuvwxyz", "22233344455566677778889999"))


def source(language, prior, words, seed):
    rng = random.Random(seed)
    rows = sorted(("".join(LETTERS[c] for c in w), w, rng.choice([1, 60, 255])) for w in words)
    return decode.Source(language, prior, rows)


def words_of(rng, n):
    return ["".join(rng.choice("adgjmptw") for _ in range(rng.randint(1, 6))) for _ in range(n)]


def plain(sources, keys, width, limit):
    """One key sequence, one state after another: a dict of states by what decides their future."""
    w, cost = decode.Weights(), decode.Errors().costs()
    logs = [w.prior * decode.log(s.prior) for s in sources]
    prefixes = sorted({r[0][:k] for s in sources for r in s.rows for k in range(len(r[0]) + 1)} | {""})
    first = [{} for _ in sources]
    for f, s in zip(first, sources):
        for seq, word, score in s.rows:
            f.setdefault(seq, (word, (score - 255) * 15 / 254))
    languages = sorted({s.language for s in sources if s.language is not None})
    rank = lambda x: -1 if x is None else languages.index(x)

    def closed(state, spaced):
        prefix, language, score, mistakes, text = state
        for f, s, g in zip(first, sources, logs):
            if prefix in f:
                word, gain = f[prefix]
                gain = w.frequency * gain + g + (w.switch if None not in (language, s.language) and language != s.language else 0.0)
                yield "", s.language, score + (gain if spaced else gain + w.space * cost["no_space"]), mistakes, [*text, word]

    def grown(state, path, c):
        prefix = state[0] + path
        if prefix in known:
            yield prefix, state[1], state[2] + c, state[3] + c, state[4]

    known = set(prefixes)
    best = lambda states: sorted(states, key=lambda s: (-s[2], s[0], rank(s[1])))[:width]
    beam = [("", None, 0.0, 0.0, [])]
    for key in keys:
        beam, out = best(beam), []
        out += [(p, lang, s + cost["extra"], m + cost["extra"], t) for p, lang, s, m, t in beam]
        if key == "0":
            out += [s for s in beam if not s[0]] + [x for s in beam if s[0] for x in closed(s, True)]
        else:
            slips = [(x, 0.0 if x == key else cost["adjacent"]) for x in decode.LETTER_KEYS if x == key or decode.near(x, key)]
            ended = [x for s in beam if s[0] for x in closed(s, False)]
            out += [y for x, c in slips for part in (beam, ended) for s in part for y in grown(s, x, c)]
            out += [y for x, c in slips for g in decode.LETTER_KEYS for s in beam for y in grown(s, g + x, c + cost["repeat" if g == x else "missed"])]
        merged = {}
        for s in out:
            if s[:2] not in merged or s[2] > merged[s[:2]][2]:
                merged[s[:2]] = s
        beam = list(merged.values())
    got = []
    for s in best([s for s in beam if s[3] >= -(7.0 + 1.2 * len(keys))]):
        ways = list(closed(s, True)) if s[0] else [s] if s[4] else []
        if ways:
            x = max(ways, key=lambda y: y[2])
            got.append((round(x[2], 9), " ".join(x[4])))
    return sorted(got, key=lambda x: (-x[0], x[1]))[:limit]


@pytest.mark.parametrize("width", [3, 32])
def test_the_decoder_equals_a_plain_search(width):
    rng = random.Random(width)
    sources = [source("en", 0.7, words_of(rng, 60), 1), source("pl", 0.3, words_of(rng, 60), 2), source(None, 1.0, words_of(rng, 9), 3)]
    beam = decode.Beam(sources, width)
    said = ["0".join("".join(LETTERS[c] for c in rng.choice(sources[0].rows)[1]) for _ in range(rng.randint(1, 3))) for _ in range(40)]
    asked = said + ["".join(rng.choice("0123456789") for _ in range(rng.randint(0, 8))) for _ in range(60)] + said[:3]
    for keys, got in zip(asked, beam.readings(asked)):
        assert [(round(r.score, 9), r.text) for r in got] == plain(sources, keys, width, 4), keys


def test_rows_are_the_readings(spark):
    rng = random.Random(7)
    counts = spark.createDataFrame([(w, n + 1) for n, w in enumerate(sorted(set(words_of(rng, 80))))], "word string, n long")
    lexs = {"en": (0.6, corpus.lexicon(counts.where("n % 2 = 0"))), "pl": (0.4, corpus.lexicon(counts.where("n % 3 < 2")))}
    asked = ["", "205", "205", "999999999", *("".join(rng.choice("0023456789") for _ in range(9)) for _ in range(30))]
    frame = spark.createDataFrame([(k,) for k in [*asked, None]], "keys string")
    got = [(r["keys"], r["rank"], r.reading, r.score, r.mixed, [tuple(w) for w in r.words]) for r in decode.decode(frame, lexs, together=8).collect()]
    beam = decode.Beam(decode.assembled(lexs))
    want = [(k, n, r.text, round(r.score, 9), r.mixed, [tuple(w) for w in r.words]) for k, found in zip(asked, beam.readings(asked)) for n, r in enumerate(found, 1)]
    assert sorted(got) == sorted(want) and got
    one = decode.decode(frame, lexs, limit=1).select("keys", F.col("rank"), "reading").collect()
    assert sorted(tuple(r) for r in one) == sorted(x[:3] for x in want if x[1] == 1)


def test_states_that_cannot_win_are_not_put_in_order(monkeypatch):
    """What the search costs is what it sorts; keys that begin alike share it."""
    rng, sizes = random.Random(5), []
    beam = decode.Beam([source("en", 1.0, words_of(rng, 3000), 1)])
    words = ["".join(LETTERS[c] for c in r[1]) for r in rng.sample(beam.sources[0].rows, 12)]
    asked = sorted({"0".join(rng.choice(words) for _ in range(4)) for _ in range(400)})
    sort = decode.np.lexsort
    monkeypatch.setattr(decode.np, "lexsort", lambda keys: sizes.append(len(keys[0])) or sort(keys))
    assert all(beam.readings(asked))
    assert sum(sizes) / sum(map(len, asked)) < 300
