"""Noisy-channel decoding of key presses into ranked readings.

All queries of an Arrow batch are decoded together: the states of every beam are rows of arrays, and a
press turns the rows of one level into those of the next by lookups in a table of prefixes. The
prefixes are numbered in sorted order, so a number stands for its keys in ties as well.

A state has the prefix in hand, the language and (with a language model) the last word closed, its
score, the part of it that mistakes cost, where the prefix began and the words closed so far. States
that agree in keys, prefix, language and last word have one future, so only the best is kept.

The lexicon is sent to the workers; its size is the vocabulary limit of each language, checked here.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import log
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from keyloom.functions.keypad import GRID

LONGEST, MOST_WORDS, ALTERNATIVES = 24, 1_000_000, 4
LETTER_KEYS = "23456789"
NO = -1  # no language, no word, no such prefix


@dataclass(frozen=True)
class Errors:
    """Measured rates (fixed values) and the log costs that follow from them."""

    correct: float = 0.965
    adjacent: float = 0.010
    distant: float = 0.002
    extra: float = 0.020
    swallowed: float = 0.164
    missed: float = 0.014
    skipped_space: float = 0.033

    def costs(self) -> dict[str, float]:
        odds = lambda p: log(p / (1 - p))
        return {"adjacent": log(self.adjacent / 4 / self.correct), "distant": log(self.distant / 4 / self.correct), "extra": log(self.extra / self.correct), "repeat": odds(self.swallowed), "missed": log(self.missed / self.correct), "no_space": odds(self.skipped_space)}


@dataclass(frozen=True)
class Weights:
    """Fixed values of the scoring."""

    presses: float = 1.0
    frequency: float = 0.5
    prior: float = 1.0
    space: float = 2.0
    switch: float = -0.8
    context: float = 0.0


def near(a: str, b: str) -> bool:
    (r, c), (s, d) = GRID[a], GRID[b]
    return max(abs(r - s), abs(c - d)) == 1


@dataclass
class Source:
    """One lexicon: rows (seq, word, score) in stored order; language None for learnt words; pairs
    (prev, word) to their score in the language model."""

    language: str | None
    prior: float
    rows: list
    pairs: dict = field(default_factory=dict)


@dataclass
class Reading:
    text: str
    score: float
    words: list  # (word, language, from, until, alternatives)

    @property
    def mixed(self) -> bool:
        return len({w[1] for w in self.words if w[1] is not None}) > 1


class Table:
    """The prefixes of all sequences: what follows each, and what each source spells with it."""

    def __init__(self, sources: list[Source]):
        spelt = [[r for r in s.rows if r[0] and len(r[0]) <= LONGEST] for s in sources]
        seqs = {r[0] for rows in spelt for r in rows}
        self.prefixes = [""] + sorted({q[:k] for q in seqs for k in range(1, len(q) + 1)})
        number = {p: i for i, p in enumerate(self.prefixes)}
        self.next = np.full((len(number) + 1, 10), NO, np.int64)  # the last row is that of NO
        for p, i in number.items():
            if p:
                self.next[number[p[:-1]], int(p[-1])] = i
        words: dict[str, int] = {}
        languages = sorted({s.language for s in sources if s.language is not None})
        self.languages, self.spelling = languages, []
        self.word = np.full((len(sources), len(number)), NO, np.int64)
        self.gain = np.zeros((len(sources), len(number)))
        self.language = np.array([NO if s.language is None else languages.index(s.language) for s in sources])
        for k, (s, rows) in enumerate(zip(sources, spelt)):
            others: dict[int, list] = {}
            for seq, word, score in rows:
                at = number[seq]
                found = others.setdefault(at, [])
                if not found:
                    self.word[k, at] = words.setdefault(word, len(words))
                    self.gain[k, at] = (score - 255) * 15 / 254
                if len(found) < ALTERNATIVES:
                    found.append(word)
            self.spelling.append(others)
        self.names = list(words)
        self.context = []
        for s in sources:
            known = sorted((words[a] * len(words) + words[b], x) for (a, b), x in s.pairs.items() if a in words and b in words)
            self.context.append((np.array([x[0] for x in known], np.int64), np.array([x[1] for x in known], float)))

    def pair(self, k: int, prev: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Score of each pair in the model of source k; 0 where it is not known."""
        keys, values = self.context[k]
        asked = prev * len(self.names) + word
        if not len(keys):
            return np.zeros(len(asked))
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        return np.where((prev >= 0) & (keys[at] == asked), values[at], 0.0)


STATE = ["node", "prefix", "language", "prev", "score", "mistakes", "begin", "past"]
PAST = ["before", "source", "prefix", "begin", "end"]


class Beam:
    """The asked keys of a batch, sorted, are a tree: what they begin with alike is decoded once. Only the best of each beam go
    on, so what can't be among them is left out before states are merged: the width-th best of the likely ways on (the key as
    pressed, a press too many, one press missing) is a bound that is reached, so nothing below it is ever taken."""

    def __init__(self, sources: list[Source], width: int = 32, errors: Errors = Errors(), weights: Weights = Weights()):  # noqa: B008
        self.width, self.w, self.cost = width, weights, errors.costs()
        self.table, self.sources = Table(sources), sources
        # The previous word is part of a state only where a model can use it.
        self.remember = weights.context != 0 and any(s.pairs for s in sources)
        self.log_prior = np.array([weights.prior * log(s.prior) for s in sources])
        # For each key: what was meant (a slip's letter), perhaps after a letter whose press is missing.
        self.slip, self.lost = np.full((10, 8), -np.inf), np.full((10, 8, 8), -np.inf)
        for key in GRID:
            for x in LETTER_KEYS if key != "0" else "":
                if x == key or near(x, key):
                    c = 0.0 if x == key else self.cost["adjacent"]
                    self.slip[int(key), int(x) - 2] = weights.presses * c
                    for g in LETTER_KEYS:
                        self.lost[int(key), int(x) - 2, int(g) - 2] = weights.presses * (c + self.cost["repeat" if g == x else "missed"])

    def _ended(self, s: dict, rows: np.ndarray, at: int, spaced: bool, least: np.ndarray | None = None) -> dict:
        """Every way to end the words in hand of some rows at press `at`, one for each source that has the word; none below
        least, which stands by node."""
        parts = []
        for k in range(len(self.sources)):
            word = self.table.word[k, s["prefix"][rows]]
            i, word = rows[word >= 0], word[word >= 0]
            own = self.table.language[k]
            switched = (s["language"][i] >= 0) & (own >= 0) & (s["language"][i] != own)
            gain = self.w.frequency * self.table.gain[k, s["prefix"][i]] + self.log_prior[k] + np.where(switched, self.w.switch, 0.0)
            if self.w.context:
                gain = gain + self.w.context * self.table.pair(k, s["prev"][i], word)
            if not spaced:
                gain = gain + self.w.space * self.cost["no_space"]
            score = s["score"][i] + gain
            ok = slice(None) if least is None else score >= least[s["node"][i]]
            i, word, score = i[ok], word[ok], score[ok]
            parts.append({"row": i, "source": np.full(len(i), k), "node": s["node"][i], "language": np.full(len(i), own), "prev": word if self.remember else s["prev"][i], "score": score, "mistakes": s["mistakes"][i], "begin": np.full(len(i), at + spaced)})
        e = _joined(parts)
        i, n = e["row"], len(e["row"])
        e["past"] = self.noted + np.arange(n)
        self.noted += n
        self.past.append(dict(zip(PAST, (s["past"][i], e["source"], s["prefix"][i], s["begin"][i], np.full(n, at)))))
        return e

    def _future(self, node: np.ndarray, prefix: np.ndarray, language: np.ndarray, prev: np.ndarray) -> np.ndarray:
        """A number for what decides all that can follow; it ascends by node, prefix, language and last word."""
        f = (node * len(self.table.prefixes) + prefix) * (len(self.table.languages) + 1) + language + 1
        return f * (len(self.table.names) + 1) + prev + 1 if self.remember else f

    def _bound(self, node: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
        """The width-th best score of each of n nodes; below all where there are fewer."""
        order = np.lexsort((-score, node))
        first = np.searchsorted(node[order], np.arange(n))
        nth = first + self.width - 1
        some = nth < np.append(first[1:], len(node))
        return np.where(some, score[order][np.where(some, nth, 0)], -np.inf) if len(node) else np.full(n, -np.inf)

    def _step(self, s: dict, key: np.ndarray, at: int, whole: np.ndarray | None = None) -> tuple[dict, np.ndarray]:
        """The states after one more press, from the best of each beam: all of them at the nodes in whole, elsewhere those
        that may be among the best. And the bound of each node."""
        n, nodes, nxt = len(s["node"]), len(key), self.table.next
        pressed, rows = key[s["node"]], np.arange(n)
        extra = self.w.presses * self.cost["extra"]
        parts = [(rows, s["prefix"], np.full(n, extra), 0)]  # whose state goes on, with which prefix, at what cost, offered when
        zero, held = pressed == 0, s["prefix"] > 0
        spaced = self._ended(s, np.flatnonzero(zero & held), at, True)
        idle = np.flatnonzero(zero & ~held)
        parts.append((idle, s["prefix"][idle], np.zeros(len(idle)), 1))
        parts.append((n + np.arange(len(spaced["row"])), np.zeros(len(spaced["row"]), np.int64), np.zeros(len(spaced["row"])), 2))

        least = self._bound(s["node"], s["score"] + extra, nodes)
        if whole is not None:
            least[whole] = -np.inf
        r = np.flatnonzero(pressed > 0)
        key_r, node_r, score_r = pressed[r], s["node"][r], s["score"][r]
        child = nxt[s["prefix"][r], 2:]
        sure = np.flatnonzero(key_r > 1)
        right = child[sure, key_r[sure] - 2]
        i = np.flatnonzero(right >= 0)
        parts.append((r[sure[i]], right[i], np.zeros(len(i)), 1 + 2 * (key_r[sure[i]] - 2)))
        after, cost = nxt[child[sure], key_r[sure][:, None]], self.lost[key_r[sure], key_r[sure] - 2]
        i, g = np.nonzero((after >= 0) & (score_r[sure][:, None] + cost >= least[node_r[sure]][:, None]))
        parts.append((r[sure[i]], after[i, g], cost[i, g], 17 + 8 * (key_r[sure[i]] - 2) + g))

        src, prefix, cost, part = _columns(parts)
        from_ = _joined([{c: s[c] for c in ("node", "language", "prev", "score", "mistakes", "begin", "past")}, {c: spaced[c] for c in ("node", "language", "prev", "score", "mistakes", "begin", "past")}])
        score = from_["score"][src] + cost
        key_f = self._future(from_["node"][src], prefix, from_["language"][src], from_["prev"][src])
        order = np.lexsort((-score, key_f))
        order = order[_first(key_f[order])]
        least = np.maximum(least, self._bound(from_["node"][src[order]], score[order], nodes))
        if whole is not None:
            least[whole] = -np.inf
        i = np.flatnonzero(score >= least[from_["node"][src]])
        parts = [(src[i], prefix[i], cost[i], part[i])]

        # The unlikely ways: a slip, a slip after a missing press, a word that ends without a space.
        low = least[node_r]
        cost = self.slip[key_r]
        i, x = np.nonzero((child >= 0) & (score_r[:, None] + cost >= low[:, None]) & (np.arange(2, 10) != key_r[:, None]) & (cost > -np.inf))
        parts.append((r[i], child[i, x], cost[i, x], 1 + 2 * x))
        most = self.w.presses * (self.cost["adjacent"] + max(self.cost["repeat"], self.cost["missed"]))
        some = np.flatnonzero(score_r + most >= low)
        cost = self.lost[key_r[some]]
        i, x, g = np.nonzero((score_r[some][:, None, None] + cost >= low[some][:, None, None]) & (np.arange(2, 10)[:, None] != key_r[some][:, None, None]) & (cost > -np.inf))
        after = nxt[child[some[i], g], x + 2]
        i, x, g, after = i[after >= 0], x[after >= 0], g[after >= 0], after[after >= 0]
        parts.append((r[some[i]], after, cost[i, x, g], 17 + 8 * x + g))
        ended = self._ended(s, r[s["prefix"][r] > 0], at, False, least)
        cost = self.slip[pressed[ended["row"]]]
        i, x = np.nonzero((nxt[0, 2:] >= 0) & (ended["score"][:, None] + cost >= least[ended["node"]][:, None]) & (cost > -np.inf))
        parts.append((n + len(spaced["row"]) + i, nxt[0, x + 2], cost[i, x], 2 + 2 * x))

        src, prefix, cost, part = _columns(parts)
        from_ = _joined([from_, {c: ended[c] for c in from_}])
        source = np.concatenate([np.zeros(n, np.int64), spaced["source"], ended["source"]])
        row = np.concatenate([rows, spaced["row"], ended["row"]])
        score = from_["score"][src] + cost
        key_f = self._future(from_["node"][src], prefix, from_["language"][src], from_["prev"][src])
        offered = (part * len(self.sources) + source[src]) * max(n, 1) + row[src]
        order = np.lexsort((offered, -score, key_f))  # of states with one future the best; of equal scores the first offered
        order = order[_first(key_f[order])]
        out = {c: v[src[order]] for c, v in from_.items()}
        idle = (part[order] == 1) & (key[out["node"]] == 0)
        out.update(prefix=prefix[order].astype(np.int64), score=score[order], mistakes=out["mistakes"] + cost[order], begin=np.where(idle, at + 1, out["begin"]))
        return out, least

    def _best(self, s: dict) -> dict:
        """The best states of each node; s stands by node, and of equal scores the least prefix, language and last word go first."""
        order = np.lexsort((-s["score"], s["node"]))
        q = s["node"][order]
        return _taken(s, order[np.arange(len(q)) - np.searchsorted(q, q) < self.width])

    def found(self, asked: list[str], limit: int = 4) -> dict:
        """The best readings of the asked key sequences, which are sorted, distinct and not empty: which sequence, score and,
        as lists of arrays from the last word to the first, the source, prefix, begin and end of each word (source NO: none)."""
        size = np.array([len(k) for k in asked], np.int64)
        longest = int(size.max())
        keys = np.full((len(asked), longest), NO, np.int64)
        keys[np.arange(longest) < size[:, None]] = np.frombuffer("".join(asked).encode("utf-32-le"), "<u4").astype(np.int64) - ord("0")
        if keys.max() > 9 or keys.min() < NO:
            raise KeyError("a press is none of the keys 0 to 9")
        alike = np.append(0, (keys[1:] != keys[:-1]).argmax(1))  # keys that each begins with like the one before
        self.past, self.noted, out = [], 0, []
        s = dict(zip(STATE, (np.zeros(1, np.int64), np.zeros(1, np.int64), np.full(1, NO), np.full(1, NO), np.zeros(1), np.zeros(1), np.zeros(1, np.int64), np.full(1, NO))))
        at_node = np.zeros(len(asked), np.int64)
        for at in range(longest):
            active = np.flatnonzero(size > at)
            new = alike[active] <= at
            heads = active[new]
            s = self._best(s)
            first, last = (np.searchsorted(s["node"], at_node[heads], side) for side in ("left", "right"))
            many = last - first
            s = _taken(s, np.repeat(first - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(many.sum()))
            s["node"] = np.repeat(np.arange(len(heads)), many)
            at_node[active] = np.cumsum(new) - 1
            before, key = s, keys[heads, at]
            s, least = self._step(before, key, at)
            done = np.flatnonzero(size == at + 1)
            if len(done):
                asks = np.full(len(heads), NO)
                asks[at_node[done]] = done
                ends = self._possible(_taken(s, asks[s["node"]] >= 0), at + 1)
                # Where mistakes rule out so many that states below the bound may count, all of them are needed.
                short = (asks >= 0) & (least > -np.inf) & (np.bincount(ends["node"], minlength=len(heads)) < self.width)
                if short.any():
                    rest = self._step(_taken(before, short[before["node"]]), key, at, short)[0]
                    ends = _joined([_taken(ends, ~short[ends["node"]]), self._possible(rest, at + 1)])
                out.append(self._finish(ends, asks, at + 1, limit))
        got = _joined(out)
        past = _joined(self.past)
        at, got["words"] = got.pop("past"), []
        while (at >= 0).any():
            got["words"].append({c: np.where(at >= 0, past[c][at], NO) for c in PAST[1:]})
            at = np.where(at >= 0, past["before"][at], NO)
        return got

    def _possible(self, s: dict, size: int) -> dict:
        return _taken(s, s["mistakes"] >= -(7.0 + 1.2 * size))

    def _finish(self, s: dict, asks: np.ndarray, size: int, limit: int) -> dict:
        """The readings of the nodes where keys end: of the sources that close a state, the best; as many as asked for, and
        those that are as good as the last."""
        s = self._best(s)
        ended = np.flatnonzero((s["prefix"] == 0) & (s["past"] >= 0))
        closed = self._ended(s, np.flatnonzero(s["prefix"] > 0), size, True)
        t = {"place": np.append(ended, closed["row"]), "score": np.append(s["score"][ended], closed["score"]), "past": np.append(s["past"][ended], closed["past"])}
        order = np.lexsort((-t["score"], t["place"]))
        t = _taken(t, order[_first(t["place"][order])])
        t["asked"] = asks[s["node"][t["place"]]]
        order = np.lexsort((t["place"], -t["score"], t["asked"]))
        t = _taken(t, order)
        nth = np.searchsorted(t["asked"], t["asked"]) + limit - 1
        nth = np.minimum(nth, np.searchsorted(t["asked"], t["asked"], "right") - 1)
        return _taken(t, t["score"] >= t["score"][nth])

    def rows(self, asked: list[str], limit: int = 4) -> tuple[np.ndarray, list[float], list[str], dict[str, np.ndarray]]:
        """The best readings in order of what is asked and of rank: the place in asked, the score and the text of each, and their
        words one after another: reading, source, prefix, begin and end."""
        got = self.found(asked, limit)
        n, deep = len(got["asked"]), len(got["words"])
        words = {c: np.stack([w[c] for w in got["words"][::-1]], 1) if deep else np.zeros((n, 0), np.int64) for c in PAST[1:]}
        spelt = self.table.word[words["source"], words["prefix"]] if deep else words["source"]
        text = [" ".join([self.table.names[w] for w in row if w >= 0]) for row in np.where(words["source"] >= 0, spelt, NO).tolist()]
        place, scores, which = got["place"].tolist(), got["score"].tolist(), got["asked"].tolist()
        order = np.array(sorted(range(n), key=lambda i: (which[i], -scores[i], text[i], place[i])), np.int64)
        which = got["asked"][order]
        order = order[np.arange(n) - np.searchsorted(which, which) < limit]
        words = {c: v[order] for c, v in words.items()}
        reading, at = np.nonzero(words["source"] >= 0)
        return got["asked"][order], [scores[i] for i in order.tolist()], [text[i] for i in order.tolist()], {"reading": reading, **{c: v[reading, at] for c, v in words.items()}}

    def readings(self, asked: list[str], limit: int = 4) -> list[list[Reading]]:
        """The best readings of each of the asked key sequences."""
        some = sorted({k for k in asked if k})
        if limit <= 0 or not self.sources or not some:
            return [[] for _ in asked]
        which, scores, texts, words = self.rows(some, limit)
        each: list[list] = [[] for _ in texts]
        for i, k, prefix, begin, end in zip(*[words[c].tolist() for c in ("reading", *PAST[1:])]):
            others = self.table.spelling[k][prefix]
            each[i].append((others[0], self.sources[k].language, begin, end, others[1:]))
        out: dict[str, list[Reading]] = {}
        for q, score, text, w in zip(which.tolist(), scores, texts, each):
            out.setdefault(some[q], []).append(Reading(text, score, w))
        return [list(out.get(k, [])) for k in asked]


def _joined(parts: list[dict]) -> dict:
    return {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}


def _taken(s: dict, rows: np.ndarray) -> dict:
    return {c: v[rows] for c, v in s.items()}


def _columns(parts: list[tuple]) -> list[np.ndarray]:
    return [np.concatenate([np.broadcast_to(p[c], p[0].shape) for p in parts]) for c in range(4)]


def _first(sorted_: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before."""
    return np.append(True, sorted_[1:] != sorted_[:-1])[: len(sorted_)]


def assembled(lexicons: dict, learnt: dict | None = None) -> list[Source]:
    """lexicons: language to (prior, lexicon[, pairs(prev, word, pmi)]); learnt: word to (seq, uses)."""
    out = []
    for language, (prior, lex, *pairs) in lexicons.items():
        got = [tuple(r) for r in lex.orderBy("pos").select("seq", "word", "score").limit(MOST_WORDS + 1).collect()]
        if len(got) > MOST_WORDS:
            raise ValueError("a vocabulary is too large to send to the workers: lower its limit")
        known = {}
        if pairs:
            rows = pairs[0].select("prev", "word", "pmi").limit(MOST_WORDS + 1).collect()
            if len(rows) > MOST_WORDS:
                raise ValueError("a table of pairs is too large to send to the workers: lower its limit")
            known = {(r[0], r[1]): r[2] for r in rows}
        out.append(Source(language, prior, got, known))
    if learnt:
        rows = sorted(((seq, word, min(255, 200 + 20 * uses)) for word, (seq, uses) in learnt.items()), key=lambda r: (r[0], -r[2], r[1]))
        out.append(Source(None, 1.0, rows))
    return out


SCHEMA = "keys string, rank int, reading string, score double, mixed boolean, words array<struct<word:string,language:string,begin:int,end:int,alternatives:array<string>>>"


BEAMS: dict = {}  # the beam that a worker holds


def decode(asked: DataFrame, lexicons: dict, limit: int = 4, width: int = 32, weights: Weights = Weights(), together: int = 1024) -> DataFrame:  # noqa: B008
    """asked(keys); lexicons: language to (prior, lexicon[, pairs]). Readings by rank from 1; a query that
    reads as nothing has no row. `together` queries are decoded at a time; the fewer keys they differ in, the faster."""
    sent, name = asked.sparkSession.sparkContext.broadcast(assembled(lexicons)), uuid4().hex

    def run(batches):
        if name not in BEAMS:
            BEAMS.clear()
            BEAMS[name] = Beam(sent.value, width, weights=weights)
        for b in batches:
            keys = b.column(0).to_pylist()
            for i in range(0, len(keys), together):
                yield tabled(BEAMS[name], keys[i : i + together], limit)

    return asked.select("keys").mapInArrow(run, SCHEMA)


def tabled(beam: Beam, asked: list, limit: int) -> pa.RecordBatch:
    """The readings of a batch as rows, in order of the keys; keys that are asked twice have their rows twice."""
    some = sorted({k for k in asked if k})
    which, scores, texts, words = beam.rows(some, limit) if some and beam.sources and limit > 0 else (np.zeros(0, np.int64), [], [], {c: np.zeros(0, np.int64) for c in ("reading", *PAST[1:])})
    reading, n = words["reading"], len(texts)
    ints = lambda x: pa.array(x, pa.int32())
    # The words of each source and prefix that occurs: the first, then the others.
    pairs, at = np.unique(words["source"] * len(beam.table.prefixes) + words["prefix"], return_inverse=True)
    spelt = [beam.table.spelling[p // len(beam.table.prefixes)][p % len(beam.table.prefixes)] for p in pairs.tolist()]
    languages = pa.array([s.language for s in beam.sources], pa.string())
    fields = [pa.array([w[0] for w in spelt], pa.string()).take(pa.array(at)), languages.take(pa.array(words["source"])), ints(words["begin"]), ints(words["end"]), pa.array([w[1:] for w in spelt], pa.list_(pa.string())).take(pa.array(at))]
    each = pa.StructArray.from_arrays(fields, ["word", "language", "begin", "end", "alternatives"])
    lists = pa.ListArray.from_arrays(ints(np.searchsorted(reading, np.arange(n + 1))), each)
    own = beam.table.language[words["source"]] if n else reading
    low, high = np.full(n, len(beam.table.languages)), np.full(n, NO)
    np.minimum.at(low, reading[own >= 0], own[own >= 0])
    np.maximum.at(high, reading[own >= 0], own[own >= 0])
    out = pa.RecordBatch.from_arrays([pa.array(some, pa.string()).take(pa.array(which)), ints(np.arange(n) - np.searchsorted(which, which) + 1), pa.array(texts, pa.string()), pa.array([round(x, 9) for x in scores], pa.float64()), pa.array(low < high), lists], ["keys", "rank", "reading", "score", "mixed", "words"])
    if len(some) == sum(1 for k in asked if k):
        return out
    number = {k: i for i, k in enumerate(some)}
    first = np.searchsorted(which, np.arange(len(some) + 1))
    return out.take(pa.array([j for k in asked if k for j in range(first[number[k]], first[number[k] + 1])], pa.int64()))
