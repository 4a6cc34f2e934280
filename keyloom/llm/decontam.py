"""Benchmark decontamination by greedy string tiling.

Seeds of `least` words shared with a benchmark item are found by Karp-Rabin hashes; for each such
item the longest non-overlapping matches are marked, longest first (ties: first in the document, then
in the item), until none of `least` words is left. The greatest length that still matches is searched
by Karp-Rabin hashes of unmarked windows, so that no list of pairs of places is made. A document is
contaminated when the marked words cover `share` of an item, in any order of passages. An item of
fewer than `least` words is covered where it stands whole. An item without words, and null and empty
texts, match nothing. The benchmark is taken in blocks of a checked size, so it may be of any size;
one block at a time is held. item_id may be of any type that sorts; an item without one counts like
others, and is named last among items of equal coverage. Repeated rows each give a row.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named, renumbered, written

WORD = re.compile(r"\w+")
P = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def hashes(a: np.ndarray, k: int) -> np.ndarray:
    h = np.zeros(max(len(a) - k + 1, 0), np.uint64)
    for j in range(k if len(h) else 0):
        h = h * P + a[j : j + len(h)].astype(np.uint64) + np.uint64(1)
    return h


M = np.uint64((1 << 31) - 1)
BASES = [int(b) for b in np.random.Generator(np.random.PCG64(7)).integers(1 << 20, (1 << 31) - 2, 2)]


def powers(base: int, n: int) -> np.ndarray:
    out, step = np.ones(1, np.uint64), base
    while len(out) < n:
        out, step = np.concatenate([out, out * np.uint64(step) % M]), step * step % int(M)
    return out[:n]


class Rolling:
    """Karp-Rabin hashes of the windows of any length of a sequence of words, from its prefix sums."""

    def __init__(self, a: np.ndarray):
        ids = (a + 2).astype(np.uint64) % M
        self.parts = []
        for base in BASES:
            sums = np.concatenate([[np.uint64(0)], np.cumsum(ids * powers(base, len(a)) % M)]) % M
            self.parts.append((sums, powers(pow(base, -1, int(M)), len(a))))

    def at(self, starts: np.ndarray, n: int) -> np.ndarray:
        one, two = ((sums[starts + n] + M - sums[starts]) % M * down[starts] % M for sums, down in self.parts)
        return one << np.uint64(31) | two


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every range, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def covering(places: np.ndarray, n: int, least: int) -> np.ndarray:
    """Marks of what windows of `least` words at these places cover."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, places, 1)
    np.add.at(edges, places + least, -1)
    return np.cumsum(edges[:n]) > 0


class Index:
    def __init__(self, items: list[tuple[int, str]], least: int):
        self.least, self.ids, self.items, self.short = least, {}, [], {}
        for item, text in items:
            a = np.array([self.ids.setdefault(w, len(self.ids)) for w in words(text)], np.int64)
            if len(a) >= least:
                self.items.append((item, a))
            elif len(a):
                self.short.setdefault(len(a), {}).setdefault(tuple(a.tolist()), []).append(item)
        hs = [hashes(a, least) for _, a in self.items]
        self.h = np.concatenate(hs) if hs else np.zeros(0, np.uint64)
        self.owner = np.repeat(np.arange(len(hs)), [len(h) for h in hs])
        self.pos = np.concatenate([np.arange(len(h)) for h in hs]) if hs else np.zeros(0, np.int64)
        order = np.argsort(self.h, kind="stable")
        self.h, self.owner, self.pos = self.h[order], self.owner[order], self.pos[order]
        # Place of each item in the order of ids, which decides between items of equal coverage.
        ranked = sorted(range(len(self.items)), key=lambda o: by_id(self.items[o][0]))
        self.rank = np.empty(len(ranked), np.int64)
        self.rank[ranked] = np.arange(len(ranked))

    def whole(self, doc: np.ndarray):
        """Items of fewer words than a seed that stand in the document."""
        for k, known in self.short.items():
            if len(doc) >= k:
                windows = np.lib.stride_tricks.sliding_window_view(doc, k)
                for found in map(tuple, np.unique(windows[(windows >= 0).all(1)], axis=0).tolist()):
                    yield from known.get(found, ())

    def covered(self, text: str, share: float):
        """(item, marked words / words of the item) of every item that reaches the share, and of the best one."""
        doc = np.array([self.ids.get(w, -1) for w in words(text)], np.int64)
        for item in self.whole(doc):
            yield item, 1.0
        h = hashes(doc, self.least)
        if not len(h) or not len(self.h):
            return
        order = np.argsort(h, kind="stable")
        h = h[order]
        own = np.concatenate([[True], h[1:] != h[:-1]])
        first, distinct = np.flatnonzero(own), h[own]
        count = np.diff(np.append(first, len(h)))
        lo, hi = np.searchsorted(self.h, distinct, "left"), np.searchsorted(self.h, distinct, "right")
        hits = spread(lo, hi - lo)
        if not len(hits):
            return
        seed = np.repeat(np.arange(len(distinct)), hi - lo)
        owner, pos = self.owner[hits], self.pos[hits]
        by_owner = np.lexsort((pos, owner))
        owner, pos, seed = owner[by_owner], pos[by_owner], seed[by_owner]
        starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        # No tiling marks more than its seeds cover.
        gain = np.full(len(pos), self.least)
        gain[1:] = np.minimum(gain[1:], np.where(owner[1:] == owner[:-1], pos[1:] - pos[:-1], self.least))
        owners, ends = owner[starts], np.append(starts[1:], len(owner))
        bound = np.add.reduceat(gain, starts) / np.array([len(self.items[o][1]) for o in owners])
        best = (-1.0, 0)
        for k in np.lexsort((self.rank[owners], -bound)):
            rank = int(self.rank[owners[k]])
            if bound[k] < share and (bound[k], -rank) < best:
                continue
            item, a = self.items[owners[k]]
            mine = np.unique(seed[starts[k] : ends[k]])
            places = order[spread(first[mine], count[mine])]
            c = tile(doc, a, places, pos[starts[k] : ends[k]], self.least) / len(a)
            best = max(best, (c, -rank))
            yield item, c


def by_id(item) -> tuple:
    return item is None, 0 if item is None else item


def tile(doc: np.ndarray, item: np.ndarray, in_doc: np.ndarray, in_item: np.ndarray, least: int) -> int:
    """Words of item that greedy tiling marks; in_doc and in_item: places of the seeds that both share."""
    kept = covering(in_doc, len(doc), least)
    edge = np.flatnonzero(kept[1:] & ~kept[:-1]) + 1
    used = np.flatnonzero(kept)
    doc = np.insert(doc[used], np.searchsorted(used, edge), -1)  # stretches of seeds, a gap between each two
    cover = covering(in_item, len(item), least)
    run = item[cover]
    if len(doc) == len(run) and (np.flatnonzero(cover)[-1] - np.argmax(cover) + 1 == len(run)) and (doc == run).all():
        return len(run)
    texts_, rolling = (doc, item), (Rolling(doc), Rolling(item))
    busy, marked = [doc < 0, ~cover], 0

    def free(k: int, n: int) -> np.ndarray:
        taken = np.concatenate([[0], np.cumsum(busy[k])])
        return np.flatnonzero(taken[n:] == taken[: len(taken) - n])

    def shared(n: int) -> tuple:
        i, j = free(0, n), free(1, n)
        hi, hj = rolling[0].at(i, n), rolling[1].at(j, n)
        return i[np.isin(hi, hj)], j[np.isin(hj, hi)]

    most = min(len(doc), len(item))
    while True:
        low, high = least - 1, most  # the greatest length that still matches
        if low < high and len(shared(least)[0]):
            low = least
            while low < high:
                n = (low + high + 1) // 2
                low, high = (n, high) if len(shared(n)[0]) else (low, n - 1)
        if low < least:
            return marked
        most = low
        i, j = shared(low)
        left: dict[int, list] = {}
        for h, y in zip(rolling[1].at(j, low).tolist()[::-1], j.tolist()[::-1]):
            left.setdefault(h, []).append(y)
        end, before = 0, marked
        for x, h in zip(i.tolist(), rolling[0].at(i, low).tolist()):
            if x < end:
                continue
            ys = left[h]
            while ys and busy[1][[ys[-1], ys[-1] + low - 1]].any():
                ys.pop()
            if ys and (texts_[0][x : x + low] == texts_[1][ys[-1] : ys[-1] + low]).all():
                y = ys.pop()
                busy[0][x : x + low] = busy[1][y : y + low] = True
                marked, end = marked + low, x + low
        if marked == before:  # hashes met by chance: shorter ones are next
            most = low - 1


def number(benchmark: DataFrame, block_bytes: int) -> int:
    """Blocks that the benchmark takes, each of at most block_bytes of text where items allow."""
    return (benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes + 1


def blocks(benchmark: DataFrame, least: int, n: int):
    """Indexes over n blocks of the benchmark, one after the other."""
    b = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    for k in range(n):
        part = b.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        yield Index([tuple(r) for r in part], least)


FOUND = "n_items long, best_item string, coverage double, contaminated boolean"


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: int = 5, share: float = 0.6, block_bytes: int = 1 << 24) -> DataFrame:
    """Per document: items reached, the best one (ties: least item_id, null last), its coverage, the decision. Every row
    gives a row, repeated ones and those without doc_id too, however many blocks the benchmark takes."""
    n = number(benchmark, block_bytes)
    rows = named(docs)
    if n > 1:  # the number of a row must not change between the passes
        rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "decontam-rows")
    keys = [f.name for f in rows.schema if f.name != "text"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text") + ", " + FOUND
    parts = []
    for index in blocks(benchmark, least, n):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(frames, sent=sent):
            for f in frames:
                found = []
                for t in f["text"]:
                    got = sorted(((c, i) for i, c in sent.value.covered(t, share)), key=lambda x: (-x[0], *by_id(x[1])))
                    best = None if not got or got[0][1] is None else str(got[0][1])
                    found.append((sum(c >= share for c, _ in got), best, got[0][0] if got else 0.0, bool(got) and got[0][0] >= share))
                yield pd.concat([f[keys], pd.DataFrame(found, columns=[c.split()[0] for c in FOUND.split(", ")], index=f.index)], axis=1)

        part = rows.mapInPandas(run, schema)
        if n > 1:
            part = written(part, "decontam-block")
            sent.unpersist()
        parts.append(part)
    out = parts[0]
    if len(parts) > 1:
        typed = F.col("best_item").cast(benchmark.schema["item_id"].dataType)
        best = F.min_by("best_item", F.struct(-F.col("coverage"), typed.isNull(), typed))
        every = reduce(DataFrame.unionByName, parts)
        out = every.groupBy(*keys).agg(F.sum("n_items").alias("n_items"), best.alias("best_item"), F.max("coverage").alias("coverage"), F.max("contaminated").alias("contaminated"))
    out = renumbered(out.withColumn("best_item", F.col("best_item").cast(benchmark.schema["item_id"].dataType)), docs)
    return out.select("doc_id", "n_items", "best_item", "coverage", "contaminated")


def clean(docs: DataFrame, benchmark: DataFrame, least: int = 5, share: float = 0.6, block_bytes: int = 1 << 24) -> DataFrame:
    """Rows of docs, all columns, that are not contaminated."""
    n = number(benchmark, block_bytes)
    for index in blocks(benchmark, least, n):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, sent=sent):
            for b in batches:
                keep = [not any(c >= share for _, c in sent.value.covered(t or "", share)) for t in b.column("text").to_pylist()]
                yield b.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        if n > 1:
            docs = written(docs, "decontam-block")
            sent.unpersist()
    return docs
