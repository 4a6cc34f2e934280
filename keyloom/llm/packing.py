"""Bounded-space online packing into sequences of at most `size` tokens.

Each partition keeps `open_windows` windows. A piece goes to the window it fits best; where none
fits, the fullest is topped up with the head of the piece (cuts are free) and emitted. Windows left
over at the end of a partition are merged, whole, in groups of `merge` partitions, so no task
receives more than open_windows * merge windows whatever the size of the input.

Null and empty texts pack their end token alone. Repeated rows are packed each. An empty table
gives no rows. File partitions are read in a fixed order and the first pass is written to the
shared folder, so a lost executor changes nothing.
"""

from __future__ import annotations

import bisect
import gc
import os
import re
import zlib
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named, renumbered, written

END = 1
# White space other than blank, tab and line ends, where Python and the library could differ.
ODD_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")


# A part of these characters alone is in composed form and is cut into words by this pattern, as the file
# has it; all other parts, and those with special tokens, are cut by the library.
OTHER = re.compile(r"[^!-~À-ÖØ-öø-įĲ-ſ]|<\|")
OTHER_TEXT = re.compile(r"[^!-~À-ÖØ-öø-įĲ-ſ \t\r\n]|<\|")
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^a-z0-9ß-öø-ſ]+")


class Tokens:
    """Ids of texts by a vocabulary file.

    No token, lower-casing or composition of characters reaches over a blank, so a text has the ids of its
    parts between blanks, and a part those of its words. Each word is encoded by the library once and kept,
    as are the parts, up to a bound; what a batch of texts lacks is encoded in one call. Texts with odd
    white space are given to the library whole.
    """

    KEEP = 1_000_000

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks of a worker are the parallelism
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self._clear()

    def _clear(self):
        self.place: dict[str, int] = {}
        self.flat, self.begin, self.size = (np.zeros(0, d) for d in ("<u4", np.int64, np.int64))

    def _keep(self, parts: list[str], size: np.ndarray, ids: np.ndarray):
        begin = len(self.flat) + np.cumsum(size) - size
        self.place.update(zip(parts, range(len(self.begin), len(self.begin) + len(parts))))
        self.flat = np.concatenate([self.flat, ids])
        self.begin, self.size = np.concatenate([self.begin, begin]), np.concatenate([self.size, size])

    def _spread(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each of the parts at these places, and their ids one after the other."""
        size = self.size[at]
        ends = np.cumsum(size)
        return size, self.flat[np.repeat(self.begin[at] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]

    def _places(self, parts: list[str], plain: bool) -> np.ndarray:
        """Places of distinct parts; those not known yet are encoded."""
        at = np.fromiter(map(self.place.get, parts, repeat(-1)), np.int64, len(parts))
        unknown = np.flatnonzero(at < 0)
        if len(unknown):
            self._add([parts[i] for i in unknown.tolist()], plain)
            at[unknown] = np.fromiter((self.place[parts[i]] for i in unknown.tolist()), np.int64, len(unknown))
        return at

    def _add(self, parts: list[str], plain: bool):
        words = list(map(WORDS.findall, parts)) if plain else [[p] if OTHER.search(p) else WORDS.findall(p.lower()) for p in parts]
        new = [w for w in set(chain.from_iterable(words)) if w not in self.place]
        ids = [e.ids for e in self.lib.encode_batch_fast(new, add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        self._keep(new, size, np.fromiter(chain.from_iterable(ids), "<u4", int(size.sum())))
        rest = [(p, w) for p, w in zip(parts, words) if p not in self.place]
        first = np.cumsum([0] + [len(w) for _, w in rest])
        size, ids = self._spread(np.fromiter(map(self.place.__getitem__, chain.from_iterable(w for _, w in rest)), np.int64, int(first[-1])))
        ends = np.concatenate([[0], np.cumsum(size)])[first]
        self._keep([p for p, _ in rest], np.diff(ends), ids)

    def ids(self, texts_: list[str]) -> list[np.ndarray]:
        """The ids of each text, and the end token."""
        if len(self.place) > self.KEEP or len(self.flat) > 8 * self.KEEP:
            self._clear()
        plain = [not OTHER_TEXT.search(t) for t in texts_]
        if all(plain):  # split by Arrow, which may add empty parts: they have no ids
            lists = pc.ascii_split_whitespace(pa.array([t.lower() for t in texts_], pa.large_string()))
        else:
            parts = [t.lower().split() if p else [t] if ODD_SPACE.search(t) else t.split() for t, p in zip(texts_, plain)]
            lists = pa.array(parts, pa.list_(pa.large_string()))
        parts = lists.values.dictionary_encode()
        gc.disable()  # many small lists come and go at once, none in cycles
        try:
            at = self._places(parts.dictionary.to_pylist(), all(plain))
        finally:
            gc.enable()
        size, ids = self._spread(at[parts.indices.to_numpy()])
        ends = np.concatenate([[0], np.cumsum(size)])[lists.offsets.to_numpy()]
        return [np.append(ids[i:j], np.uint32(END)) for i, j in zip(ends[:-1], ends[1:])]


_kept: dict[str, Tokens] = {}


def tokens_of(path: str) -> Tokens:
    """The tokens of a file, kept for all tasks of a worker."""
    if path not in _kept:
        _kept[path] = Tokens(path)
    return _kept[path]


class Windows:
    """Open windows of one partition, kept sorted by fill for best fit."""

    def __init__(self, size: int, most: int, least_cut: int):
        self.size, self.most, self.least_cut = size, most, least_cut
        self.open: list[tuple[int, int]] = []  # (fill, window)
        self.held: dict[int, list] = {}
        self.n = 0

    def _emit(self, k: int):
        return [(*p, k, True) for p in self.held.pop(k)]

    def put(self, piece: tuple, length: int, ids) -> list:
        """piece: (doc_id, doc_tokens, start); emitted rows come back."""
        out, start = [], piece[2]
        while length:
            at = bisect.bisect_right(self.open, (self.size - length, 1 << 62)) - 1
            if at < 0 and len(self.open) < self.most:
                self.held[self.n] = []
                fill, k = 0, self.n
                self.n += 1
            elif at < 0:
                fill, k = self.open.pop()
            else:
                fill, k = self.open.pop(at)
            take = min(length, self.size - fill)
            if take == length or take >= self.least_cut:
                crc = zlib.crc32(ids[start : start + take].tobytes())
                self.held[k].append((piece[0], start, take, crc, piece[1], fill))
                start, length, fill = start + take, length - take, fill + take
            else:  # not worth a cut: padded
                out += self._emit(k)
                continue
            if fill == self.size:
                out += self._emit(k)
            else:
                bisect.insort(self.open, (fill, k))
        return out

    def rest(self) -> list:
        return [(*p, k, False) for k in self.held for p in self.held[k]]


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
SHIFT = 1 << 36  # windows of one partition


def pack(docs: DataFrame, path: str | None = None, size: int = 2048, open_windows: int = 32, least_cut: int = 16, merge: int = 256) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    names = [*COLUMNS[:5], "offset", "sequence_id", "whole"]

    def first(frames):
        tokens, windows, part = tokens_of(path), Windows(size, open_windows, least_cut), TaskContext.get().partitionId()

        def frame(rows):
            out = pd.DataFrame(rows, columns=names)
            out["sequence_id"] += part * SHIFT
            out["part"] = part
            return out

        for f in frames:
            rows = []
            for d, ids in zip(f["doc_id"], tokens.ids(f["text"].tolist())):
                rows += windows.put((d, len(ids), 0), len(ids), ids)
                if len(rows) > 50_000:
                    yield frame(rows)
                    rows = []
            if rows:
                yield frame(rows)
        if rows := windows.rest():
            yield frame(rows)

    def merged(f: pd.DataFrame) -> pd.DataFrame:
        fills = f.groupby("sequence_id")["length"].sum().sort_values(ascending=False, kind="stable")
        open_: list[tuple[int, int]] = []
        to: dict[int, tuple[int, int]] = {}
        for k, n in fills.items():  # decreasing best fit of whole windows
            at = bisect.bisect_right(open_, (size - n, 1 << 62)) - 1
            fill, target = open_.pop(at) if at >= 0 else (0, k)
            to[k] = (target, fill)
            bisect.insort(open_, (fill + int(n), target))
        f["offset"] += f["sequence_id"].map(lambda k: to[k][1])
        f["sequence_id"] = f["sequence_id"].map(lambda k: to[k][0])
        return f[COLUMNS]

    schema = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, offset long, sequence_id long, whole boolean, part int"
    placed = written(named(docs).mapInPandas(first, schema), "packing")
    whole = placed.where("whole").select(*COLUMNS)
    rest = placed.where("not whole").groupBy(F.expr(f"part div {merge}")).applyInPandas(lambda f: merged(f), SCHEMA.replace("doc_id long", "doc_id string"))
    return renumbered(whole.unionByName(rest), docs)
