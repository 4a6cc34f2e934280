"""Maximal repeats of `length` bytes and more across the corpus, by an enhanced suffix array.

Suffixes are sampled: the minimizer of a window of `length` bytes (the leftmost least hash of its
`gram`-byte grams) lies at the same place in equal windows, so suffixes that start at minimizers, and
what stands left of them, meet every repeat. Of equal texts only the first is searched, and a minimizer
that occurs once is dropped, before any text is exchanged.

The occurrences of a minimizer meet in one task with their surroundings, the windows they are the
minimizer of. There their suffixes are sorted, common prefixes of neighbours counted, and a stack scan
yields the intervals of the tree of common prefixes. Within each interval the left contexts are sorted
too and scanned likewise: a repeat that all its occurrences extend to the left is no node of that
second tree, which is the test of left-extension diversity. An interval of depth d and a left interval
of depth e are a maximal repeat of d + e bytes, output with all its occurrences.

A minimizer with more than `most` occurrences (a passage that very many texts share) would be an
unbounded group. Its windows are keyed by a 128-bit hash of their bytes instead; each task keeps only
the first occurrence of a window that it sees and reports the others at once, so a hot window is one
entry per task. Repeats found that way are of exactly `length` bytes.

Rows order by doc_id, then as they were written; rows without doc_id come before all others. Null and
empty texts have nothing to remove. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, packed, texts, written

P1, P2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
MASK = (1 << 64) - 1
NOTHING = hashlib.sha256(b"").hexdigest()
BLOCK = 1 << 20  # bytes of a text hashed at a time
FLUSH = 1 << 19  # entries held before an exchange


def rolled(data: np.ndarray, k: int, p: int) -> np.ndarray:
    """Polynomial hash mod 2^64 of every k-byte window, by doubling; mixed at the end."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, h, have, out, used = p, data.astype(np.uint64) + np.uint64(1), 1, None, 0
    while True:
        if k & have:
            out = h[:n] if out is None else out * np.uint64(power) + h[used : used + n]
            used += have
        if have * 2 > k:
            break
        h = h[:-have] * np.uint64(power) + h[have:]
        power = power * power & MASK
        have *= 2
    out = (out ^ (out >> np.uint64(31))) * np.uint64(P2)
    return out ^ (out >> np.uint64(29))


def minimizers(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and hashes of the leftmost least gram of every window; first and last window of each."""
    places, values, firsts, lasts = [], [], [], []
    total, w = len(data) - length + 1, length - gram + 1
    for begin in range(0, max(total, 0), BLOCK):
        h = rolled(data[begin : min(begin + BLOCK, total) + length - 1], gram, P1)
        n = len(h) - w + 1
        at, least, span = np.arange(len(h)), h, 1
        while span * 2 <= w:  # leftmost argmin of spans 1, 2, 4, ...
            right = least[span:] < least[:-span]
            least = np.where(right, least[span:], least[:-span])
            at = np.where(right, at[span:], at[:-span])
            span *= 2
        right = least[w - span : w - span + n] < least[:n]
        at = np.where(right, at[w - span : w - span + n], at[:n])
        edge = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        places.append(at[edge] + begin)
        values.append(h[at[edge]].view(np.int64))
        firsts.append(edge + begin)
        lasts.append(np.concatenate([edge[1:], [n]]) - 1 + begin)
    if not places:
        return (np.zeros(0, np.int64),) * 4
    place, value, first, last = (np.concatenate(x) for x in (places, values, firsts, lasts))
    new = np.concatenate([[True], place[1:] != place[:-1]])  # one place can end a block and begin the next
    return place[new], value[new], first[new], last[np.concatenate([new[1:], [True]])]


def intervals(lcp, size: int):
    """(depth, from, until) of every interval of the tree of common prefixes over `size` sorted entries;
    lcp[i] is what entries i and i + 1 have in common. One stack, children before parents."""
    stack: list[list[int]] = []
    for i in range(size):
        depth = int(lcp[i]) if i + 1 < size else 0
        low = i
        while stack and stack[-1][0] > depth:
            d, low = stack.pop()
            yield d, low, i + 1
        if depth and (not stack or stack[-1][0] < depth):
            stack.append([depth, low])


def common(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Common prefix lengths of rows of two byte matrices whose rows hold la and lb bytes."""
    differ = a != b
    n = np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])
    return np.minimum(n, np.minimum(la, lb))


class Suffixes:
    """The enhanced suffix array of the occurrences of some minimizers.

    Each occurrence has its minimizer m, the bytes left and right of its start (both as far as its own
    windows reach) and its place. Rows that end early sort before their continuations, and common
    lengths stop at the shorter row, so padding is never taken for text.
    """

    def __init__(self, m, left, n_left, right, n_right):
        self.left, self.n_left, self.n_right = left, n_left, n_right
        view = np.ascontiguousarray(right).view(f"S{right.shape[1]}").ravel()
        _, word = np.unique(view, return_inverse=True)
        self.order = np.lexsort((n_right, word, m))
        r, n = right[self.order], n_right[self.order]
        lcp = common(r[:-1], r[1:], n[:-1], n[1:])
        self.lcp = np.where(m[self.order][:-1] == m[self.order][1:], lcp, 0)

    def repeats(self, length: int, least: int):
        """(rows, bytes to the left, bytes to the right) of the maximal repeats; rows as they were given,
        as one array of all pairs (with arrays of lengths) and then one by one for larger groups."""
        if len(self.order) < 2:
            return
        cut = np.flatnonzero(np.concatenate([[True], self.lcp < least, [True]]))
        size = np.diff(cut)
        at = cut[:-1][size == 2]
        if len(at):  # a tree of one interval with one pair
            a, b = self.order[at], self.order[at + 1]
            d, e = self.lcp[at], common(self.left[a], self.left[b], self.n_left[a], self.n_left[b])
            yield np.stack([a, b], axis=1)[d + e >= length], e[d + e >= length], d[d + e >= length]
        big = size > 2
        if not big.any():
            return
        view = np.ascontiguousarray(self.left).view(f"S{self.left.shape[1]}").ravel()
        _, rank = np.unique(view, return_inverse=True)
        for lo, hi in zip(cut[:-1][big].tolist(), cut[1:][big].tolist()):
            for d, i, j in intervals(self.lcp[lo : hi - 1].tolist(), hi - lo):
                rows = self.order[lo + i : lo + j]
                rows = rows[np.lexsort((self.n_left[rows], rank[rows]))]
                lcs = common(self.left[rows[:-1]], self.left[rows[1:]], self.n_left[rows[:-1]], self.n_left[rows[1:]])
                if d >= length and lcs.min() == 0:  # long enough by itself, with diverse bytes before it
                    yield rows, 0, d
                if d + lcs.max() >= length:
                    for e, a, b in intervals(np.where(lcs < length - d, 0, lcs).tolist(), len(rows)):
                        yield rows[a:b], e, d


def matrix(blob: np.ndarray, start: np.ndarray, n: np.ndarray, width: int, back: bool = False) -> np.ndarray:
    """Rows of up to `width` bytes of blob from each start on (or before it, read backwards), zeros after."""
    step = np.arange(width)
    at = start[:, None] + (-1 - step if back else step)[None, :]
    inside = step[None, :] < n[:, None]
    return np.where(inside, blob[np.where(inside, at, 0)], np.uint8(0))


ROW = 33  # bits of a row in an id given by monotonically_increasing_id


def first_texts(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows (doc_id, h, h2, n_bytes); the first row of each group of equal texts; and the texts to be
    searched, each with uid (order among rows of one doc_id) and z (doc_id, null as the least number)."""
    t = texts(docs).withColumn("h", F.xxhash64("text")).withColumn("h2", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))
    rows = t.select("doc_id", "h", "h2", F.octet_length("text").cast("long").alias("n_bytes"))
    # A struct with a null in it sorts lowest: rows without doc_id come first.
    firsts = rows.groupBy("h", "h2").agg(F.min(F.struct("doc_id")).alias("first"), F.max("n_bytes").alias("n_bytes"))
    firsts = written(firsts.select("h", "h2", "n_bytes", F.col("first.doc_id").alias("first_id")), "repeats-first")
    wanted = firsts.where(f"n_bytes >= {length}").select(F.col("first_id"), F.col("h").alias("fh"), F.col("h2").alias("fh2")).hint("merge")
    same = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("fh")) & (F.col("h2") == F.col("fh2"))
    own = t.where(F.octet_length("text") >= length).join(wanted, same, "left_semi").dropDuplicates(["doc_id", "h", "h2"])
    own = own.select("h", "h2", "text", F.coalesce("doc_id", F.lit(-(1 << 63))).cast("long").alias("z"), F.monotonically_increasing_id().alias("uid"))
    return rows, firsts, written(own, "repeats-text")


def block_of(uid, blocks: int):
    """Texts are dealt to blocks; the same sum for columns and for arrays."""
    if isinstance(uid, np.ndarray):
        return ((uid >> ROW) * 7919 + (uid & ((1 << ROW) - 1))) % blocks
    return F.pmod(F.shiftright(uid, ROW) * 7919 + uid.bitwiseAND(F.lit((1 << ROW) - 1)), F.lit(blocks)).cast("int")


def shared_minimizers(t: DataFrame, length: int, gram: int, buckets: int, blocks: int, most: int) -> DataFrame:
    """(block, a, b), packed: for each block of texts its minimizers that occur twice or more in the
    whole corpus, and whether more than `most` times."""

    def spread(frames):
        held, size = [], 0

        def sent():
            m = np.concatenate([x for _, x in held])
            block = np.repeat(block_of(np.array([u for u, _ in held], np.int64), blocks), [len(x) for _, x in held])
            order = np.lexsort((block, m))
            m, block = m[order], block[order]
            new = np.flatnonzero(np.concatenate([[True], (m[1:] != m[:-1]) | (block[1:] != block[:-1])]))
            count = np.diff(np.concatenate([new, [len(m)]]))
            return packed(m[new], buckets, block[new].astype("<i4"), count.astype("<u4"))

        for f in frames:
            for u, text in zip(f["uid"], f["text"]):
                m = minimizers(np.frombuffer(text.encode(), np.uint8), length, gram)[1]
                held.append((u, m))
                size += len(m)
                if size >= FLUSH:
                    yield sent()
                    held, size = [], 0
        if size:
            yield sent()

    def meet(f: pd.DataFrame) -> pd.DataFrame:
        m, block, count = (np.frombuffer(b"".join(f[c]), d) for c, d in (("a", "<i8"), ("b", "<i4"), ("c", "<u4")))
        u, back = np.unique(m, return_inverse=True)
        n = np.bincount(back, count)
        order = np.lexsort((back, block))
        order = order[n[back[order]] > 1]
        block, back = block[order], back[order]
        new = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1])])) if len(block) else np.zeros(0, int)
        rows = [(int(block[i]), u[back[i:j]].tobytes(), (n[back[i:j]] > most).astype(np.uint8).tobytes()) for i, j in zip(new, [*new[1:], len(block)])]
        return pd.DataFrame(rows, columns=["block", "a", "b"])

    sent = t.select("uid", "text").mapInPandas(spread, "bucket int, a binary, b binary, c binary")
    return sent.groupBy("bucket").applyInPandas(meet, "block int, a binary, b binary")


def sorted_by_place(f: pd.DataFrame) -> pd.DataFrame:
    return f.sort_values(["z", "uid"], kind="stable")


def joined_spans(uid: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spans of each uid, overlapping and touching ones as one."""
    if not len(uid):
        return uid, start, end
    order = np.lexsort((start, uid))
    uid, start, end = uid[order], start[order], end[order]
    _, text = np.unique(uid, return_inverse=True)
    width = int(end.max()) + 2
    reach = np.maximum.accumulate(text * width + end)
    new = np.flatnonzero(np.concatenate([[True], text[1:] * width + start[1:] > reach[:-1]]))
    return uid[new], start[new], (reach - text * width)[np.concatenate([new[1:], [len(uid)]]) - 1]


def covered(uid, start, end) -> pd.DataFrame:
    parts = joined_spans(*(np.asarray(x, np.int64) for x in (uid, start, end)))
    return pd.DataFrame(dict(zip(("uid", "start", "end"), parts)))


COVER = "uid long, start long, end long"
PIECES = "kind int, bucket int, a binary, b binary, c binary, d binary, e binary, f binary"


def surroundings(t: DataFrame, back: DataFrame, length: int, gram: int, buckets: int, blocks: int) -> DataFrame:
    """Kind 0: the occurrences of shared minimizers with their bytes; kind 1: windows of hot ones; kind 2:
    spans that a task knows to be repeats of an earlier place of its own."""

    def cut_out(f: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        columns = ["kind", "bucket", *"abcdef"]
        if not len(f) or not len(known):
            return pd.DataFrame([], columns=columns)
        m, hot = (np.frombuffer(b"".join(known[c]), d) for c, d in (("a", "<i8"), ("b", np.uint8)))
        order = np.argsort(m)
        m, hot = m[order], hot[order] > 0
        seen, spans, pieces, windows, blobs = {}, [], [], [], []
        f = sorted_by_place(f)
        for z, uid, text in zip(f["z"], f["uid"], f["text"]):
            raw = text.encode()
            data = np.frombuffer(raw, np.uint8)
            place, value, first, last = minimizers(data, length, gram)
            at = np.minimum(np.searchsorted(m, value), len(m) - 1)
            mine = m[at] == value
            cold = np.flatnonzero(mine & ~hot[at])
            for p, v, i, j in zip(place[cold].tolist(), value[cold].tolist(), first[cold].tolist(), (last[cold] + length).tolist()):
                key = (p - i, raw[i:j])
                if key in seen:  # the same bytes around the same minimizer, earlier
                    spans.append((uid, i, j))
                else:
                    seen[key] = True
                    pieces.append((v, z, uid, p, p - i, j - p))
                    blobs.append(raw[i:j])
            warm = np.flatnonzero(mine & hot[at])
            if len(warm):
                s = np.concatenate([np.arange(i, j + 1) for i, j in zip(first[warm], last[warm])])
                a, b = (rolled(data, length, p)[s].view(np.int64) for p in (P1, P2))
                windows.append(np.stack([a, b, np.full(len(s), z), np.full(len(s), uid), s]))
        out = []
        if pieces:
            v, z, uid, p, n_left, n_right = (np.array(c, np.int64) for c in zip(*pieces))
            size = n_left + n_right
            begin = np.concatenate([[0], np.cumsum(size)])
            blob = b"".join(blobs)
            bucket = bucket_of(v, buckets).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edge = np.flatnonzero(np.concatenate([[True], bucket[order][1:] != bucket[order][:-1], [True]]))
            for i, j in zip(edge[:-1], edge[1:]):
                rows = order[i:j]
                body = b"".join(blob[begin[r] : begin[r + 1]] for r in rows)
                sides = np.stack([n_left[rows], n_right[rows]]).astype("<i2").tobytes()
                out.append((0, int(bucket[rows[0]]), v[rows].tobytes(), z[rows].tobytes(), uid[rows].tobytes(), p[rows].tobytes(), sides, body))
        if windows:
            w, later = first_windows(np.concatenate(windows, axis=1))
            spans += [(u, s, s + length) for u, s in zip(later[3].tolist(), later[4].tolist())]
            x = packed(w[0], buckets, w[1], w[2], w[3], w[4])
            out += [(1, *r, None) for r in x.itertuples(index=False, name=None)]
        if spans:
            c = covered(*zip(*spans))
            out.append((2, -1, *(c[n].to_numpy(np.int64).tobytes() for n in ("uid", "start", "end")), None, None, None))
        return pd.DataFrame(out, columns=columns)

    dealt = t.select("z", "uid", "text", block_of(F.col("uid"), blocks).alias("block"))
    return dealt.groupBy("block").cogroup(back.groupBy("block")).applyInPandas(cut_out, PIECES)


def first_windows(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns a, b, z, uid, s: the first place of each window (a, b), and all others."""
    w = w[:, np.lexsort((w[4], w[3], w[2], w[1], w[0]))]
    new = np.concatenate([[True], (w[0, 1:] != w[0, :-1]) | (w[1, 1:] != w[1, :-1])])
    return w[:, new], w[:, ~new]


REPEAT = "first_uid long, first_start long, n long, uid long, start long"


def search(f: pd.DataFrame, length: int, gram: int):
    """(rows, start, n) of the maximal repeats of one bucket, rows by place; and uid of each row."""
    v, z, uid, p = (np.frombuffer(b"".join(f[c]), "<i8") for c in "abcd")
    sides = np.concatenate([np.frombuffer(e, "<i2").reshape(2, -1) for e in f["e"]], axis=1).astype(np.int64)
    blob = np.frombuffer(b"".join(f["f"]), np.uint8)
    mid = np.concatenate([[0], np.cumsum(sides.sum(axis=0))])[:-1] + sides[0]
    order = np.lexsort((p, uid, z))  # rows by place, so that the least row of a group is its first
    v, uid, p, sides, mid = v[order], uid[order], p[order], sides[:, order], mid[order]
    wide = length - gram
    tree = Suffixes(v, matrix(blob, mid, sides[0], wide, back=True), sides[0], matrix(blob, mid, sides[1], length), sides[1])
    return tree.repeats(length, gram), uid, p


def cover(f: pd.DataFrame, length: int, gram: int) -> pd.DataFrame:
    """Spans of all occurrences but the first of each maximal repeat."""
    found, uid, p = search(f, length, gram)
    rows, left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for r, e, d in found:
        later = r.max(axis=1) if r.ndim == 2 else r[r != r.min()]
        rows.append(later)
        left.append(np.broadcast_to(e, len(later)))
        right.append(np.broadcast_to(d, len(later)))
    rows, left, right = (np.concatenate(x) for x in (rows, left, right))
    return covered(uid[rows], p[rows] - left, p[rows] + right)


def met(docs: DataFrame, length: int, gram: int, most: int, bucket_entries: int):
    rows, firsts, t = first_texts(docs, length)
    size = t.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks, buckets = int(size // (1 << 23) + 12), int(size // (length - gram) * 2 // bucket_entries + 12)
    back = written(shared_minimizers(t, length, gram, buckets, blocks, most), "repeats-shared")
    return rows, firsts, t, blocks, written(surroundings(t, back, length, gram, buckets, blocks), "repeats-pieces")


def maximal_repeats(docs: DataFrame, length: int = 100, gram: int = 32, most: int = 16_384, bucket_entries: int = 400_000) -> DataFrame:
    """One row per occurrence of each maximal repeat: doc_id, start, n (bytes), and the first occurrence,
    which names the repeat. Equal texts, and equal surroundings within one task, occur once. A repeat that
    reaches beyond the windows of one minimizer comes in overlapping parts; hot ones are not listed."""

    def listed(f: pd.DataFrame) -> pd.DataFrame:
        found, uid, p = search(f, length, gram)
        out = []
        for r, e, d in found:
            groups = zip(r, e, d) if r.ndim == 2 else [(r, e, d)]
            for g, left, right in groups:
                head = g.min()
                out += [(uid[head], p[head] - left, left + right, uid[x], p[x] - left) for x in g]
        return pd.DataFrame(out, columns=[c.split()[0] for c in REPEAT.split(", ")])

    _, _, t, _, pieces = met(docs, length, gram, most, bucket_entries)
    rows = pieces.where("kind = 0").groupBy("bucket").applyInPandas(listed, REPEAT).distinct()
    ids = t.select("uid", F.nullif("z", F.lit(-(1 << 63))).alias("doc_id"))
    first = ids.select(F.col("uid").alias("first_uid"), F.col("doc_id").alias("first_doc_id"))
    return rows.join(ids, "uid").join(first, "first_uid").select("first_doc_id", "first_start", "n", "doc_id", "start")


def remove_repeats(docs: DataFrame, length: int = 100, gram: int = 32, most: int = 16_384, bucket_entries: int = 400_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: each byte within `length` bytes that start earlier
    too is removed. Of rows equal in doc_id and text the first in the files is the earlier one."""
    rows, firsts, t, blocks, pieces = met(docs, length, gram, most, bucket_entries)

    def hot(f: pd.DataFrame) -> pd.DataFrame:
        w = np.stack([np.frombuffer(b"".join(f[c]), "<i8") for c in "abcde"])
        _, later = first_windows(w)
        return covered(later[3], later[4], later[4] + length)

    def known(frames):
        for f in frames:
            for a, b, c in zip(f["a"], f["b"], f["c"]):
                yield pd.DataFrame({n: np.frombuffer(x, "<i8") for n, x in (("uid", a), ("start", b), ("end", c))})

    spans = pieces.where("kind = 0").groupBy("bucket").applyInPandas(lambda f: cover(f, length, gram), COVER)
    spans = spans.unionByName(pieces.where("kind = 1").groupBy("bucket").applyInPandas(hot, COVER))
    spans = written(spans.unionByName(pieces.where("kind = 2").mapInPandas(known, COVER)), "repeats-cover")

    def cut(f: pd.DataFrame, spans: pd.DataFrame) -> pd.DataFrame:
        uid, start, end = joined_spans(*(spans[c].to_numpy(np.int64) for c in ("uid", "start", "end")))
        out = []
        for u, h, h2, text in zip(f["uid"], f["h"], f["h2"], f["text"]):
            raw, at, digest, gone = text.encode(), 0, hashlib.sha256(), 0
            lo, hi = np.searchsorted(uid, [u, u + 1])
            for i, j in zip(start[lo:hi].tolist(), end[lo:hi].tolist()):
                digest.update(raw[at:i])
                at, gone = j, gone + j - i
            digest.update(raw[at:])
            out.append((h, h2, gone, int(hi - lo), digest.hexdigest()))
        return pd.DataFrame(out, columns=["h", "h2", "n_removed", "n_spans", "kept_sha256"])

    dealt = t.select("uid", "h", "h2", "text", block_of(F.col("uid"), blocks).alias("block")).groupBy("block")
    done = dealt.cogroup(spans.select("*", block_of(F.col("uid"), blocks).alias("block")).groupBy("block"))
    done = done.applyInPandas(cut, "h long, h2 binary, n_removed long, n_spans long, kept_sha256 string")
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    first = firsts.join(done, ["h", "h2"]).withColumnRenamed("first_id", "doc_id").select(*columns)
    zero = F.lit(0).cast("long")
    short = texts(docs).where(F.octet_length("text") < length).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))
    counts = rows.where(f"n_bytes >= {length}").groupBy("doc_id", "h", "h2").agg(F.count("*").alias("c"))
    counts = counts.join(firsts, ["h", "h2"]).withColumn("c", F.col("c") - F.col("doc_id").eqNullSafe(F.col("first_id")).cast("long"))
    copies = counts.where("c > 0").select("doc_id", "n_bytes", F.explode(F.sequence(F.lit(1).cast("long"), "c")))
    copies = copies.select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(NOTHING).alias("kept_sha256"))
    return short.unionByName(copies).unionByName(first)
