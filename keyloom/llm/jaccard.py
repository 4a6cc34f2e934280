"""N-gram Jaccard join by T-occurrence search over inverted lists.

Rows with equal shingle sets form a class; classes are the nodes of the join, so rows without doc_id
and repeated doc_ids need no key. A partner of x shares T = ceil(share * |x|) shingles with it at
least, hence one of any |x| - T + 1 of them.

1. Screening: the first shingles of each set by hash, a tenth of the set more than |x| - T + 1, are
   counted over all classes. A class in which |x| - T + 1 of them occur nowhere else has no partner.
2. The whole sets of the classes left are ordered rarest shingle first. Classes that share one of
   their |x| - T + 1 rarest shingles are tied into clusters; partners are always in one cluster.
3. Each cluster is searched in one task, or in one task for each two blocks of it if it is large:
   DivideSkip merges the short lists of a query, probes its long lists by binary search for the
   candidates of the merge, and keeps what reaches the required overlap. A query is left out only if
   its class is already tied to the class that its cluster began with, as it could add no new group.
4. Groups are the connected components of the links; component_id is the least doc_id in a group.

Every exchange is packed, and counted before it in its task, so that a shingle or a text that a third
of all rows hold is one entry per task and not one per row. Texts without words link with nothing; a
group of rows that all lack doc_id has no component_id. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX, named, packed, renumbered, written

STEP = 0x100000001B3 | 0x5DEECE66 << 33
CHUNK = 1 << 20  # bytes of text hashed at a time, more only for one longer text
FLUSH = 1 << 20  # shingles held before an exchange
LONG = 64  # bytes; beyond, words are hashed one by one, as sums modulo 2^64 can be made to meet for long words

_bytes = np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 63, 256, dtype=np.uint64)
_bytes[65:91] = _bytes[97:123]  # A-Z as a-z
_space = np.zeros(256, bool)
_space[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        inverse = pow(STEP, -1, 1 << 64)
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, p, np.uint64)])) for p in (STEP, inverse)]
    return _powers


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    return h ^ (h >> np.uint64(29))


def _chunk_sets(encoded: list[bytes], k: int) -> list[np.ndarray]:
    data = np.frombuffer(b" ".join(encoded) + b" ", np.uint8)
    up, down = _grown(len(data))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], _space[data]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    total = np.concatenate([[np.uint64(0)], np.cumsum(_bytes[data] * up[: len(data)])])
    a = _mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    for w in np.flatnonzero(end - start > LONG):
        a[w] = xxhash.xxh3_64_intdigest(data[start[w] : end[w]].tobytes().lower())
    limits = np.searchsorted(start, np.cumsum([0] + [len(e) + 1 for e in encoded]))

    def joined(words: np.ndarray, size: int) -> np.ndarray:
        h = np.full(max(len(words) - size + 1, 0), size, np.uint64)
        for j in range(size if len(h) else 0):
            h = (h ^ words[j : j + len(h)]) * MIX
            h ^= h >> np.uint64(29)
        return h

    whole = joined(a, k)
    out = []
    for lo, hi in zip(limits[:-1], limits[1:]):
        n = hi - lo
        h = whole[lo : hi - k + 1] if n >= k else joined(a[lo:hi], int(n)) if n else np.zeros(0, np.uint64)
        out.append(np.unique(h.view(np.int64)))
    return out


def shingle_sets(texts_, k: int):
    """Sorted distinct 64-bit hashes of the k-word shingles (of the whole sequence where shorter) of each text."""
    held, size = [], 0
    for t in texts_:
        e = t.encode("utf-8", "surrogatepass")
        if held and size + len(e) > CHUNK:
            yield from _chunk_sets(held, k)
            held, size = [], 0
        held.append(e)
        size += len(e) + 1
    if held:
        yield from _chunk_sets(held, k)


def need(n, percent: int):
    """T: the least overlap with any partner of a set of n."""
    return (percent * n + 99) // 100


def class_of(s: np.ndarray) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(s.tobytes())
    return (x >> 64) - (1 << 63), (x & (1 << 64) - 1) - (1 << 63)


def components(links: DataFrame) -> DataFrame:
    """(id, comp): smallest id reachable over links (a, b); every step is a written table."""
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "cc-edges")
    label = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("comp")).withColumnRenamed("a", "id"), "cc-0")
    while True:
        seen = both.join(label.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("comp").alias("m")).withColumnRenamed("a", "id")
        step = label.join(seen, "id").select("id", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        up = label.select(F.col("id").alias("comp"), F.col("comp").alias("top"))
        new = written(step.join(up, "comp", "left").select("id", "old", F.least("comp", F.coalesce("top", "comp")).alias("comp")), "cc")
        label = new.select("id", "comp")
        if new.where("old <> comp").isEmpty():
            return label


def shared_counts(t: DataFrame, k: int, percent: int, tokens: int, bucket_tokens: int) -> DataFrame:
    """(x, shared): how many of the first shingles of each class other classes have among theirs too."""
    buckets = int(max(12, tokens * 3 // 10 // bucket_tokens))

    def sent(held: list, src: int):
        tok = np.concatenate([s for _, s in held])
        cls = np.repeat(np.array([x for x, _ in held], np.int64), [len(s) for _, s in held])
        u, at, back, n = np.unique(tok, return_index=True, return_inverse=True, return_counts=True)
        x, c = np.unique(cls[n[back] > 1], return_counts=True)  # these are known to be shared
        yield pd.DataFrame({"bucket": -1 - src % buckets, "x": x, "c": c, "src": src})
        # One entry for each shingle: the class that alone holds it here, or a mark that several do.
        out = packed(u, buckets, cls[at], (n > 1).astype(np.uint8))
        yield out.assign(src=src)

    def spread(frames):
        held, size, seen, src = [], 0, set(), TaskContext.get().partitionId() << 20
        for f in frames:
            for s in shingle_sets(f["text"], k):
                n = len(s)
                x = class_of(s)[0] if n else None
                if n and x not in seen:
                    seen.add(x)
                    held.append((x, s[: lead(n, percent)]))
                    size += len(held[-1][1])
                    if size >= FLUSH:
                        yield from sent(held, src)
                        held, size, src = [], 0, src + 1
                        seen.clear()
        if size:
            yield from sent(held, src)

    def meet(key, f: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0:
            return f[["x", "src", "c"]]
        tok, cls = (np.frombuffer(b"".join(f[c]), "<i8") for c in "ab")
        many = np.frombuffer(b"".join(f["many"]), np.uint8) > 0
        src = np.repeat(f["src"].to_numpy(), [len(a) // 8 for a in f["a"]])
        order = np.lexsort((cls, tok))
        t_, c_ = tok[order], cls[order]
        first = np.concatenate([[True], t_[1:] != t_[:-1]])
        group = np.cumsum(first) - 1
        kinds = np.bincount(group, first | np.concatenate([[False], c_[1:] != c_[:-1]]))
        shared = (kinds > 1) | (np.bincount(group, many[order]) > 0)
        keep = shared[group] & ~many[order]
        return pd.DataFrame({"x": c_[keep], "src": src[order][keep], "c": 1})

    columns = ["bucket", "src", "x", "c", "a", "b", "many"]

    def rows(frames):
        for out in spread(frames):
            yield out.assign(a=None, b=None, many=None)[columns] if "x" in out else out.rename(columns={"c": "many"}).assign(x=0, c=0)[columns]

    met = t.select("text").mapInPandas(rows, "bucket int, src long, x long, c long, a binary, b binary, many binary")
    met = met.groupBy("bucket").applyInPandas(lambda key, f: meet(key, f), "x long, src long, c long")
    # Each source counts the whole of its classes, so copies of a class give the same number.
    return met.groupBy("x", "src").agg(F.sum("c").alias("c")).groupBy("x").agg(F.max("c").alias("shared"))


def lead(n: int, percent: int) -> int:
    """Shingles of a set that are screened: a tenth more than any partner must reach."""
    return min(n, n - need(n, percent) + 1 + (n + 9) // 10)


def held_sets(f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of the rows of f and the row of each."""
    sets = [np.frombuffer(b, "<i8") for b in f["tokens"]]
    return np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])


def clusters(sets: DataFrame, blocks: int, buckets: int, percent: int) -> DataFrame:
    """(a, b): ids that tie classes which share one of their |x| - T + 1 rarest shingles."""

    def count(f: pd.DataFrame) -> pd.DataFrame:
        u, n = np.unique(held_sets(f)[0], return_counts=True)
        return packed(u, buckets, n.astype("<u4")).assign(block=int(f["block"].iloc[0]))

    def total(f: pd.DataFrame) -> pd.DataFrame:
        """Back to each block that asked: the shingles that two classes or more have, and how many."""
        tok = [np.frombuffer(a, "<i8") for a in f["a"]]
        u, back = np.unique(np.concatenate(tok), return_inverse=True)
        df = np.bincount(back, np.frombuffer(b"".join(f["b"]), "<u4")).astype("<u4")
        rows, at = [], 0
        for block, t in zip(f["block"], tok):
            n = df[back[at : at + len(t)]]
            at += len(t)
            rows.append((block, t[n > 1].tobytes(), n[n > 1].tobytes()))
        return pd.DataFrame(rows, columns=["block", "a", "b"])

    def tie(key, f: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        columns = ["bucket", "a", "b", "x", "y"]
        if not len(f) or not len(known):
            return pd.DataFrame([], columns=columns)
        tok, own = held_sets(f)
        u, df = (np.frombuffer(b"".join(known[c]), d) for c, d in (("a", "<i8"), ("b", "<u4")))
        order = np.argsort(u)
        u, df = u[order], df[order]
        at = np.minimum(np.searchsorted(u, tok), len(u) - 1)
        hit = u[at] == tok
        n = np.bincount(own, minlength=len(f))
        rare = n - np.bincount(own[hit], minlength=len(f))  # shingles that no other class has come first
        left = np.maximum(n - need(n, percent) + 1 - rare, 0)
        tok, own, df = tok[hit], own[hit], df[at[hit]]
        order = np.lexsort((tok, df, own))
        tok, own = tok[order], own[order]
        place = np.arange(len(own)) - np.searchsorted(own, own)
        tok, ids = tok[place < left[own]], f["id"].to_numpy(np.int64)[own[place < left[own]]]
        if not len(tok):
            return pd.DataFrame([], columns=columns)
        order = np.lexsort((ids, tok))
        tok, ids = tok[order], ids[order]
        first = np.concatenate([[True], tok[1:] != tok[:-1]])
        least = ids[np.maximum.accumulate(np.where(first, np.arange(len(tok)), 0))]
        ties = np.unique(np.stack([least[~first], ids[~first]]), axis=1)
        here = pd.DataFrame({"bucket": -1, "a": None, "b": None, "x": ties[0], "y": ties[1]})
        return pd.concat([here, packed(tok[first], buckets, ids[first]).assign(x=0, y=0)[columns]])

    def meet(f: pd.DataFrame) -> pd.DataFrame:
        tok, ids = (np.frombuffer(b"".join(f[c]), "<i8") for c in "ab")
        order = np.lexsort((ids, tok))
        tok, ids = tok[order], ids[order]
        first = np.concatenate([[True], tok[1:] != tok[:-1]])
        least = ids[np.maximum.accumulate(np.where(first, np.arange(len(tok)), 0))]
        ties = np.unique(np.stack([least, ids])[:, ~first], axis=1)
        return pd.DataFrame({"a": ties[0], "b": ties[1]})

    dealt = sets.select("id", "tokens", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    counts = dealt.groupBy("block").applyInPandas(count, "bucket int, a binary, b binary, block int")
    back = counts.groupBy("bucket").applyInPandas(total, "block int, a binary, b binary")
    tied = dealt.groupBy("block").cogroup(back.groupBy("block")).applyInPandas(lambda key, f, known: tie(key, f, known), "bucket int, a binary, b binary, x long, y long")
    tied = written(tied, "jaccard-ties")
    far = tied.where("bucket >= 0").groupBy("bucket").applyInPandas(meet, "a long, b long")
    return tied.where("bucket < 0").select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(far)


class Lists:
    """Inverted lists over the sets of one task, and the T-occurrence search in them."""

    MU = 0.01  # weight of a probe against a step of the merge, as DivideSkip has it

    def __init__(self, f: pd.DataFrame, percent: int):
        tok, own = held_sets(f)
        self.percent, self.n = percent, np.bincount(own, minlength=len(f))
        _, tok, df = np.unique(tok, return_inverse=True, return_counts=True)
        shared = df[tok] > 1  # a shingle of one set adds nothing to any overlap
        tok, own = tok[shared], own[shared]
        order = np.lexsort((own, tok))
        self.records, self.keys = own[order], tok[order] * len(f) + own[order]
        self.start = np.concatenate([[0], np.cumsum(np.where(df > 1, df, 0))])
        order = np.lexsort((tok, df[tok], own))
        self.of = tok[order]  # the lists of each record, shortest first
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(f)))])

    def query(self, x: int) -> np.ndarray:
        """Records whose overlap with x is large enough for the share asked for."""
        lists = self.of[self.begin[x] : self.begin[x + 1]]
        n, t = int(self.n[x]), int(need(int(self.n[x]), self.percent))
        if len(lists) < t:
            return np.zeros(0, np.int64)
        size = self.start[lists + 1] - self.start[lists]
        n_long = min(t - 1, int(t / (self.MU * np.log2(size[-1] + 1) + 1)))
        short, long_ = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
        merged = np.concatenate([self.records[self.start[s] : self.start[s + 1]] for s in short])
        found, count = np.unique(merged, return_counts=True)
        least = -(-self.percent * (n + self.n[found]) // (100 + self.percent))
        m = self.n[found]
        ok = (found != x) & (100 * np.minimum(n, m) >= self.percent * np.maximum(n, m)) & (count + n_long >= least)
        found, count, least = found[ok], count[ok], least[ok]
        for i in range(0, n_long, 64):
            if not len(found):
                break
            part = long_[i : i + 64]
            asked = part[:, None] * len(self.n) + found[None, :]
            at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
            count = count + (self.keys[at] == asked).sum(axis=0)
            ok = count + (n_long - i - len(part)) >= least
            found, count, least = found[ok], count[ok], least[ok]
        return found[count >= least]


def linked(f: pd.DataFrame, percent: int) -> pd.DataFrame:
    """(a, b): links enough to tie every group among the rows of f (id, cluster, tokens)."""
    lists = Lists(f, percent)
    ids, cluster = f["id"].to_numpy(np.int64), f["cluster"].to_numpy(np.int64)
    group, members = np.arange(len(f)), {i: [i] for i in range(len(f))}
    main: dict[int, int] = {}
    out = []
    share = np.diff(lists.begin) / np.maximum(lists.n, 1)
    for x in np.lexsort((ids, -share, cluster)):
        c = int(cluster[x])
        if c in main and group[x] == group[main[c]]:
            continue
        main.setdefault(c, int(x))
        for y in lists.query(int(x)):
            a, b = int(group[x]), int(group[y])
            if a != b:
                out.append((ids[x], ids[y]))
                if len(members[a]) < len(members[b]):
                    a, b = b, a
                moved = members.pop(b)
                group[moved] = a
                members[a] += moved
    return pd.DataFrame(out, columns=["a", "b"])


def links(sets: DataFrame, cluster: DataFrame, percent: int, task_tokens: int) -> DataFrame:
    """Searches every cluster; one of more than task_tokens is cut into blocks that meet two by two."""
    sized = sets.join(cluster, "id")
    weight = sized.groupBy("cluster").agg(F.sum("n").alias("w"))
    total = weight.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    tasks = int(max(12, total // task_tokens + 1))
    many = F.expr(f"cast(w div {task_tokens} + 1 as int)")
    place = sized.join(weight.withColumn("k", many), "cluster").withColumn("i", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    place = place.select("id", "cluster", "tokens", "k", "i", other.alias("o")).where("k = 1 or i <> o")
    lot = F.when(F.col("k") == 1, F.struct(F.lit(-1).cast("long").alias("c"), F.pmod(F.xxhash64("cluster"), F.lit(tasks)).cast("int").alias("p"), F.lit(0).alias("q")))
    lot = lot.otherwise(F.struct(F.col("cluster").alias("c"), F.least("i", "o").alias("p"), F.greatest("i", "o").alias("q")))
    return place.select("id", "cluster", "tokens", lot.alias("lot")).groupBy("lot").applyInPandas(lambda f: linked(f, percent), "a long, b long")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, bucket_tokens: int = 400_000, task_tokens: int = 2_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id; and x, y, the class of the row's set, h, the hash of its text."""
    t = named(docs)

    def first(frames):
        for f in frames:
            rows = [(d, h, len(s), *class_of(s)) for d, h, s in zip(f["doc_id"], f["h"], shingle_sets(f["text"], k))]
            yield pd.DataFrame(rows, columns=["doc_id", "h", "n", "x", "y"])

    signed = renumbered(t.withColumn("h", F.xxhash64("text")).mapInPandas(first, "doc_id string, h long, n long, x long, y long"), docs)
    signed = written(signed, "jaccard-sets")
    some = signed.where("n > 0")
    reps = written(some.groupBy("x", "y").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n")), "jaccard-reps")
    tokens = some.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    spare = f"(n - ({percent} * n + 99) div 100 + 1)"
    shared = shared_counts(t, k, percent, tokens, bucket_tokens)
    # Alive: fewer than |x| - T + 1 of the shingles screened are its own.
    alive = written(reps.join(shared, "x").where(f"least(n, {spare} + (n + 9) div 10) - shared < {spare}").select("x", "y", "n", "rep"), "jaccard-alive")

    def whole(frames):
        for f in frames:
            rows = [(*class_of(s), len(s), s.tobytes()) for s in shingle_sets(f["text"], k)]
            yield pd.DataFrame(rows, columns=["x", "y", "n", "tokens"])

    # Always the same join, whatever the size: texts and ids are exchanged by doc_id, nothing is broadcast.
    asked = alive.select(F.col("rep").cast("string").alias("rep")).distinct().hint("merge")
    sets = t.join(asked, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi").select("text").mapInPandas(whole, "x long, y long, n long, tokens binary")
    sets = sets.join(alive.select("x", "y"), ["x", "y"], "left_semi").dropDuplicates(["x", "y"])
    sets = written(sets.withColumn("id", F.monotonically_increasing_id()), "jaccard-alive-sets")
    held = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ties = written(clusters(sets, int(max(12, held // FLUSH)), int(max(12, held // bucket_tokens)), percent).distinct(), "jaccard-cluster-ties")
    cluster = components(ties).withColumnRenamed("comp", "cluster")
    comp = components(written(links(sets, cluster, percent, task_tokens), "jaccard-links"))
    node = sets.select("id", "x", "y").join(comp, "id").join(reps.select("x", "y", "rep"), ["x", "y"])
    least = node.groupBy("comp").agg(F.min("rep").alias("component_id"))
    tied = node.join(least, "comp").select("x", "y", "comp", "component_id")
    out = some.join(reps.select("x", "y", "rep"), ["x", "y"]).join(tied, ["x", "y"], "left")
    columns = ["doc_id", F.col("n").alias("n_shingles")]
    out = out.select(*columns, F.when(F.col("comp").isNull(), F.col("rep")).otherwise(F.col("component_id")).alias("component_id"), "x", "y", "comp", "h")
    none = F.lit(None).cast("long")
    return out.unionByName(signed.where("n = 0").select(*columns, F.col("doc_id").alias("component_id"), none.alias("x"), none.alias("y"), none.alias("comp"), "h"))


def kept(docs: DataFrame, **options) -> DataFrame:
    """Rows of docs, all columns: of each group the row with the least doc_id, rows without one last; of
    rows equal in doc_id and text one. Rows without words are in no group and all stay."""
    found = written(jaccard_components(docs, **options), "jaccard-kept")
    key = [F.coalesce("comp", F.lit(-1)).alias("g"), F.when(F.col("comp").isNull(), F.col("x")).alias("gx"), F.when(F.col("comp").isNull(), F.col("y")).alias("gy")]
    best = F.min(F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"), F.col("h").alias("t")))
    heads = found.where("n_shingles > 0").groupBy(*key).agg(best.alias("r")).select(F.col("r.d").alias("keep_d"), F.col("r.t").alias("keep_t"))
    heads = written(heads.distinct(), "jaccard-heads")
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), h.alias("row_t"), F.col("doc_id").alias("row_d"))
    mine = F.col("row_d").eqNullSafe(F.col("keep_d")) & (F.col("row_t") == F.col("keep_t"))
    stay = rows.join(heads, mine, "left_semi").dropDuplicates(["row_d", "row_t"])
    wordless = F.col("row.text").isNull() | ~F.col("row.text").rlike(r"[^\x20\x09-\x0D]")
    return stay.unionByName(rows.where(wordless)).select("row.*")
