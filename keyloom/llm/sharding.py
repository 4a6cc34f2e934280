"""Histogram sort into shards of near equal bytes.

The key is (hash of the text, doc_id): equal texts are neighbours, and a group larger than a shard
is cut between doc_ids. Each round counts the exact bytes below every probe in all partitions and
narrows the interval around each target, until a splitter is within tolerance or its interval holds
one key. Rows are then exchanged once, by (shard, block), where a block is a hash of doc_id, so
neither a hot text nor a shard meets in one task. Null texts have size 1; rows with null doc_id sort
first; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

LOW, HIGH = -(1 << 63), (1 << 63) - 1
SPAN = 1 << 64


def _key(h: int, d: int) -> int:
    return (h - LOW) * SPAN + (d - LOW)


def _pair(key: int) -> tuple[int, int]:
    return key // SPAN + LOW, key % SPAN + LOW


def bytes_below(keyed: DataFrame, probes: list[int]) -> list[int]:
    """Exact bytes of the rows whose key is below each probe (ascending); partial sums per partition."""
    ph, pd_ = (np.array(x, dtype=np.int64) for x in zip(*map(_pair, probes)))

    def count(frames):
        total = np.zeros(len(ph) + 1, dtype=np.int64)
        for f in frames:
            h, d, s = (f[c].to_numpy(np.int64) for c in ("h", "d", "size"))
            lo, hi = np.searchsorted(ph, h, "left"), np.searchsorted(ph, h, "right")
            for i in np.flatnonzero(hi > lo):
                lo[i] += np.searchsorted(pd_[lo[i] : hi[i]], d[i], "right")
            np.add.at(total, lo, s)
        yield pd.DataFrame({"bucket": np.arange(len(total)), "size": total})

    got = dict(keyed.select("h", "d", "size").mapInPandas(count, "bucket int, size long").groupBy("bucket").agg(F.sum("size")).collect())
    return np.cumsum([got.get(i, 0) for i in range(len(probes))]).tolist()


def splitters(keyed: DataFrame, total: int, shards: int, tolerance: int, probes: int = 24) -> list[int]:
    goals = [total * k // shards for k in range(1, shards)]
    low = [(_key(LOW, LOW), 0)] * len(goals)
    high = [(_key(HIGH, HIGH) + 1, total)] * len(goals)
    best: list = [None] * len(goals)
    while todo := [i for i, b in enumerate(best) if b is None]:
        asked = sorted({low[i][0] + (high[i][0] - low[i][0]) * j // (probes + 1) for i in todo for j in range(1, probes + 1)})
        asked = [k for k in asked if _key(LOW, LOW) < k <= _key(HIGH, HIGH)]
        below = list(zip(asked, bytes_below(keyed, asked))) if asked else []
        for i in todo:
            for k, n in below:
                if n <= goals[i] and k > low[i][0]:
                    low[i] = (k, n)
                if n >= goals[i] and k < high[i][0]:
                    high[i] = (k, n)
            near = min(low[i], high[i], key=lambda x: abs(x[1] - goals[i]))
            if abs(near[1] - goals[i]) <= tolerance or high[i][0] - low[i][0] <= 1 or not below:
                best[i] = min(near[0], _key(HIGH, HIGH))
    return sorted(best)


def shard(docs: DataFrame, shards: int = 8, tolerance: float = 0.0005, block_rows: int = 20_000) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    keyed = written(
        docs.select(
            "doc_id",
            (F.octet_length(t) + 1).cast("long").alias("size"),
            F.crc32(F.encode(t, "UTF-8")).alias("text_crc32"),
            F.xxhash64(t).alias("h"),
            F.coalesce("doc_id", F.lit(LOW)).alias("d"),
        ),
        "sharding",
    )
    total, n = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    cuts = splitters(keyed, total, shards, max(1, int(total / shards * tolerance))) if n else []
    number = F.lit(0)
    for key in cuts:
        h, d = _pair(key)
        number = number + F.when((F.col("h") > h) | ((F.col("h") == h) & (F.col("d") >= d)), 1).otherwise(0)
    blocks = max(1, n // (shards * block_rows))
    dealt = keyed.withColumn("shard", number.cast("int")).withColumn("block", F.pmod(F.xxhash64("d"), F.lit(blocks)))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("shard", "block").agg(F.count("*").alias("n")).select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    slot = F.row_number().over(Window.partitionBy("shard", "block").orderBy("h", "d")) - 1
    return (
        dealt.withColumn("slot", slot)
        .join(offsets, ["shard", "block"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("slot") + F.col("offset")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
