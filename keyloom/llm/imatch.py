"""I-Match fingerprints, DataFrame functions only.

Terms are runs of letters and digits, lower-cased, as 32-bit hashes. The lexicon keeps terms whose
share of documents lies in [low, high] and that occur in two documents at least; it has at most
(mean distinct terms of a document) / low terms, whatever the number of documents. Up to `most` terms it
is one array, by buckets of the term, that every task gets with its plan; beyond, texts meet it in a
shuffled join, with the same result.

A fingerprint has `families` hashes. A family is a ladder of nested random subsets of the lexicon, each
half as dense as the one before. Its hash is that of the sorted distinct terms of the text in the
sparsest subset that has one, so it covers few terms of a text of any length and survives edits
elsewhere. Of a text without lexicon terms all terms are hashed, so that only equal texts agree there.
Likeness is the share of equal hashes. Null and empty texts share one fingerprint, that of no terms, and
are like each other only; repeated rows each give a row.

The next document comes from a window over ranges of doc_id, to each of which the first row of the
following range is added, so there is no global sort in one task of more than one row per range. Ranges
are of equal width between quantiles of doc_id, so outlying ids widen only the ranges of their quantile.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import texts, written


def terms(c):
    words = F.split(F.lower(c), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.hash(w)))


def ranges(t: DataFrame, range_rows: int, quantiles: int = 256):
    """b for each row of t: grows with d, and holds about range_rows rows."""
    at = [i / quantiles for i in range(1, quantiles)]
    cuts = sorted(set(t.agg(F.percentile_approx("d", at, 100 * quantiles)).first()[0] or []))
    above = F.array_size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c <= F.col("d"))) if cuts else F.lit(0)
    found = {r.c: r for r in t.groupBy(above.alias("c")).agg(F.min("d").alias("low"), F.max("d").alias("high"), F.count("*").alias("n")).collect()}
    lows, widths, starts, start = [], [], [], 0
    for c in range(len(cuts) + 1):
        low, high, n = (found[c].low, found[c].high, found[c].n) if c in found else (0, 0, 1)
        width = max(1, -(-(high - low + 1) * range_rows // n))
        lows, widths, starts = [*lows, low], [*widths, width], [*starts, start]
        start += (high - low) // width + 1
    listed = lambda v: F.array(*[F.lit(x).cast("decimal(20,0)") for x in v])
    cut = t.withColumn("c", above)
    place = [F.element_at(listed(v), F.col("c") + 1) for v in (lows, widths, starts)]
    return cut.withColumn("b", (F.floor((F.col("d").cast("decimal(20,0)") - place[0]) / place[1]) + place[2]).cast("long")).drop("c")


def with_next(docs: DataFrame, range_rows: int = 2000) -> DataFrame:
    """b, r: place of the row; nb, nr: place of the next; next: its text."""
    t = texts(docs).withColumn("d", F.coalesce("doc_id", F.lit(-1)).cast("long")).withColumn("h", F.xxhash64("text"))
    t = ranges(t, range_rows)
    first = t.groupBy("b").agg(F.min_by("text", F.struct("d", "h")).alias("text"))
    first = written(first, "imatch-first")
    w = Window.orderBy("b")
    links = first.select("b").select(F.col("b").alias("nb"), F.lag("b").over(w).alias("pb"), F.max("b").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("last"))
    ghosts = first.join(links.select(F.col("nb").alias("b"), F.coalesce("pb", "last").alias("pb")), "b")
    ghosts = ghosts.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(None).cast("long").alias("d"), F.lit(None).cast("long").alias("h"), F.col("pb").alias("b"), F.col("b").alias("gb"), F.lit(True).alias("ghost"))
    rows = t.withColumn("gb", F.col("b")).withColumn("ghost", F.lit(False)).unionByName(ghosts)
    w = Window.partitionBy("b").orderBy("ghost", "d", "h")
    seen = rows.select("doc_id", "text", "b", "ghost", F.row_number().over(w).alias("r"), F.lead("text").over(w).alias("next"), F.lead("gb").over(w).alias("nb"), F.lead("ghost").over(w).alias("ng"))
    return seen.where("not ghost").withColumn("nr", F.when(F.col("ng"), 1).otherwise(F.col("r") + 1)).drop("ghost", "ng")


def lexicon(docs: DataFrame, low: float, high: float) -> DataFrame:
    t = texts(docs)
    n = t.count()
    df = t.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").count()
    return df.where((F.col("count") >= max(2, low * n)) & (F.col("count") <= max(2, high * n))).select("term")


def bucketed(lex: DataFrame, buckets: int):
    """The lexicon as one array of `buckets` arrays, the terms t of each with pmod(t, buckets) in it."""
    spark = lex.sparkSession
    full = lex.groupBy(F.pmod("term", F.lit(buckets)).cast("long").alias("id")).agg(F.collect_list("term").alias("ts"))
    full = spark.range(buckets).join(full, "id", "left").select(F.struct("id", F.coalesce("ts", F.array().cast("array<int>")).alias("ts")).alias("s"))
    return full.agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["ts"]).alias("lex"))


def variable(one: DataFrame, kind: str) -> str:
    """A session variable with the only value of one; plans made while it lives keep that value."""
    spark, name = one.sparkSession, f"imatch_{uuid.uuid4().hex}"
    spark.sql(f"declare variable {name} {kind}")
    spark.sql(f"set var {name} = (select * from {{one}})", one=one)
    return name


def in_lexicon(rows: DataFrame, lex: DataFrame, most: int, *columns: str) -> DataFrame:
    """The arrays of terms in columns, without what the lexicon lacks; b, r is the key of a row."""
    size = lex.count()
    if size <= most:
        buckets = 1 << max(4, size.bit_length() - 1)
        name = variable(bucketed(lex, buckets), "array<array<int>>")
        held = lambda x: F.array_contains(F.element_at(F.expr(name), F.pmod(x, F.lit(buckets)).cast("int") + 1), x)
        out = rows.withColumns({c: F.filter(c, held) for c in columns})
        rows.sparkSession.sql(f"drop temporary variable {name}")
        return out
    for c in columns:
        own = rows.select("b", "r", F.explode(c).alias("term")).join(lex, "term", "left_semi").groupBy("b", "r").agg(F.collect_list("term").alias("ts"))
        rows = rows.join(own, ["b", "r"], "left").withColumn(c, F.coalesce("ts", F.array().cast("array<int>"))).drop("ts")
    return rows


def sparsest(hashes: str):
    """Of a column of hashes, those in the sparsest subset of the ladder that has any. The subsets of a ladder
    are the hashes below the powers of two, so the least hash tells which one it is."""
    longest = F.array(F.length(F.bin(F.array_min(hashes))))
    below = lambda bits: F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), 64 - bits)
    return F.transform(F.transform(longest, below), lambda top: F.sort_array(F.filter(hashes, lambda h: h <= top)))


def fingerprints(docs: DataFrame, families: int = 24, low: float = 0.0005, high: float = 0.1, most: int = 1 << 21) -> DataFrame:
    lex = written(lexicon(docs, low, high), "imatch-lexicon")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next", F.lit(1), half)))
    rows = rows.select("b", "r", "nb", "nr", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), terms(F.col("text")).alias("own"), terms(F.col("edited")).alias("changed"))
    sides = ("own", "changed")
    rows = rows.withColumns({f"all_{c}": F.xxhash64(F.sort_array(c)) for c in sides})
    rows = in_lexicon(rows, lex, most, *sides)

    names = {c: [f"{c}_{k}" for k in range(families)] for c in sides}
    hashed = lambda c, k: F.transform(c, lambda x: F.shiftrightunsigned(F.xxhash64(x, F.lit(k)), 1))
    rows = rows.withColumns({n: hashed(c, k) for c in sides for k, n in enumerate(names[c])})

    def prints(c):
        def one(k):
            whole = F.array(F.col(f"all_{c}"))
            return F.transform(sparsest(names[c][k]), lambda v: F.xxhash64(F.when(F.size(v) == 0, whole).otherwise(v), F.lit(k)))[0]

        return F.transform(F.array(*[one(k) for k in range(families)]), lambda h: F.lower(F.lpad(F.hex(h), 16, "0")))

    def likeness(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1.0).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x) / families

    kept = rows.select("b", "r", "nb", "nr", "doc_id", "n_chars", "edited_sha256", prints("own").alias("p"), prints("changed").alias("e"))
    done = written(kept, "imatch-prints")
    other = done.select(F.col("b").alias("nb"), F.col("r").alias("nr"), F.col("p").alias("q"))
    return done.join(other, ["nb", "nr"], "left").select(
        "doc_id", "n_chars", "edited_sha256", F.array_join("p", "-").alias("fingerprint"), F.array_join("e", "-").alias("edited_fingerprint"),
        likeness(F.col("p"), F.col("e")).alias("near_edited"), likeness(F.col("p"), F.col("q")).alias("near_next"),
    )
