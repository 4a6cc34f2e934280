"""Numeric band join by dyadic cover: every item meets the lines whose unit price lies near its own price.

The integers of all prices form a binary tree: node k of level l holds the prices from k * 2^l to (k + 1) * 2^l - 1.
An item's band, in two halves at its price, is the union of a few disjoint nodes; a line lies in one node of
each level. So an equi-join on nodes meets each pair exactly once. Neither pairs nor lines are multiplied by it:
lines are first reduced to one row a price, then to one row a node that holds what items ask for, their number, their
offsets, their checksums and, from either end, the first lines. Items of one price share their band.

Defined results: every row of items is an item of its own, so repeated rows repeat their result; an item without
item_id pairs with the lines of all items; lines without line_no count as having an empty one, which sorts first;
a price or amount that is null, no number or from 2^60 cents on, and a quantity of zero, pair with nothing.
A negative quantity is divided by like any other. Empty tables give no rows or rows of rank 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

FIRST = 5  # pairs listed for an item
LEAST, PER_MILLE = 10, 2  # a gap up to LEAST cents, or up to so many thousandths of the item's price
LARGEST = float(1 << 60)
LINE = ["sale_id", "line_no", "line_item_id"]
NODE = ["side", "level", "node"]


def cents(c: Column) -> Column:
    x = F.floor(100 * c + 0.5)
    return F.when(F.abs(100 * c) < LARGEST, x)


def unit_price(amount: Column, quantity: Column) -> Column:
    """floor((2a + q) / 2q), exactly, as the divisor is made positive."""
    q = F.when(quantity != 0, quantity.cast("long"))
    num = (2 * cents(amount) + q) * F.signum(q).cast("long")
    den = 2 * F.abs(q)
    return F.when(q.isNotNull(), F.call_function("div", num - F.pmod(num, den), den))


def reach(p: Column) -> Column:
    """The greatest gap of an item of price p."""
    return F.greatest(F.lit(LEAST), F.call_function("div", PER_MILLE * p - F.pmod(PER_MILLE * p, F.lit(1000)), F.lit(1000)))


def priced(lines: DataFrame) -> DataFrame:
    """Lines that may pair: LINE, u, and the checksum of what names the line."""
    t = lines.select(
        F.col("sale_id").cast("long").alias("sale_id"), F.col("line_no").cast("long").alias("line_no"), F.col("item_id").cast("long").alias("line_item_id"),
        unit_price(F.col("amount"), F.col("quantity")).alias("u"),
    )
    t = t.where("sale_id is not null and line_item_id is not null and u is not null")
    name = F.concat_ws(",", F.col("sale_id").cast("string"), F.coalesce(F.col("line_no").cast("string"), F.lit("")), F.col("line_item_id").cast("string"))
    return t.withColumn("crc", F.crc32(name))


def first(rows: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group; Spark limits the groups before it deals them out, too."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n).drop("nth")


def some_first(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rows of each group that suffice to find its FIRST rows of other items than a given one, whichever it is:
    of each item only its FIRST rows can count, and of those 2 * FIRST rows hold FIRST of others."""
    return first(first(rows, [*by, "line_item_id"], order, FIRST), by, order, 2 * FIRST)


def nodes(lines: DataFrame, levels: int) -> DataFrame:
    """For every node and either side: n, offsets (of its prices from its least one), crc, and its first lines as
    structs of the price's key and LINE. Side 0 counts upwards (key u), side 1 downwards (key -u)."""
    ends = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("u").alias("key")), F.struct(F.lit(1).alias("side"), (-F.col("u")).alias("key")))).alias("end")
    level = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")

    def under(t: DataFrame) -> DataFrame:
        """A row for each node above the price, on either side."""
        t = t.select("*", level).withColumn("node", F.expr("shiftright(u, level)"))
        return t.select("*", ends).select("*", "end.*").drop("end")

    sums = lines.groupBy("u").agg(F.count("*").alias("n"), F.sum("crc").alias("crc"))
    offset = F.col("n") * (F.col("u") - F.expr("shiftleft(node, level)"))
    sums = under(sums).groupBy(*NODE).agg(F.sum("n").alias("n"), F.sum(offset).alias("offsets"), F.sum("crc").alias("crc"))
    heads = under(some_first(lines.select("u", *LINE), ["u"], LINE))
    heads = some_first(heads.select(*NODE, "key", *LINE), NODE, ["key", *LINE])
    heads = heads.groupBy(*NODE).agg(F.array_sort(F.collect_list(F.struct("key", *LINE))).alias("heads"))
    return sums.join(heads, NODE)


def cover(prices: DataFrame, levels: int) -> DataFrame:
    """prices(p): the canonical nodes of either half of the band of p: above it (side 0), and from it down (side 1).
    At each level the half may own a node at its left end and one at its right end that its parent exceeds."""

    def half(side: int, lo: Column, hi: Column) -> Column:
        def at(k: Column) -> Column:
            left, right = -F.call_function("shiftright", -lo, k), F.call_function("shiftright", hi + 1, k)
            here = lambda node, odd: F.when((left < right) & (F.pmod(odd, F.lit(2)) == 1), F.struct(F.lit(side).alias("side"), k.alias("level"), node.alias("node")))
            return F.array(here(left, left), here(right - 1, right))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at))

    p, w = F.col("p"), reach(F.col("p"))
    both = F.filter(F.concat(half(0, p + 1, p + w), half(1, p - w, p)), lambda x: x.isNotNull())
    return prices.select("p", F.explode(both).alias("x")).select("p", "x.*")


def of_price(prices: DataFrame, lines: DataFrame, levels: int) -> DataFrame:
    """For each p: n, gap_sum and crc over all lines in its band, and the first of them, enough to leave FIRST
    when those of an item are taken out."""
    met = cover(prices, levels).join(nodes(lines, levels), NODE)
    base = F.expr("shiftleft(node, level)")
    up = F.col("side") == 0
    gaps = F.when(up, F.col("offsets") + F.col("n") * (base - F.col("p"))).otherwise(F.col("n") * (F.col("p") - base) - F.col("offsets"))
    line = lambda x: F.struct(F.when(up, x["key"] - F.col("p")).otherwise(x["key"] + F.col("p")).alias("gap"), F.when(up, x["key"]).otherwise(-x["key"]).alias("u"), *[x[c].alias(c) for c in LINE])
    met = met.select("p", "side", "n", "crc", gaps.alias("gaps"), F.transform("heads", line).alias("heads"))
    start, full = F.col("heads")[0]["gap"], F.size("heads") == 2 * FIRST
    by = met.groupBy("p").agg(
        F.sum("n").alias("n"), F.sum("gaps").alias("gap_sum"), F.sum("crc").alias("crc"), F.collect_list(F.struct("side", "heads")).alias("parts"),
        *[F.min(F.when(full & (F.col("side") == s), start)).alias(f"near{s}") for s in (0, 1)],
    )
    # Behind a node with as many lines as are asked for, no line of the same half can be among the first.
    near = lambda x: x["heads"][0]["gap"] <= F.coalesce(F.when(x["side"] == 0, F.col("near0")).otherwise(F.col("near1")), x["heads"][0]["gap"])
    heads = F.array_sort(F.flatten(F.transform(F.filter("parts", near), lambda x: x["heads"])))
    by = by.select("p", "n", "gap_sum", "crc", heads.alias("heads"))
    earlier = lambda x, i: F.size(F.filter(F.slice("heads", F.lit(1), i), lambda y: y["line_item_id"] == x["line_item_id"]))
    return by.withColumn("heads", F.slice(F.filter("heads", lambda x, i: earlier(x, i) < FIRST), 1, 2 * FIRST))


def own(items: DataFrame, lines: DataFrame, levels: int) -> DataFrame:
    """What an item's band holds of its own lines: met by item and stretch of prices, of which a band touches
    at most three, so that an item with very many lines is dealt out."""
    stretch = F.call_function("shiftright", F.col("u"), F.lit(levels))
    mine = lines.groupBy("line_item_id", "u").agg(F.count("*").alias("n"), F.sum("crc").alias("crc")).withColumn("stretch", stretch)
    p, w = F.col("p"), reach(F.col("p"))
    asked = items.select("item_id", "p", F.explode(F.sequence(F.call_function("shiftright", p - w, F.lit(levels)), F.call_function("shiftright", p + w, F.lit(levels)))).alias("stretch"))
    gap = F.abs(F.col("u") - p)
    met = asked.join(mine.withColumnRenamed("line_item_id", "item_id"), ["item_id", "stretch"]).where(gap <= w)
    return met.groupBy("item_id", "p").agg(F.sum("n").alias("own_n"), F.sum(F.col("n") * gap).alias("own_gap"), F.sum("crc").alias("own_crc"))


def near_lines(lines: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, rank, gap, u, LINE, n_pairs, gap_sum, lines_crc: the first pairs of every item, and sums over all."""
    lines = priced(lines)
    some = items.select("item_id", cents(F.col("price")).alias("p")).groupBy("item_id", "p").agg(F.count("*").alias("copies"))
    # One number: so many levels that a node of the last one is longer than half a band.
    widest = some.agg(F.max(reach(F.col("p")))).first()[0] or LEAST
    levels = int(widest).bit_length()
    prices = some.where("p is not null").select("p").distinct()
    # Written, so that Spark can split the join below where very many items have one price.
    bands = written(of_price(prices, lines, levels), "bands")
    some = some.join(own(some.where("p is not null"), lines, levels), ["item_id", "p"], "left").join(bands, "p", "left")
    less = lambda a, b: F.coalesce(F.col(a), F.lit(0)) - F.coalesce(F.col(b), F.lit(0))
    others = F.slice(F.filter("heads", lambda x: ~x["line_item_id"].eqNullSafe(F.col("item_id").cast("long"))), 1, FIRST)
    out = some.select("item_id", "copies", others.alias("heads"), less("n", "own_n").alias("n_pairs"), less("gap_sum", "own_gap").alias("gap_sum"), less("crc", "own_crc").alias("lines_crc"))
    out = out.select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    out = out.select("item_id", "n_pairs", "gap_sum", "lines_crc", F.posexplode_outer("heads").alias("at", "x"))
    return out.select("item_id", F.coalesce(F.col("at") + 1, F.lit(0)).alias("rank"), "x.gap", "x.u", *[f"x.{c}" for c in LINE], "n_pairs", "gap_sum", "lines_crc")
