"""Alignment of typed keys with their target, and error reports from it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.keypad import GRID

from . import scan

OK, SUBSTITUTION, DELETION, INSERTION = range(4)
NAMES = ["ok", "substitution", "deletion", "insertion"]
WORST = 6  # most common slips that are reported


CELLS = 1 << 23  # moves held at a time, more only for one longer pair
END = 4  # of a path
BINS = 1 << 20  # counted in an array up to so many, else by sorting


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, one row each, and their lengths."""
    size = np.array([len(t) for t in texts], np.int64)
    out = np.zeros((len(texts), int(size.max(initial=0))), np.uint32)
    out[np.arange(out.shape[1]) < size[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    return out, size


@dataclass
class Paths:
    """Unit-cost edit paths of many pairs, one step after the other: the pair of each step, its number, its move, and the
    places that it starts from."""

    a: np.ndarray
    b: np.ndarray
    size: np.ndarray  # of each wanted text
    pair: np.ndarray
    step: np.ndarray
    op: np.ndarray
    i: np.ndarray
    j: np.ndarray

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Code points of the wanted and the typed key of each step; -1 for none."""

        def at(codes, place, none):
            out = np.full(len(place), -1, np.int64)
            out[~none] = codes[self.pair[~none], place[~none]]
            return out

        return at(self.a, self.i, self.op == INSERTION), at(self.b, self.j, self.op == DELETION)


def traced(wanted: list[str], typed: list[str]) -> Paths:
    """Every cell records the move that reaches it cheapest, the diagonal before a deletion before an insertion; cells
    depend on none further on, so padding is harmless. Pairs lie side by side in memory, so each cell is one operation on
    all of them, on the way back too."""
    (a, la), (b, lb) = codes(wanted), codes(typed)
    n, m, k = len(wanted), a.shape[1], b.shape[1]
    size = np.uint8 if m + k < 255 else np.int32
    x, y = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    moves = np.full((m + 1, k + 1, n), INSERTION, np.uint8)
    moves[1:, 0] = DELETION
    moves[0, 0] = END
    cost = np.repeat(np.arange(k + 1, dtype=size)[:, None], n, axis=1)
    for i in range(1, m + 1):
        differs = y != x[i - 1]
        diagonal, down = cost[:-1] + differs.astype(size), cost[1:] + size(1)
        cost = np.empty_like(cost)
        cost[0] = i
        np.minimum(diagonal, down, out=cost[1:])
        for j in range(1, k + 1):
            np.minimum(cost[j], cost[j - 1] + size(1), out=cost[j])
        moves[i, 1:] = np.where(cost[1:] == diagonal, differs.view(np.uint8), np.where(cost[1:] == down, np.uint8(DELETION), np.uint8(INSERTION)))  # OK is 0, SUBSTITUTION 1
    back, flat, own = [], moves.reshape(-1), np.arange(n)
    at = (la * (k + 1) + lb) * n + own
    left = np.array([(k + 2) * n, (k + 2) * n, (k + 1) * n, n, 0])  # how far back a move leads
    while True:
        move = flat[at]
        if (move == END).all():
            break
        back.append(move)
        at = at - left[move]
    ops = np.array(back[::-1], np.uint8).reshape(-1, n).T
    real = ops != END
    down, right = real & (ops != INSERTION), real & (ops != DELETION)
    before = lambda c: (np.cumsum(c, axis=1) - c)[real]
    return Paths(a, b, la, np.repeat(own, real.sum(axis=1)), before(real), ops[real], before(down), before(right))


def paths(wanted: list[str], typed: list[str]) -> list[list[tuple[str, int, int]]]:
    out: list[list] = [[] for _ in wanted]
    t = traced(wanted, typed)
    for p, m, i, j in zip(t.pair.tolist(), t.op.tolist(), t.i.tolist(), t.j.tolist()):
        out[p].append((NAMES[m], i, j))
    return out


def align(wanted: str, typed: str) -> list[tuple[str, int, int]]:
    return paths([wanted], [typed])[0]


def together(wanted: list[str], typed: list[str]):
    """Places of pairs to align at once: pairs of like length, of bounded size."""
    order = np.lexsort(([len(t) for t in typed], [len(w) for w in wanted])).tolist()
    held, a, b = [], 0, 0
    for k in order:
        a, b = max(a, len(wanted[k]) + 1), max(b, len(typed[k]) + 1)
        if held and (len(held) + 1) * a * b > CELLS:
            yield held
            held, a, b = [], len(wanted[k]) + 1, len(typed[k]) + 1
        held.append(k)
    if held:
        yield held


def groups(batches):
    """(batch, places, paths) of Arrow batches with the columns wanted and typed."""
    for f in batches:
        wanted, typed = f.column("wanted").to_pylist(), f.column("typed").to_pylist()
        for some in together(wanted, typed):
            yield f, np.array(some), traced([wanted[k] for k in some], [typed[k] for k in some])


def letters(codes: np.ndarray) -> pa.Array:
    """Code points as strings; null for -1."""
    known, at = np.unique(codes, return_inverse=True)
    return pa.array([None if c < 0 else chr(c) for c in known.tolist()], pa.string()).take(pa.array(at))


STEPS = "step int, op string, i int, j int, wanted_key string, typed_key string"


def _types(rows: DataFrame, *columns: str) -> str:
    return "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in columns)


def aligned(rows: DataFrame, *with_: str) -> DataFrame:
    """rows(id, wanted, typed): one row per step. with_: columns that come along."""
    kept = ["id", *with_]
    names = [*kept, *[c.split()[0] for c in STEPS.split(", ")]]

    def run(batches):
        for f, some, t in groups(batches):
            row, (w, k) = pa.array(some[t.pair]), t.keys()
            ints = lambda x: pa.array(x.astype(np.int32))
            yield pa.RecordBatch.from_arrays([*[f.column(c).take(row) for c in kept], ints(t.step), pa.array(NAMES).take(pa.array(t.op)), ints(t.i), ints(t.j), letters(w), letters(k)], names)

    return rows.select(*kept, "wanted", "typed").mapInArrow(run, _types(rows, *kept) + STEPS)


def phrases(rows: DataFrame, *with_: str) -> DataFrame:
    """rows(wanted, typed), each phrase once: its moves of each kind. No steps leave the task that aligns."""

    def run(batches):
        for f, some, t in groups(batches):
            moves = np.bincount(t.pair * len(NAMES) + t.op, minlength=len(some) * len(NAMES)).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([*[f.column(c).take(pa.array(some)) for c in with_], *[pa.array(c) for c in moves.T.copy()]], [*with_, *NAMES])

    return rows.select(*with_, "wanted", "typed").mapInArrow(run, _types(rows, *with_) + ", ".join(f"{c} long" for c in NAMES))


def tally(rows: DataFrame) -> DataFrame:
    """rows(wanted, typed): how often (n) each key was pressed as each, or as none, or pressed for none, and whether the wanted
    key is that before (again) or after it (ahead) in the target; counted in the task that aligns. As many rows a task and
    batch as there are pairs of keys."""

    def run(batches):
        for _, _, t in groups(batches):
            w, k = t.keys()
            same = np.zeros((t.a.shape[0], t.a.shape[1] + 2), bool)  # as the key before
            same[:, 1:-2] = t.a[:, 1:] == t.a[:, :-1]
            again = (w >= 0) & same[t.pair, t.i]
            ahead = (w >= 0) & (t.i + 1 < t.size[t.pair]) & same[t.pair, t.i + 1]
            known = np.unique(np.concatenate([w, k]))
            at = ((np.searchsorted(known, w) * len(known) + np.searchsorted(known, k)) * 2 + again) * 2 + ahead
            if 4 * len(known) ** 2 <= BINS:
                n = np.bincount(at)
                at = np.flatnonzero(n)
                n = n[at]
            else:
                at, n = np.unique(at, return_counts=True)
            pair = at >> 2
            yield pa.RecordBatch.from_arrays([letters(known[pair // len(known)]), letters(known[pair % len(known)]), pa.array(at >> 1 & 1).cast(pa.bool_()), pa.array(at & 1).cast(pa.bool_()), pa.array(n.astype(np.int64))], ["wanted_key", "typed_key", "again", "ahead", "n"])

    t = rows.select("wanted", "typed").mapInArrow(run, "wanted_key string, typed_key string, again boolean, ahead boolean, n long")
    op = F.when(F.col("wanted_key").isNull(), NAMES[INSERTION]).when(F.col("typed_key").isNull(), NAMES[DELETION]).when(F.col("wanted_key") == F.col("typed_key"), NAMES[OK]).otherwise(NAMES[SUBSTITUTION])
    return t.groupBy("wanted_key", "typed_key", "again", "ahead").agg(F.sum("n").alias("n")).withColumn("op", op)


def tallied(steps: DataFrame) -> DataFrame:
    """Steps as tally() counts them; a tally stays as it is."""
    if "n" in steps.columns:
        return steps
    w = Window.partitionBy("id", F.col("wanted_key").isNull()).orderBy("i")
    near = lambda c: F.coalesce(F.col("wanted_key") == c, F.lit(False))
    t = steps.select("op", "wanted_key", "typed_key", near(F.lag("wanted_key").over(w)).alias("again"), near(F.lead("wanted_key").over(w)).alias("ahead"))
    return t.groupBy(*t.columns).agg(F.count("*").alias("n"))


def share(part, whole):
    return F.coalesce(F.round(100.0 * part / F.nullif(whole, F.lit(0)), 9), F.lit(0.0))


def many(some):
    """How many steps of a tally; 0 where there are none."""
    return F.coalesce(F.sum(F.when(some, F.col("n"))), F.lit(0))


def counted(steps: DataFrame, *by: str) -> DataFrame:
    """Error counts of steps, or of phrases(), by each column of by, and of all together in one aggregate over grouping sets:
    totals, their percentages of the wanted keys, and phrases without errors. pooled is 0 where a row belongs to one group of by."""
    per = steps if "ok" in steps.columns else steps.groupBy(*by, "id").agg(*[F.count_if(F.col("op") == op).alias(op) for op in NAMES])
    parts = [F.sum(op).alias(op) for op in NAMES] + [F.count("*").alias("phrases"), F.count_if(F.col("substitution") + F.col("deletion") + F.col("insertion") == 0).alias("perfect")]
    out = per.groupingSets([[F.col(c) for c in by], []], *[F.col(c) for c in by]).agg(F.grouping_id().alias("pooled"), *parts) if by else per.agg(*parts)
    out = out.withColumn("wanted", F.col("ok") + F.col("substitution") + F.col("deletion"))
    return out.select("*", *[share(F.col(op), F.col("wanted")).alias(f"{op}_share") for op in NAMES[1:]])


def error_counts(steps: DataFrame) -> DataFrame:
    return counted(steps)


def by_source(steps: DataFrame) -> DataFrame:
    """steps(source, id, op): one row per source and one, ALL, that pools them."""
    return counted(steps, "source").withColumn("source", F.when(F.col("pooled") == 0, F.col("source")).otherwise(F.lit("ALL"))).drop("pooled")


def missed(steps: DataFrame) -> DataFrame:
    """Deletions within a repeat (a neighbour in the target is the same key) and others, with the places
    where each could happen: adjacent equal keys, and all other wanted keys."""
    t = tallied(steps).where("wanted_key is not null")
    gone, twin = F.col("op") == "deletion", F.col("again") | F.col("ahead")
    out = t.agg(many(gone & twin).alias("in_repeat"), many(gone & ~twin).alias("isolated"), many(F.col("again")).alias("repeats"), many(F.lit(True)).alias("wanted"))
    out = out.withColumn("lone", F.col("wanted") - F.col("repeats"))
    return out.select("in_repeat", "isolated", "repeats", "lone", "wanted", share(F.col("in_repeat"), F.col("repeats")).alias("repeat_share"), share(F.col("isolated"), F.col("lone")).alias("lone_share"))


def confusion(steps: DataFrame) -> DataFrame:
    """How often each wanted key was pressed as another."""
    return tallied(steps).where("op = 'substitution'").groupBy("wanted_key", "typed_key").agg(F.sum("n").alias("n"))


def confused(steps: DataFrame) -> DataFrame:
    """Per wanted key: presses, misses and swaps in percent, and its commonest confusion (of equals the least)."""
    t = tallied(steps)
    per = t.where("wanted_key is not null").groupBy("wanted_key").agg(many(F.lit(True)).alias("wanted"), many(F.col("op") == "deletion").alias("missed"), many(F.col("op") == "substitution").alias("swapped"))
    worst = confusion(t).groupBy("wanted_key").agg(F.max_by("typed_key", F.struct(F.col("n"), -F.ascii("typed_key"))).alias("worst"))
    return per.join(worst, "wanted_key", "left").select("wanted_key", "wanted", share(F.col("missed"), F.col("wanted")).alias("miss_share"), share(F.col("swapped"), F.col("wanted")).alias("swap_share"), "worst")


def places(pad: str) -> dict[str, tuple[int, int]]:
    """Row and column of the key that presses each digit: on a remote as printed, on a numpad turned over."""
    turn = str.maketrans("123789", "789123")
    return {k: GRID[k if pad == "remote" else k.translate(turn)] for k in GRID}


def slips(steps: DataFrame, pad: str = "remote") -> DataFrame:
    """Substitutions by pair of keys, with whether the keys are neighbours on the pad."""
    where = F.create_map(*[F.lit(x) for k, (r, c) in places(pad).items() for x in (k, r * 10 + c)])
    a, b = (F.element_at(where, F.col(c)) for c in ("wanted_key", "typed_key"))
    step = F.greatest(F.abs(F.floor(a / 10) - F.floor(b / 10)), F.abs(a % 10 - b % 10))
    return confusion(steps).withColumn("adjacent", step == 1)


def worst_slips(steps: DataFrame, most: int = WORST, pad: str = "remote") -> DataFrame:
    """The most common slips: a report, so the limit is the feature."""
    return slips(steps, pad).orderBy(F.desc("n"), "wanted_key", "typed_key").limit(most)


def pace(records: DataFrame) -> DataFrame:
    """records(millis): median, tenth and ninetieth percentile by index, and greatest of all gaps but the
    first of each record. Gaps are counted by value first, so no task holds all of them."""
    gaps = records.select(F.posexplode("millis").alias("i", "gap")).where("i > 0").groupBy("gap").agg(F.count("*").alias("n"))
    return percentiles(gaps)


def percentiles(gaps: DataFrame) -> DataFrame:
    """gaps(gap, n), each gap once. Counts up to each gap come from an ordered scan, so no task holds all gaps."""
    t = scan.running(scan.dealt(gaps, [], ["gap"]), [], "n", "hi").withColumn("lo", F.col("hi") - F.col("n"))
    t = t.crossJoin(F.broadcast(gaps.agg(F.sum("n").alias("total"))))  # one row

    def at(i):
        return F.max(F.when((F.col("lo") <= i) & (F.col("hi") > i), F.col("gap")))

    total = F.col("total")
    low, high = F.expr("(total - 1) div 2"), F.expr("total div 2")
    out = t.agg(((at(low) + at(high)) / 2.0).alias("median"), at(F.expr("total div 10")).alias("p10"), at(F.expr("9 * total div 10")).alias("p90"), F.max("gap").alias("longest"), F.max(total).alias("gaps"))
    return out.where("gaps > 0")


def error_model(steps: DataFrame, pad: str = "remote") -> DataFrame:
    """The rates that aligned records measure, and the log costs of a decoder that follow from them, in one row. A rate that
    is not seen has no cost (null)."""
    place = F.create_map(*[F.lit(x) for k, (r, c) in places(pad).items() for x in (k, r * 10 + c)])
    a, b = (F.element_at(place, F.col(c)) for c in ("wanted_key", "typed_key"))
    near = F.greatest(F.abs(F.floor(a / 10) - F.floor(b / 10)), F.abs(a % 10 - b % 10)) == 1
    is_ = lambda op: F.col("op") == op
    spaces = F.col("wanted_key") == "0"
    steps = tallied(steps)
    n = steps.agg(
        many(is_("ok")).alias("ok"), many(is_("substitution") & near).alias("near"), many(is_("substitution") & ~near).alias("far"),
        many(is_("insertion")).alias("extra"), many(is_("deletion") & spaces).alias("no_space"), many(spaces).alias("spaces"),
    )
    t = n.crossJoin(F.broadcast(missed(steps)))  # one row each
    rate = lambda part, whole: F.col(part) / F.nullif(F.col(whole), F.lit(0))
    t = t.select(
        rate("ok", "wanted").alias("correct"), rate("near", "wanted").alias("adjacent"), rate("far", "wanted").alias("distant"), rate("extra", "wanted").alias("extra"),
        rate("in_repeat", "repeats").alias("swallowed"), rate("isolated", "lone").alias("missed"), rate("no_space", "spaces").alias("skipped_space"),
    )
    ln = lambda x: F.round(F.log(F.when(x > 0, x)), 9)
    c = F.col
    costs = [
        ln(c("adjacent") / 4 / c("correct")).alias("adjacent_cost"), ln(c("distant") / 4 / c("correct")).alias("distant_cost"), ln(c("extra") / c("correct")).alias("extra_cost"),
        ln(c("swallowed") / F.nullif(1 - c("swallowed"), F.lit(0))).alias("repeat_cost"), ln(c("missed") / c("correct")).alias("missed_cost"), ln(c("skipped_space") / F.nullif(1 - c("skipped_space"), F.lit(0))).alias("no_space_cost"),
    ]
    return t.select(*[F.round(x, 9).alias(x) for x in t.columns], *costs)
