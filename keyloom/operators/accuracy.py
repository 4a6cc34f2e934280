"""How well readings match what was meant: summaries, kinds of failure, and what a prior would change."""

from __future__ import annotations

from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from keyloom.functions import keypad
from keyloom.sources.kept import kept

from .corpus import cut
from .languages import ACTIVE, FREQUENCY, OTHER, log_probability

FRAGMENT, EXAMPLES = 4, 4
SHARES = (0.1, 0.2, 0.35, 0.5, 0.65, 0.8)  # fixed values: how far English is trusted in the sweep
KINDS = ("not in the dictionary", "split differently", "same keys", "different keys")
ID = ["doc_id", "pos", "part"]
MOST = 1 << 20  # sequences of a language that a task remembers


def attempts(rows: DataFrame, n: int = FRAGMENT) -> DataFrame:
    """worded lines to (ID, lang, wanted, keys): the typeable words of each line in fragments of n, and their keys with 0 between
    words. A line is one row, so nothing is shuffled."""
    t = rows.select("doc_id", "pos", "lang", F.filter("words", keypad.typeable_in_any).alias("ws"))
    t = t.select("doc_id", "pos", "lang", cut(F.col("ws"), n)).withColumnRenamed("words", "wanted")
    return t.select(*ID, "lang", "wanted", keypad.pressed(F.array_join("wanted", " ")).alias("keys"))


def slipped(rows: DataFrame) -> DataFrame:
    """Attempts as they might be pressed. By its place one key in eleven is missed, one in thirteen is pressed as the next
    digit, and one in seventeen is pressed twice."""
    salt = F.coalesce(F.pmod(F.col("doc_id") + F.col("pos") + F.col("part"), F.lit(11 * 13 * 17)), F.lit(-1))
    return rows.withColumn("keys", slips("keys", salt))


@F.pandas_udf(StringType())
def slips(keys: pd.Series, salt: pd.Series) -> pd.Series:
    """The keys of a batch one after another as an array of code points; a salt below 0 leaves them as they are."""
    size = keys.str.len().to_numpy(np.int64)
    each = np.frombuffer("".join(keys).encode("utf-32-le"), "<u4").astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(len(each)) - np.repeat(starts[:-1], size)
    salt = np.repeat(salt.to_numpy(np.int64), size)
    missed, slid, twice = ((salt >= 0) & ((at + salt) % n == 0) for n in (11, 13, 17))
    zero = ord("0")
    each = np.where(slid & (each >= zero) & (each <= zero + 9), zero + (each - zero + 1) % 10, each)
    times = np.where(missed, 0, np.where(twice & ~slid, 2, 1))
    text = np.repeat(each, times).astype("<u4").tobytes().decode("utf-32-le")
    ends = np.concatenate([[0], np.cumsum(times)])[starts].tolist()
    return pd.Series([text[a:b] for a, b in zip(ends, ends[1:])])


def own(lang: str, found: dict) -> str | None:
    """What the language in use reads."""
    return found[lang][1] if lang in found else None


def pooled(prior):
    """What all languages together read: the word that is worth most; of equals, that of the first language."""
    return lambda lang, found: min(((-(FREQUENCY * log_probability(points) + log(prior(lang, source))), source, word) for source, (points, word) in found.items()), default=(0, "", None))[2]


def looked_up(rows: DataFrame, lexs: DataFrame, **views) -> DataFrame:
    """rows(ID, lang, wanted, keys) with `known`: which wanted words some source holds, and for each of views what it reads
    from the groups of keys between zeros; null where a group has no word, or where there is no group. A view picks a word
    of those that the sources have first: view(lang, {source: (score, word)}).

    The vocabularies are bounded, so they are sent to the attempts: words that are taken apart, joined and brought together
    again would be shuffled many times over."""
    sent = rows.sparkSession.sparkContext.broadcast(lexs.select("seq", "lang", "score", "word", "pos").toArrow())
    kept_, picks = [*ID, "lang", "wanted"], list(views.values())
    words = "array<string>"
    schema = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in kept_) + "known array<boolean>, " + ", ".join(f"{c} {words}" for c in views)

    def run(batches):
        found: dict[str, dict] = {}
        for seq, source, points, word in zip(*[sent.value.sort_by("pos").column(c).to_pylist() for c in ("seq", "lang", "score", "word")]):
            found.setdefault(seq, {}).setdefault(source, (points, word))
        held = set(sent.value.column("word").to_pylist())
        read: dict[str, dict] = {}  # of each language, what was read before
        for b in batches:
            known, got = [], [[] for _ in picks]
            for lang, wanted, keys in zip(*[b.column(c).to_pylist() for c in ("lang", "wanted", "keys")]):
                known.append([w in held for w in wanted])
                mine = read.setdefault(lang, {})
                each = []
                for seq in keys.split("0"):
                    if seq:
                        if seq not in mine:
                            mine[seq] = tuple(pick(lang, found[seq]) for pick in picks) if seq in found else None
                        each.append(mine[seq])
                spelt = bool(each) and None not in each
                for k, out in enumerate(got):
                    one = [e[k] for e in each] if spelt else None
                    out.append(one if one and None not in one else None)
                if len(mine) > MOST:
                    mine.clear()
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept_], pa.array(known, pa.list_(pa.bool_())), *[pa.array(x, pa.list_(pa.string())) for x in got]], [*kept_, "known", *views])

    return rows.select(*kept_, "keys").mapInArrow(run, schema)


def right(wanted: Column, got: Column) -> Column:
    """Words that stand where they were meant: a word too many shifts all that follow. No reading has none right."""
    same = F.zip_with(wanted, F.coalesce(got, F.array().cast("array<string>")), lambda a, b: a.isNotNull() & a.eqNullSafe(b))
    return F.size(F.filter(same, lambda x: x))


def readings(rows: DataFrame, lexs: DataFrame) -> DataFrame:
    """(ID, lang, wanted, known, typed, read): what the lexicon of the language in use reads from the keys as they are, and
    what all languages together read."""
    prior = lambda lang, source: ACTIVE if source == lang else OTHER
    return looked_up(rows, lexs, typed=own, read=pooled(prior))


def percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.round(100.0 * part / F.nullif(whole, F.lit(0)), 9), F.lit(0.0))


def summary(rows: DataFrame) -> DataFrame:
    """readings() by language and, as ALL, of all languages: one aggregate over grouping sets. What the lexicons could
    reach at most, what is read as typed and with all languages, and what the better of the two has."""
    w, held = F.col("wanted"), F.filter("known", lambda x: x)
    t = rows.select(
        "lang", F.size("wanted").alias("n"), F.size(held).alias("covered"), (F.size(held) == F.size("wanted")).alias("possible"), F.col("typed").eqNullSafe(w).alias("exact"), F.col("read").eqNullSafe(w).alias("first"),
        F.coalesce("read", "typed").isNull().alias("missed"), right(w, F.col("read")).alias("right"), F.greatest(right(w, F.col("read")), right(w, F.col("typed"))).alias("better"),
    )
    n, words = F.count("*"), F.sum("n")
    share = lambda c: percent(F.count_if(c), n)
    out = t.groupingSets([[F.col("lang")], []], F.col("lang")).agg(
        F.grouping_id().alias("pooled"), n.alias("attempts"), words.alias("words"), share(F.col("possible")).alias("ceiling_phrases"), percent(F.sum("covered"), words).alias("ceiling_words"), share(F.col("exact")).alias("typed_phrases"),
        share(F.col("first")).alias("read_phrases"), share(F.col("first") | F.col("exact")).alias("any_phrases"), percent(F.sum("right"), words).alias("read_words"), percent(F.sum("better"), words).alias("best_words"), F.count_if("missed").alias("missed"),
    )
    return out.select(F.when(F.col("pooled") == 1, F.lit("ALL")).otherwise(F.col("lang")).alias("lang"), *out.columns[2:])


def counted(rows: DataFrame, most: int) -> DataFrame:
    """rows(kind, ID, at, example), most of which only count: of each batch of a task the first rows of each kind, with, as
    n, how many the batch has (in the first of them, 0 in the others)."""
    order = [*ID, "at"]

    def run(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            for kind in t.column("kind").unique().to_pylist():
                some = t.filter(pc.equal(t.column("kind"), kind))
                first = some.take(pc.sort_indices(some, [(c, "ascending") for c in order], null_placement="at_start")[:most])
                n = pa.array([some.num_rows] + [0] * (first.num_rows - 1), pa.int64())
                yield from first.append_column("n", n).combine_chunks().to_batches()

    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", n long")


def failures(rows: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """readings() to one row a kind: the wrong words of the pooled reading by the first kind that fits, their share, and
    the first examples by document, line, part and place. Each task keeps so many examples before they meet."""
    read = F.coalesce("read", F.array().cast("array<string>"))
    each = F.transform("wanted", lambda w, i: F.struct(i.alias("at"), w.alias("want"), F.get(read, i).alias("got"), F.get("known", i).alias("held")))
    t = rows.select(*ID, (F.size(read) == F.size("wanted")).alias("even"), F.explode(each).alias("w")).select(*ID, "even", "w.*").where(~F.col("want").eqNullSafe(F.col("got")))
    same = keypad.sequence_in_any(F.col("got")) == keypad.sequence_in_any(F.col("want"))
    kind = F.when(~F.col("held"), KINDS[0]).when(~F.col("even"), KINDS[1]).when(same, KINDS[2]).otherwise(KINDS[3])
    t = counted(t.select(kind.alias("kind"), *ID, "at", F.concat("want", F.lit(" > "), F.coalesce("got", F.lit("(nothing)"))).alias("example")), examples)
    t = kept(t, "failures")
    first = F.row_number().over(Window.partitionBy("kind").orderBy(*ID, "at"))
    shown = t.withColumn("nth", first).where(F.col("nth") <= examples).groupBy("kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "example"))), lambda x: x["example"]), ", ").alias("examples"))
    n = t.groupBy("kind").agg(F.sum("n").alias("n"))
    kinds = rows.sparkSession.createDataFrame([(k,) for k in KINDS], "kind string")
    out = kinds.join(n, "kind", "left").join(shown, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("examples", F.lit("")).alias("examples"))
    return out.select("kind", "n", percent(F.col("n"), F.sum("n").over(Window.partitionBy(F.lit(1)))).alias("share"), "examples")  # four rows


def prior_sweep(rows: DataFrame, lexs: DataFrame, shares: tuple[float, ...] = SHARES, language: str = "en") -> DataFrame:
    """For each share of trust in a language, the rest going to the others: phrases and words read right, in percent.
    All shares in one pass: the best word under each stands in an array."""
    prior = lambda p: lambda lang, source: p if source == language else 1.0 - p
    t = looked_up(rows, lexs, **{f"read{k}": pooled(prior(p)) for k, p in enumerate(shares)})
    hits = [right(F.col("wanted"), F.col(f"read{k}")) for k in range(len(shares))]
    # A reading with as many words as were meant, all in place, is the phrase.
    whole = [(h == F.size("wanted")) & (F.size(f"read{k}") == F.size("wanted")) for k, h in enumerate(hits)]
    t = t.agg(F.count("*").alias("attempts"), F.sum(F.size("wanted")).alias("words"), *[F.sum(h).alias(f"w{k}") for k, h in enumerate(hits)], *[F.count_if(p).alias(f"p{k}") for k, p in enumerate(whole)])
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("share"), percent(F.col(f"p{k}"), F.col("attempts")).alias("phrases"), percent(F.col(f"w{k}"), F.col("words")).alias("right_words")) for k, p in enumerate(shares)]))
    return t.select("attempts", each.alias("x")).select("attempts", "x.*")
