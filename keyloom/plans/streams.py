"""Queries that run as streams over the tables, each with the SQL of what it must have emitted at the end."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.operators import casing, users
from keyloom.operators import presses as batch
from keyloom.sources.tables import table
from keyloom.streaming import presses, records, runs, words

from .more import EVENTS, turns_of
from .registry import CAPACITY, KEYMAP, PRESSES

HOUR = 3_600_000
SETTLES, PAUSE, LATE = 6 * HOUR, 6 * HOUR, HOUR  # the clock of the table: presses of a user are hours apart


def _presses(s, d, *also):
    t = runs.timed(runs.read(s, f"{d}/events.parquet"))
    return batch.presses(t, "ts", *also)


def _multitap(s, d):
    out = runs.drained(presses.multitap(_presses(s, d), SETTLES, 90 * 24 * HOUR, f"{LATE} milliseconds"), runs.place(s, "multitap"))
    return out.drop("undone")


def _debounced(s, d):
    return runs.drained(presses.debounced(_presses(s, d), PAUSE, f"{LATE} milliseconds"), runs.place(s, "debounced"))


def _learnt(s, d):
    said = users.learnable(turns_of(runs.read(s, f"{d}/conversations.parquet")))
    changes = runs.drained(words.learnt(said, CAPACITY), runs.place(s, "learnt"))
    return words.latest(changes).withColumn("uses", F.col("uses").cast("long"))


# Gestures of a user: a signup is the key that changes the case, an error a mark, all else a word.
KIND = "case event_type when 'signup' then 'shift' when 'error' then 'other' else 'word' end"


def _cased(s, d):
    e = table(s, d, "events").select("user_id", "event_id", "ts", F.expr(KIND).alias("kind"), F.col("event_type").alias("word"))
    return casing.cased(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "case", "written")


# A typist of the table: clicks and views are presses, a purchase accepts, an error undoes, a signup takes back.
ACTION = "case event_type when 'purchase' then 'accept' when 'error' then 'undo' when 'signup' then 'take_back' else 'press' end"


def _records(s, d):
    e = _presses(s, d, "event_type")
    e = e.select(F.col("user_id").cast("string").alias("source"), "event_id", "ms", F.expr(ACTION).alias("kind"), "digit", F.lit("remote").alias("pad"), F.lit("").alias("target"))
    at = runs.place(s, "records")
    records.appended(records.recorded(e), at)
    return records.records(s, at).select("source", "at", "keys", F.array_join(records.gaps(F.col("times")), ",").alias("millis"))


MARK = f"mark as (select max(ms) - {LATE} mark from presses)"
QUERIES = {
    "o50_multitap_stream": (_multitap, f"""with {PRESSES}, {MARK}, p as (select presses.* from presses, mark where ms <= mark),
        f as (select *, case when digit = lag(digit) over w and ms - lag(ms) over w <= {SETTLES} then 0 else 1 end new from p window w as (partition by user_id order by ms, event_id)),
        r as (select *, sum(new) over (partition by user_id order by ms, event_id) run from f), g as (select user_id, run, min(ms) started, max(ms) last, min(digit) digit, count(*) n, run = max(run) over (partition by user_id) ends from r group by user_id, run)
        select user_id, started, last, digit, n, substr({KEYMAP}[digit], cast((n - 1) % length({KEYMAP}[digit]) + 1 as int), 1) letter from g, mark where not ends or last + {SETTLES} <= mark"""),
    "o57_debounce_stream": (_debounced, f"""with p as (select user_id, epoch_us(ts) us from events), mark as (select (max(us) // 1000 - {LATE}) * 1000 mark from p),
        f as (select *, case when us - lag(us) over (partition by user_id order by us) < {PAUSE * 1000} then 0 else 1 end new from p), r as (select *, sum(new) over (partition by user_id order by us) g from f),
        s as (select user_id, min(us) // 1000 first_ms, max(us) // 1000 last_ms, count(*) n, max(us) last from r group by user_id, g) select user_id, first_ms, last_ms, n from s, mark where last + {PAUSE * 1000} <= mark"""),
    "o13_case_stream": (_cased, f"""with recursive e as (select user_id, event_id, event_type word, {KIND} kind, row_number() over (partition by user_id order by ts, event_id) k from events),
        s as (select *, 0 state from e where k = 1 union all select e.*, case s.kind when 'shift' then (s.state + 1) % 3 when 'word' then case when s.state = 1 then 0 else s.state end else s.state end from s join e on e.user_id = s.user_id and e.k = s.k + 1)
        select user_id, event_id, ['lower', 'once', 'locked'][state + 1] "case", case when kind = 'word' then case state when 0 then word when 1 then upper(word[1:1]) || word[2:] else upper(word) end end written from s"""),
    "o72_records": (_records, f"""with {PRESSES}, e as (select cast(p.user_id as varchar) source, {ACTION} kind, p.digit, p.ms, p.event_id from presses p join events using (event_id)),
        l as (select source, list({{kind: kind, ms: ms, digit: digit, pos: 0, keys: '', times: []::bigint[], rows: []::struct(at_ int, keys varchar, times bigint[])[]}} order by ms, event_id) es from e group by source),
        f as (select source, list_reduce(list_prepend({{kind: '', ms: 0::bigint, digit: '', pos: 0, keys: '', times: []::bigint[], rows: []::struct(at_ int, keys varchar, times bigint[])[]}}, es), lambda a, x: case x.kind
            when 'press' then {{kind: '', ms: x.ms, digit: '', pos: a.pos, keys: a.keys || x.digit, times: list_append(a.times, x.ms), rows: a.rows}}
            when 'undo' then {{kind: '', ms: x.ms, digit: '', pos: a.pos, keys: a.keys[:greatest(length(a.keys) - 1, 0)], times: a.times[:greatest(len(a.times) - 1, 0)], rows: a.rows}}
            when 'accept' then {{kind: '', ms: x.ms, digit: '', pos: a.pos + 1, keys: '', times: []::bigint[], rows: case when a.keys = '' then a.rows else list_append(a.rows, {{at_: a.pos, keys: a.keys, times: a.times}}) end}}
            else case when a.pos = 0 then a else list_transform([coalesce(list_filter(a.rows, lambda r: r.at_ = a.pos - 1)[1], {{at_: 0, keys: '', times: []::bigint[]}})], lambda o:
                {{kind: '', ms: x.ms, digit: '', pos: a.pos - 1, keys: o.keys, times: list_transform(o.times, lambda t: t + x.ms - o.times[-1]), rows: list_filter(a.rows, lambda r: r.at_ <> a.pos - 1)}})[1] end end).rows rows from l),
        u as (select source, unnest(rows) r from f) select source, r.at_ "at", r.keys keys, array_to_string(list_transform(range(1, len(r.times) + 1), lambda k: case when k = 1 then 0 else r.times[k] - r.times[k - 1] end), ',') millis from u"""),
    "o58_learn_stream": (_learnt, f"with {EVENTS} select user_id, word, uses from store"),
}


def queries() -> dict:
    return {k: f for k, (f, _) in QUERIES.items()}


def oracle_sql() -> dict:
    return {k: q for k, (_, q) in QUERIES.items() if q}
