"""Reports on typing records, pace and drills, with their SQL: the alignment itself is written in SQL too."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.functions import keypad
from keyloom.operators import align, drill, presses, scan
from keyloom.sources.tables import query_corpus, table, typing_record
from keyloom.streaming import runs

from .more import ASKED, EVENTS, FOUND, MERGED, MINE, QUERY, REPORT, SUMS, _drill_lines, _parts, _pool, _warm_costs
from .registry import BASE, LEX, PRESSES, READABLE, SEQ, _typed

# --- alignment: a list of costs for each wanted key, and the way back through the moves -----------------
SLIP = """array_to_string(list_transform(range(0, length(keys)), lambda i: case when (i + doc_id + pos + part) % 11 = 0 then '' when (i + doc_id + pos + part) % 13 = 0 then translate(keys[i + 1:i + 1], '0123456789', '1234567890')
    when (i + doc_id + pos + part) % 17 = 0 then keys[i + 1:i + 1] || keys[i + 1:i + 1] else keys[i + 1:i + 1] end), '')"""
DIFFERS = "case when x.c = typed[j:j] then 0 else 1 end"
MOVES = f"""list_reduce(list_prepend({{c: '', cost: list_transform(range(0, n + 1), lambda j: j), moves: []::varchar[]}}, list_transform(string_split(wanted, ''), lambda c: {{c: c, cost: []::bigint[], moves: []::varchar[]}})), lambda a, x:
    list_transform([list_transform(range(0, n + 1), lambda j: case when j = 0 then len(a.moves) + 1 else least(a.cost[j] + {DIFFERS}, a.cost[j + 1] + 1) end - j)], lambda r:
    list_transform([list_transform(range(0, n + 1), lambda j: list_min(r[1:j + 1]) + j)], lambda cost: {{c: x.c, cost: cost, moves: list_append(a.moves, array_to_string(list_transform(range(0, n + 1), lambda j:
        case when j = 0 then 'D' when cost[j + 1] = a.cost[j] + {DIFFERS} then case when x.c = typed[j:j] then 'O' else 'S' end when cost[j + 1] = a.cost[j + 1] + 1 then 'D' else 'I' end), ''))}})[1])[1]).moves"""
PATH = """list_reduce(list_prepend({i: m, j: n, ops: ''}, list_transform(range(0, m + n), lambda k: {i: 0::bigint, j: 0::bigint, ops: ''})), lambda a, x: case when a.i = 0 and a.j = 0 then a else
    list_transform([case when a.i = 0 then 'I' else moves[a.i][a.j + 1:a.j + 1] end], lambda o: {i: a.i - case when o = 'I' then 0 else 1 end, j: a.j - case when o = 'D' then 0 else 1 end, ops: o || a.ops})[1] end).ops"""
STEPS = f"""{BASE}, k as (select *, row_number() over (partition by doc_id, pos order by i) - 1 k from tokens where seq is not null),
tf as (select doc_id, pos, k // 4 part, coalesce(lang, '') source, string_agg(seq, '0' order by k) keys from k group by all),
ty as (select doc_id || '/' || pos || '/' || part id, source, keys wanted, {SLIP} typed from tf), sz as (select *, length(wanted) m, length(typed) n from ty),
mv as (select *, case when m = 0 then []::varchar[] else {MOVES} end moves from sz), pa as (select id, source, wanted, typed, {PATH} ops from mv),
un as (select *, unnest(range(0, length(ops))) step from pa), ij as (select *, ops[step + 1:step + 1] o, length(replace(ops[1:step], 'I', '')) i, length(replace(ops[1:step], 'D', '')) j from un),
steps as materialized (select id, source, step, case o when 'O' then 'ok' when 'S' then 'substitution' when 'D' then 'deletion' else 'insertion' end op, i, j, case when o <> 'I' then wanted[i + 1:i + 1] end wanted_key, case when o <> 'D' then typed[j + 1:j + 1] end typed_key from ij)"""


def _share(part: str, whole: str) -> str:
    return f"coalesce(round(100.0 * {part} / nullif({whole}, 0), 9), 0.0)::double"


COUNTED = "ok, substitution, deletion, insertion, phrases, perfect, ok + substitution + deletion wanted, " + ", ".join(f"{_share(op, 'ok + substitution + deletion')} {op}_share" for op in align.NAMES[1:])
PER = "per as (select source, id, " + ", ".join(f"count(*) filter (where op = '{op}') {op}" for op in align.NAMES) + " from steps group by all)"
SUMMED = ", ".join(f"cast(sum({op}) as bigint) {op}" for op in align.NAMES) + ", count(*) phrases, count(*) filter (where substitution + deletion + insertion = 0) perfect"
CONFUSION = "cf as (select wanted_key, typed_key, count(*) n from steps where op = 'substitution' group by all)"


def _slips(pad: str) -> str:
    place = "map {" + ", ".join(f"'{k}': {r * 10 + c}" for k, (r, c) in align.places(pad).items()) + "}"
    a, b = f"({place})[wanted_key]", f"({place})[typed_key]"
    return f"{STEPS}, {CONFUSION} select wanted_key, typed_key, n, greatest(abs({a} // 10 - {b} // 10), abs({a} % 10 - {b} % 10)) = 1 adjacent from cf order by n desc, wanted_key, typed_key limit {align.WORST}"


# --- queries ----------------------------------------------------------------------------------------
def _pace(s, d):
    """The gaps between the presses of each user."""
    t = scan.previous(scan.dealt(presses.presses(table(s, d, "events")), ["user_id"], ["ms", "event_id"]), ["user_id"], "ms")
    gaps = t.where("before_ms is not null").groupBy((F.col("ms") - F.col("before_ms")).alias("gap")).agg(F.count("*").alias("n"))
    return align.percentiles(gaps)


def _steps(s, d):
    return align.aligned(_typed(s, d))


def _tally(s, d):
    return align.tally(_typed(s, d))


PLACE = "map {" + ", ".join(f"'{k}': {r * 10 + c}" for k, (r, c) in align.places("remote").items()) + "}"
NEAR = f"greatest(abs(({PLACE})[wanted_key] // 10 - ({PLACE})[typed_key] // 10), abs(({PLACE})[wanted_key] % 10 - ({PLACE})[typed_key] % 10)) = 1"
MODEL = f"""{STEPS}, nb as (select op, coalesce(wanted_key = lag(wanted_key) over w, false) again, coalesce(wanted_key = lead(wanted_key) over w, false) ahead from steps where wanted_key is not null window w as (partition by id order by i)),
mi as (select count(*) filter (where op = 'deletion' and (again or ahead)) in_repeat, count(*) filter (where op = 'deletion' and not (again or ahead)) isolated, count(*) filter (where again) repeats, count(*) wanted from nb),
su as (select count(*) filter (where op = 'ok') ok, count(*) filter (where op = 'substitution' and {NEAR}) near, count(*) filter (where op = 'substitution' and not {NEAR}) far, count(*) filter (where op = 'insertion') extra, count(*) filter (where op = 'deletion' and wanted_key = '0') no_space, count(*) filter (where wanted_key = '0') spaces from steps),
ra as (select ok::double / nullif(wanted, 0) correct, near::double / nullif(wanted, 0) adjacent, far::double / nullif(wanted, 0) distant, extra::double / nullif(wanted, 0) extra, in_repeat::double / nullif(repeats, 0) swallowed, isolated::double / nullif(wanted - repeats, 0) missed, no_space::double / nullif(spaces, 0) skipped_space from su, mi)
select {', '.join(f'round({c}, 9) {c}' for c in ('correct', 'adjacent', 'distant', 'extra', 'swallowed', 'missed', 'skipped_space'))}, round(ln(nullif(adjacent / 4 / correct, 0)), 9) adjacent_cost, round(ln(nullif(distant / 4 / correct, 0)), 9) distant_cost, round(ln(nullif(extra / correct, 0)), 9) extra_cost,
    round(ln(nullif(swallowed / nullif(1 - swallowed, 0), 0)), 9) repeat_cost, round(ln(nullif(missed / correct, 0)), 9) missed_cost, round(ln(nullif(skipped_space / nullif(1 - skipped_space, 0), 0)), 9) no_space_cost from ra"""


# Records as text, as a recorder writes them; every seventh line lacks a field, every eleventh has one too many, so one
# in 77 has as many as it should, all out of place.
def _written_records(s, d):
    rows = _typed(s, d)
    n = F.crc32("id")
    keys = F.filter(F.split("typed", ""), lambda c: c != "")
    gaps = F.array_join(F.transform(keys, lambda c, i: F.when(i == 0, "0").otherwise("195")), ",")
    line = F.concat_ws("\t", F.when(F.pmod(n, F.lit(7)) != 0, F.col("source")), F.lit("3"), F.lit("remote"), "id", "typed", gaps, F.when(F.pmod(n, F.lit(11)) == 0, F.lit("x")))
    at = runs.place(s, "typing")
    rows.select(line.alias("value")).write.text(at)
    t = typing_record(s, at)
    return t.select("source", "at", "pad", "target", "keys", F.size("millis").alias("presses"))


def _written_queries(s, d):
    """User turns as a file of queries: blank lines and comments between them are passed over."""
    c = table(s, d, "conversations").where("role = 'user'")
    text = F.regexp_replace("text", r"[\t\n\r]", " ")
    line = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("#"), text)).when(F.col("turn") % 3 == 1, F.concat_ws("\t", text, F.lit("en"))).otherwise(F.concat_ws("\t", text, F.lit("mixed"), F.lit("note")))
    at = runs.place(s, "queries")
    c.select(F.explode(F.array(line, F.lit("  "))).alias("value")).write.text(at)
    return query_corpus(s, at)


CRC = """cast(xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split({0}, ''), lambda c: unicode(c)::ubigint)), lambda h, c:
    list_reduce(list_prepend(xor(h, c), [1::ubigint, 2, 3, 4, 5, 6, 7, 8]), lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384::ubigint) else x >> 1 end)), 4294967295::ubigint) as bigint)"""
TYPED = STEPS.split(", sz as")[0]


WARM = f"""{LEX}, {QUERY}, uses_ as (select conv_id, turn, word, {SEQ.format('word')} seq, least(count(*), 1000) uses from qw where {SEQ.format('word')} is not null group by all),
store as (select conv_id || '/' || turn user_id, conv_id, turn, word, seq, uses from uses_), asked as (select distinct user_id, seq query from store), {MINE}, {FOUND}, {MERGED},
got as (select s.conv_id, s.turn, m.word, m.rank from merged m join (select distinct user_id, conv_id, turn from store) s on s.user_id = m.user_id where m.exact and {SEQ.format('m.word')} = m.query), {_parts(['conv_id', 'turn'], 'got')}, {SUMS.format(on='w.conv_id = c.conv_id and w.turn = c.turn and w.word = c.word')} select {REPORT}"""

QUERIES = {
    "o41_alignment": (_steps, f"{STEPS} select id, step, op, i, j, wanted_key, typed_key from steps"),
    "o21_error_counts": (lambda s, d: align.error_counts(align.phrases(_typed(s, d))), f"{STEPS}, {PER}, su as (select {SUMMED} from per) select {COUNTED} from su"),
    "o22_repeat_misses": (lambda s, d: align.missed(_tally(s, d)), f"""{STEPS}, nb as (select op, coalesce(wanted_key = lag(wanted_key) over w, false) again, coalesce(wanted_key = lead(wanted_key) over w, false) ahead from steps where wanted_key is not null window w as (partition by id order by i)),
        su as (select count(*) filter (where op = 'deletion' and (again or ahead)) in_repeat, count(*) filter (where op = 'deletion' and not (again or ahead)) isolated, count(*) filter (where again) repeats, count(*) wanted from nb)
        select in_repeat, isolated, repeats, wanted - repeats lone, wanted, {_share('in_repeat', 'repeats')} repeat_share, {_share('isolated', '(wanted - repeats)')} lone_share from su"""),
    "o23_confusion": (lambda s, d: align.confusion(_tally(s, d)), f"{STEPS}, {CONFUSION} select wanted_key, typed_key, n from cf"),
    "o23_confused": (lambda s, d: align.confused(_tally(s, d)), f"""{STEPS}, {CONFUSION}, su as (select wanted_key, count(*) wanted, count(*) filter (where op = 'deletion') missed, count(*) filter (where op = 'substitution') swapped from steps where wanted_key is not null group by all),
        wo as (select wanted_key, first(typed_key order by n desc, typed_key) worst from cf group by wanted_key) select su.wanted_key, wanted, {_share('missed', 'wanted')} miss_share, {_share('swapped', 'wanted')} swap_share, worst from su left join wo on wo.wanted_key = su.wanted_key"""),
    "o24_slips": (lambda s, d: align.worst_slips(_tally(s, d)), _slips("remote")),
    "o24_numpad_slips": (lambda s, d: align.worst_slips(_tally(s, d), pad="numpad"), _slips("numpad")),
    "o26_by_source": (lambda s, d: align.by_source(align.phrases(_typed(s, d), "source")), f"{STEPS}, {PER}, su as (select case when grouping(source) = 1 then 'ALL' else source end source, {SUMMED} from per group by grouping sets ((source), ())) select source, {COUNTED} from su"),
    "o43_error_model": (lambda s, d: align.error_model(_tally(s, d)), MODEL),
    "o04_typing_record": (_written_records, f"""{TYPED}, n as (select *, {CRC.format('id')} n from ty) select source, 3 "at", 'remote' pad, id target, typed keys, length(typed) presses from n where n % 7 <> 0 and n % 11 <> 0
        union all select '3', null, id, typed, array_to_string(list_transform(range(0, length(typed)), lambda i: case when i = 0 then '0' else '195' end), ','), 1 from n where n % 77 = 0"""),
    "o05_query_corpus": (_written_queries, "with q as (select regexp_replace(text, '[\\t\\n\\r]', ' ', 'g') query, turn from conversations where role = 'user' and turn % 3 <> 0) select query, case turn % 3 when 1 then 'en' else 'mixed' end \"language\", case turn % 3 when 1 then null else 'note' end note from q where not starts_with(query, '#') and trim(query) <> ''"),
    "o25_pace": (_pace, f"""with {PRESSES}, g as (select ms - lag(ms) over (partition by user_id order by ms, event_id) gap from presses), o as (select list(gap order by gap) l, count(*) n from g where gap is not null)
        select (l[(n - 1) // 2 + 1] + l[n // 2 + 1]) / 2.0::double median, l[n // 10 + 1] p10, l[9 * n // 10 + 1] p90, l[n] longest, n gaps from o where n > 0"""),
    "o30b_report": (lambda s, d: drill.report(_pool(s, d)), f"""{LEX}, pool as (select seq from lex where length(word) between 3 and 9 and {READABLE} order by score desc, word limit 12000), ks as (select unnest(string_split(seq, '')) key from pool), n as (select key, count(*) n from ks where key <> '' group by key),
        rep as (select cast(sum(len(list_filter(range(2, length(seq) + 1), lambda i: seq[i:i] = seq[i - 1:i - 1]))) as bigint) doubled from pool)
        select cast(sum(n) as bigint) presses, first(key order by n, key) rarest, min(n) rarest_n, first(key order by n desc, key) commonest, max(n) commonest_n, any_value(doubled) doubled, {_share('any_value(doubled)', 'sum(n)')} doubled_share from n, rep"""),
    "o75_drill_lines": (_drill_lines, f"""{LEX}, pool as (select word, row_number() over (order by score desc, word) rank from lex where length(word) between 3 and 9 and {READABLE} order by score desc, word limit 12000)
        select (rank - 1) // {drill.PER_LINE} line, string_agg(word, ' ' order by rank) "text" from pool group by 1"""),
    "o81_warm_cost": (_warm_costs, WARM),
}


def queries() -> dict:
    return {k: f for k, (f, _) in QUERIES.items()}


def oracle_sql() -> dict:
    return {k: q for k, (_, q) in QUERIES.items() if q}
