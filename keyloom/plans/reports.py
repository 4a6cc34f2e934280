"""Queries over all languages: lexicons, pair tables, readings, accuracy and failures, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.functions import keypad
from keyloom.operators import accuracy, context, corpus, languages
from keyloom.sources.tables import lines, table

from .registry import FNV

# --- SQL building blocks -------------------------------------------------------------------------
A, B = keypad.ALL_LETTERS, keypad.ALL_DIGITS
FOLDED = """lower(replace(translate({0}, ' ‘’“”–—', ' ''''""--'), '…', '...'))"""
TIDY = "regexp_replace(trim(regexp_replace(regexp_replace({0}, '[^{1}]', ' ', 'g'), ' +', ' ', 'g')), '^(?:- *)+', '')"


def _norm(line: str, lang: str) -> str:
    """Each line by the alphabet of its language."""
    one = lambda name: TIDY.format(FOLDED.format(line), keypad.alphabet_of(name).replace("'", "''"))
    return f"case {lang} " + " ".join(f"when '{name}' then {one(name)}" for name, extra in keypad.EXTRA.items() if extra) + f" else {one('en')} end"


SEQ = f"case when regexp_full_match(lower({{0}}), '[{A}]*') then translate(lower({{0}}), '{A}', '{B}') end"
LINES = f"""ll as (select doc_id, coalesce(lang, '') lang, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) - 1 pos from documents),
nl as (select doc_id, lang, pos, {_norm('line', 'lang')} line from ll)"""
TOKENS = f"""{LINES}, lws as (select doc_id, lang, pos, list_filter(string_split(line, ' '), lambda w: w <> '') ws from nl),
lparts as (select doc_id, lang, pos, unnest(ws) word, generate_subscripts(ws, 1) - 1 i from lws),
tok as (select *, {SEQ.format('word')} seq from lparts)"""
COUNTS = f"""{TOKENS}, tl as (select unnest(string_split(text, chr(10))) line from benchmark), tw as (select unnest(list_filter(string_split({_norm('line', "'en'")}, ' '), lambda w: w <> '')) word from tl),
cnt as (select lang, word, cast(sum(w) as bigint) n from (select lang, word, 1 w from tok where seq is not null union all select 'en', word, {corpus.TITLE_WEIGHT} from tw where {SEQ.format('word')} is not null) group by all)"""
LEX = f"""{COUNTS}, best_ as (select lang, word, n, {SEQ.format('word')} seq, max(n) over (partition by lang) most, row_number() over (partition by lang order by n desc, word) k from cnt),
lex as (select lang, word, n, seq, cast(least(255, greatest(1, 1 + trunc(254 * ln(1 + n) / ln(1 + most)))) as int) score, row_number() over (partition by lang order by seq, n desc, word) - 1 pos from best_ where k <= {corpus.VOCABULARY})"""
# The sources of a sequence: first word, its score, alternatives.
SOURCES = f"""src as (select lang source, seq, arg_min(word, pos) word, arg_min(score, pos) score, string_agg(word, ' ' order by pos) alternatives
    from (select *, row_number() over (partition by lang, seq order by pos) k from lex) where k <= {languages.ALTERNATIVES} group by all)"""
PAIRS = f"""kn as (select t.doc_id, t.lang, t.pos, t.i, t.word, l.word is not null known from tok t left join lex l on t.lang = l.lang and t.word = l.word),
lg as (select lang, word, known, lag(word) over w prev, lag(known) over w before from kn window w as (partition by doc_id, pos order by i)),
pr as (select lang, prev, word, count(*) n from lg where known and before group by all),
pk as (select * from (select *, row_number() over (partition by lang order by n desc, prev, word) k from pr where n >= {corpus.PAIR_FLOOR}) where k <= {corpus.PAIR_KEEP}),
tt as (select lang, sum(n)::double t from cnt group by lang),
pm as (select p.lang, p.prev, p.word, p.n, round(least({languages.MOST}, greatest({languages.LEAST}, ln((p.n / t) / ((a.n / t) * (b.n / t))))), 9)::double pmi from pk p join cnt a on a.lang = p.lang and a.word = p.prev join cnt b on b.lang = p.lang and b.word = p.word join tt on tt.lang = p.lang),
sp as (select *, min(pmi) over (partition by lang) lo, case when max(pmi) over (partition by lang) > min(pmi) over (partition by lang) then max(pmi) over (partition by lang) - min(pmi) over (partition by lang) else 1.0::double end width from pm),
st as (select *, cast(least(255, greatest(1, 1 + trunc(254 * (pmi - lo) / width))) as int) step, {FNV} u from sp),
pt as materialized (select lang, prev, word, n, pmi, step, cast(case when u >= 9223372036854775808 then u::hugeint - 18446744073709551616 else u::hugeint end as bigint) hash, round(lo + (step - 1) * width / 254.0::double, 9)::double score from st)"""
ATTEMPTS = f"""fk as (select *, row_number() over (partition by doc_id, pos order by i) - 1 k from tok where seq is not null),
at_ as (select doc_id, pos, cast(k // {accuracy.FRAGMENT} as int) part, lang, list(word order by k) wanted, string_agg(seq, '0' order by k) keys from fk group by all)"""
SLIPPED = """sl as (select doc_id, pos, part, lang, wanted, array_to_string(list_transform(range(0, length(keys)), lambda i: case when (i + doc_id + pos + part) % 11 = 0 then '' when (i + doc_id + pos + part) % 13 = 0 then translate(keys[i + 1:i + 1], '0123456789', '1234567890')
    when (i + doc_id + pos + part) % 17 = 0 then keys[i + 1:i + 1] || keys[i + 1:i + 1] else keys[i + 1:i + 1] end), '') keys from at_)"""


def _worth(prior: str) -> str:
    return f"({languages.FREQUENCY} * ((score - 255) * 15.0::double / 254.0::double) + ln({prior}::double))"


def _read(rows: str) -> str:
    """typed and read of each attempt as lists, null where a group spells nothing; known: wanted words that a source holds."""
    return f"""gr as (select doc_id, pos, part, lang, unnest(list_filter(string_split(keys, '0'), lambda g: g <> '')) seq, generate_subscripts(list_filter(string_split(keys, '0'), lambda g: g <> ''), 1) at_no from {rows}),
    pairs_ as (select distinct lang, seq from gr), ans as (select p.lang, p.seq, max(case when s.source = p.lang then s.word end) own, first(s.word order by {_worth(f"case when s.source = p.lang then {languages.ACTIVE} else {languages.OTHER} end")} desc, s.source) pooled from pairs_ p join src s on s.seq = p.seq group by all),
    rd as (select gr.doc_id, gr.pos, gr.part, case when count(own) = count(*) then list(own order by at_no) end typed, case when count(pooled) = count(*) then list(pooled order by at_no) end read_ from gr left join ans on gr.lang = ans.lang and gr.seq = ans.seq group by all),
    held as (select distinct word from lex),
    kw as (select fk.doc_id, fk.pos, cast(k // {accuracy.FRAGMENT} as int) part, list(held.word is not null order by k) known from fk left join held on fk.word = held.word group by all),
    res as (select a.doc_id, a.pos, a.part, a.lang, a.wanted, kw.known, rd.typed, rd.read_ from {rows} a join kw using (doc_id, pos, part) left join rd using (doc_id, pos, part))"""


RIGHT = "len(list_filter(range(1, least(len(wanted), len(coalesce({0}, []::varchar[]))) + 1), lambda i: wanted[i] = {0}[i]))"
SUMMARY = f"""me as (select lang, len(wanted) n, len(list_filter(known, lambda x: x)) covered, coalesce(typed = wanted, false) exact, coalesce(read_ = wanted, false) first_, typed is null and read_ is null missed, coalesce({RIGHT.format('read_')}, 0) right_, greatest(coalesce({RIGHT.format('read_')}, 0), coalesce({RIGHT.format('typed')}, 0)) better from res)
select case when grouping(lang) = 1 then 'ALL' else lang end lang, count(*) attempts, cast(sum(n) as bigint) words, round(100.0 * count(*) filter (where covered = n) / count(*), 9)::double ceiling_phrases, round(100.0 * sum(covered)::double / sum(n)::double, 9) ceiling_words, round(100.0 * count(*) filter (where exact) / count(*), 9)::double typed_phrases,
    round(100.0 * count(*) filter (where first_) / count(*), 9)::double read_phrases, round(100.0 * count(*) filter (where first_ or exact) / count(*), 9)::double any_phrases, round(100.0 * sum(right_)::double / sum(n)::double, 9) read_words, round(100.0 * sum(better)::double / sum(n)::double, 9) best_words, count(*) filter (where missed) missed
from me group by grouping sets ((lang), ())"""
FAILURES = f"""wr as (select doc_id, pos, part, unnest(range(0, len(wanted))) at_no, wanted, known, coalesce(read_, []::varchar[]) got from res),
ww as (select doc_id, pos, part, at_no, wanted[at_no + 1] want, got[at_no + 1] saw, known[at_no + 1] held, len(got) = len(wanted) even from wr where wanted[at_no + 1] is distinct from got[at_no + 1]),
kd as (select *, case when not held then '{accuracy.KINDS[0]}' when not even then '{accuracy.KINDS[1]}' when {SEQ.format('saw')} = {SEQ.format('want')} then '{accuracy.KINDS[2]}' else '{accuracy.KINDS[3]}' end kind from ww),
nth as (select kind, want || ' > ' || coalesce(saw, '(nothing)') example, row_number() over (partition by kind order by doc_id, pos, part, at_no) k from kd),
per as (select kind, count(*) n, string_agg(example, ', ' order by k) filter (where k <= {accuracy.EXAMPLES}) examples from nth group by kind)
select k.kind, coalesce(n, 0) n, coalesce(examples, '') examples, coalesce(round(100.0 * coalesce(n, 0) / nullif(sum(coalesce(n, 0)) over (), 0), 9), 0)::double share from (values {', '.join(f"('{k}')" for k in accuracy.KINDS)}) k(kind) left join per on per.kind = k.kind"""


def _sweep() -> str:
    """Every share joined with the data, where the query has them in one pass."""
    shares = ", ".join(f"({p}::double)" for p in accuracy.SHARES)
    return f"""sh as (select * from (values {shares}) s(share)), gq as (select distinct seq from (select unnest(string_split(keys, '0')) seq from at_) where seq <> ''),
    pick as (select share, s.seq, first(word order by {languages.FREQUENCY} * ((score - 255) * 15.0::double / 254.0::double) + ln(case when source = 'en' then share else 1.0 - share end) desc, source) word from sh, src s join gq on gq.seq = s.seq group by all),
    w6 as (select fk.doc_id, fk.pos, cast(fk.k // {accuracy.FRAGMENT} as int) part, fk.word, sh.share, p.word got from fk cross join sh left join pick p on p.seq = fk.seq and p.share = sh.share),
    a6 as (select doc_id, pos, part, share, count(*) n, case when count(got) = count(*) then count(*) filter (where word = got) else 0 end r from w6 group by all)
    select count(*) attempts, share, round(100.0 * count(*) filter (where r = n) / count(*), 9)::double phrases, round(100.0 * sum(r)::double / sum(n)::double, 9) right_words from a6 group by share"""


def _paths() -> str:
    """All paths through the choices of each fragment, word by word; the best of them."""

    def longer(k: int) -> str:
        last = f"p{k - 1}"
        return f"""p{k} as (select {last}.id, {last}.lang, {last}.keys, g, coalesce(c.word, last_) last_, case when len(g) >= {k} then list_prepend(c.j, js) else js end js,
        case when len(g) >= {k} then {last}.score + (c.worth + coalesce({languages.CONTEXT}::double * pt.score, 0.0::double)) else {last}.score end score, case when len(g) >= {k} then reading || ' ' || c.word else reading end reading
        from {last} left join c4 c on c.lang = {last}.lang and c.seq = g[{k}] left join pt on pt.lang = {last}.lang and pt.prev = last_ and pt.word = c.word where len(g) < {k} or c.word is not null)"""

    return f"""ch as (select lang, seq, word, row_number() over (partition by lang, seq order by pos) j, {languages.FREQUENCY} * ((score - 255) * 15.0::double / 254.0::double) worth from lex), c4 as materialized (select * from ch where j <= {languages.ALTERNATIVES}),
fr as (select row_number() over () id, lang, keys, string_split(keys, '0') g from (select distinct lang, keys from at_)),
p1 as (select id, fr.lang, keys, g, c.word last_, [c.j] js, c.worth score, c.word reading from fr join c4 c on c.lang = fr.lang and c.seq = g[1]), {', '.join(longer(k) for k in range(2, accuracy.FRAGMENT + 1))}
select lang, keys, reading, round(score, 9)::double score from (select *, row_number() over (partition by id order by score desc, js) k from p{accuracy.FRAGMENT}) where k = 1"""


# --- queries --------------------------------------------------------------------------------------
def _build(s, d) -> languages.Corpus:
    return languages.build(table(s, d, "documents"), table(s, d, "benchmark"))


def _normalised(s, d):
    t = lines(table(s, d, "documents").withColumn("lang", F.coalesce("lang", F.lit(""))))
    return t.withColumn("line", keypad.normalise_in(F.col("line"), F.col("lang")))


def _sources(s, d):
    c = _build(s, d)
    return languages.exact_readings(c.tokens.where("seq is not null").select("lang", "seq").distinct(), c.lexicons)


def _pair_table(s, d):
    c = _build(s, d)
    return languages.pair_table(languages.pairs(c.lines, c.lexicons), c.counts).drop("score")


def _context(s, d):
    c = _build(s, d)
    asked = accuracy.attempts(c.lines).select("lang", "keys").distinct()
    return context.read_in_context(asked, c.lexicons, languages.pair_table(languages.pairs(c.lines, c.lexicons), c.counts))


def _accuracy(s, d):
    c = _build(s, d)
    return accuracy.summary(accuracy.readings(accuracy.attempts(c.lines), c.lexicons))


def _typed_accuracy(s, d):
    c = _build(s, d)
    return accuracy.summary(accuracy.readings(accuracy.slipped(accuracy.attempts(c.lines)), c.lexicons))


def _failures(s, d):
    c = _build(s, d)
    return accuracy.failures(accuracy.readings(accuracy.slipped(accuracy.attempts(c.lines)), c.lexicons))


def _prior_sweep(s, d):
    c = _build(s, d)
    return accuracy.prior_sweep(accuracy.attempts(c.lines), c.lexicons)


QUERIES = {
    "o08_normalise": (_normalised, f"with {LINES} select doc_id, lang, pos, line from nl"),
    "o08_lexicons": (lambda s, d: _build(s, d).lexicons, f"with {LEX} select lang, word, n, seq, score, pos from lex"),
    "o38_sources": (_sources, f"""with {LEX}, {SOURCES} select q.lang, q.seq, s.source, s.word, s.alternatives, round((score - 255) * 15.0::double / 254.0::double, 9) frequency, round(ln(case when source = q.lang then {languages.ACTIVE} else {languages.OTHER} end::double), 9) prior
        from (select distinct lang, seq from tok where seq is not null) q join src s on s.seq = q.seq"""),
    "o40d_pairs": (_pair_table, f"with {LEX}, {PAIRS} select lang, prev, word, n, pmi, step, hash, row_number() over (partition by lang order by hash, prev, word) - 1 place from pt"),
    "o37_context": (_context, f"with {LEX}, {PAIRS}, {ATTEMPTS}, {_paths()}"),
    "o27_accuracy": (_accuracy, f"with {LEX}, {SOURCES}, {ATTEMPTS}, {_read('at_')}, {SUMMARY}"),
    "o27_typed_accuracy": (_typed_accuracy, f"with {LEX}, {SOURCES}, {ATTEMPTS}, {SLIPPED}, {_read('sl')}, {SUMMARY}"),
    "o28_failures": (_failures, f"with {LEX}, {SOURCES}, {ATTEMPTS}, {SLIPPED}, {_read('sl')}, {FAILURES}"),
    "o83_prior_sweep": (_prior_sweep, f"with {LEX}, {SOURCES}, {ATTEMPTS}, {_sweep()}"),
}


def queries() -> dict:
    return {k: f for k, (f, _) in QUERIES.items()}


def oracle_sql() -> dict:
    return {k: q for k, (_, q) in QUERIES.items() if q}
