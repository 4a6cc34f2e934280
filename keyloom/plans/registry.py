"""Queries by operator id, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.functions import keypad
from keyloom.operators import accuracy, corpus, decode, evaluate, languages, lexicon, presses
from keyloom.sources.kept import kept
from keyloom.sources.tables import lines, table
from keyloom.streaming import words

DAY = 86_400_000
CAPACITY, BUDGET = 4_000, 40 * 1024 * 1024  # fixed values

# --- SQL building blocks -------------------------------------------------------------------------
A, B = "abcdefghijklmnopqrstuvwxyząćęłńóśźż", "22233344455566677778889999" + "223566799"
NORM = r"""regexp_replace(trim(regexp_replace(regexp_replace(lower(replace(translate({0}, ' ‘’“”–—', ' ''''""--'), '…', '...')), '[^a-z0-9.,''&:/ -]', ' ', 'g'), ' +', ' ', 'g')), '^(?:- *)+', '')"""
SEQ = f"case when regexp_full_match(lower({{0}}), '[{A}]*') then translate(lower({{0}}), '{A}', '{B}') end"
LINES = "lines as (select doc_id, lang, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) - 1 pos from documents)"
NORMED = f"normed as (select doc_id, lang, pos, {NORM.format('line')} line from lines)"
TOKENS = f"""raw as (select doc_id, lang, pos, list_filter(string_split(line, ' '), lambda w: w <> '') ws from normed),
parts as (select doc_id, lang, pos, unnest(ws) word, generate_subscripts(ws, 1) - 1 i from raw),
tokens as (select *, {SEQ.format('word')} seq from parts)"""
BASE = f"with {LINES}, {NORMED}, {TOKENS}"
COUNTS = f"""{BASE}, tlines as (select unnest(string_split(text, chr(10))) line from benchmark),
ttok as (select unnest(list_filter(string_split({NORM.format('line')}, ' '), lambda w: w <> '')) word from tlines),
counts as (select lang, word, cast(sum(weight) as bigint) n from (select lang, word, 1 weight from tokens where seq is not null union all select 'en', word, 20 from ttok where {SEQ.format('word')} is not null) group by all)"""
LEX = f"""{COUNTS}, en as (select word, n from counts where lang = 'en'), top as (select word, n, {SEQ.format('word')} seq from en order by n desc, word limit {corpus.VOCABULARY}),
lex as (select word, n, seq, cast(least(255, greatest(1, 1 + trunc(254 * ln(1 + n) / ln(1 + max(n) over ())))) as int) score, cast(row_number() over (order by seq, n desc, word) - 1 as int) pos from top)"""
ASKED = f"""asked_words as (select distinct word from (select unnest(list_filter(string_split({NORM.format("replace(text, chr(10), ' ')")}, ' '), lambda w: w <> '')) word from conversations where role = 'user')),
asked as (select distinct seq query from (select {SEQ.format('word')} seq from asked_words) where seq is not null and seq <> '')"""
FOUND = """hits as (select query, word, score, pos, query = seq exact from asked join lex on starts_with(seq, query)),
nth as (select *, row_number() over (partition by query, exact order by pos) k from hits),
ranked as (select *, cast(row_number() over (partition by query order by exact desc, case when exact then pos end, score desc, pos) as int) rank from nth where exact or k <= 4096),
found as (select query, rank, word, score, exact from ranked where rank <= 8)"""
PAIRS = """known as (select t.doc_id, t.pos, t.i, t.word, l.word is not null known from tokens t left join lex l on t.word = l.word),
lagged as (select word, known, lag(word) over w prev, lag(known) over w before from known window w as (partition by doc_id, pos order by i)),
pairs as (select prev, word, count(*) n from lagged where known and before group by all)"""
PRESSES = "presses as (select user_id, event_id, epoch_us(ts) // 1000 ms, cast(2 + event_id % 8 as varchar) digit from events)"
FNV = "list_reduce(list_prepend(14695981039346656037::uhugeint, list_transform(list_filter(string_split(prev || ' ' || word, ''), lambda c: c <> ''), lambda c: unicode(c)::uhugeint)), lambda h, c: (xor(h, c) * 1099511628211::uhugeint) % 18446744073709551616::uhugeint)"
FRAGMENTS = "k as (select *, row_number() over (partition by doc_id, pos order by i) - 1 k from tokens where seq is not null), fr as (select doc_id, pos, k // 4 part, string_agg(seq, '0' order by k) keys from k group by all), ask as (select distinct keys from fr)"
READABLE = "not coalesce(list_contains(list_transform(range(3, length(word) + 1), lambda i: word[i:i] = word[i-1:i-1] and word[i:i] = word[i-2:i-2]), true), false) and len(list_filter(range(2, length(word) + 1), lambda i: word[i:i] = word[i-1:i-1])) < 3 and regexp_matches(word, '[aąeęioóuy]')"
SPELL = "map {" + ", ".join(f"'{c}': {n}" for k in keypad.KEYS.values() for n, c in enumerate(k, 1)) + "}"
KEYMAP = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in keypad.KEYS.items()) + "}"


def _en(s, d):
    counts = corpus.word_count(table(s, d, "documents"), table(s, d, "benchmark"))
    return counts.where("lang = 'en'").select("word", "n")


def _lex(s, d):
    return corpus.lexicon(_en(s, d))


def _asked_words(s, d):
    c = table(s, d, "conversations").where("role = 'user'")
    words = F.split(keypad.normalise(F.regexp_replace("text", "\n", " ")), " ")
    return c.select(F.explode(words).alias("word")).where("word <> ''").distinct()


def _asked(s, d):
    return _asked_words(s, d).select(keypad.sequence_of(F.col("word")).alias("query")).where("query is not null and query <> ''").distinct()


def _docs(s, d):
    return table(s, d, "documents")


def _words(s, d):
    return corpus.tokens(_docs(s, d)).select("word", "seq").distinct()


def _typed(s, d):
    """Typing records, one of every O-14 fragment, pressed as accuracy.slipped has it. The id names its place."""
    t = corpus.fragments(_docs(s, d)).withColumn("source", F.coalesce("lang", F.lit("")))
    rows = t.select("doc_id", "pos", "part", "source", keypad.pressed(F.array_join("words", " ")).alias("keys")).withColumn("wanted", F.col("keys"))
    return accuracy.slipped(rows).select(F.concat("doc_id", F.lit("/"), "pos", F.lit("/"), "part").alias("id"), "source", "wanted", F.col("keys").alias("typed"))


def _budget(s, d, budget=BUDGET, block=1000):
    """Lines of each language, in order, while the characters before them stay below the budget."""
    from pyspark.sql import Window

    t = corpus.normalised(_docs(s, d)).where("length(line) >= 2").withColumn("size", F.length("line") + 1).withColumn("block", F.expr(f"doc_id div {block}"))
    sums = t.groupBy("lang", "block").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("lang").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("lang", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")).where(F.col("base") < budget)
    inner = Window.partitionBy("lang", "block").orderBy("doc_id", "pos").rowsBetween(Window.unboundedPreceding, -1)
    t = t.join(sums, ["lang", "block"]).withColumn("used", F.col("base") + F.coalesce(F.sum("size").over(inner), F.lit(0)))
    return t.where(F.col("used") < budget).select("doc_id", "pos", "lang", "line", "used")


def _fragments(s, d, n=4):
    return corpus.fragments(_docs(s, d), n).select("doc_id", "pos", "part", F.array_join("words", " ").alias("fragment"))


def _spoken(s, d):
    c = table(s, d, "conversations")
    t = c.select(F.col("conv_id").alias("user_id"), "turn", F.posexplode(F.split(keypad.normalise(F.regexp_replace("text", "\n", " ")), " ")).alias("i", "word"))
    return t.where("word <> ''").where(keypad.sequence_of(F.col("word")).isNotNull()).select("user_id", (F.col("turn") * 1_000_000 + F.col("i")).alias("at"), "word")


def _asked_phrases(s, d, n=4):
    """Keys of every n words of every user's turn, the last group shorter."""
    c = table(s, d, "conversations").where("role = 'user'")
    said = F.filter(F.split(keypad.normalise(F.regexp_replace("text", "\n", " ")), " "), lambda w: keypad.sequence_of(w).isNotNull() & (w != ""))
    c = c.select(said.alias("said")).where("size(said) > 0").select("said", F.explode(F.expr(f"sequence(1, size(said), {n})")).alias("at"))
    return c.select(keypad.phrase_sequence(F.array_join(F.slice("said", F.col("at"), n), " ")).alias("keys")).distinct()


def _decoded(s, d, limit=4):
    """All words of every user's turn, decoded; the phrases are dealt out evenly to the tasks, those that begin alike together."""
    asked = _asked_phrases(s, d).repartitionByRange(s.sparkContext.defaultParallelism * 4, "keys").sortWithinPartitions("keys")
    return decode.decode(asked, {"en": (1.0, _lex(s, d))}, limit)


def _pairs(s, d):
    """English pairs and counts; the words of each line and the counts are written once, for all that reads them."""
    rows = kept(corpus.worded(_docs(s, d)), "lines")
    counts = kept(corpus.counted(corpus.tokens_of(rows), table(s, d, "benchmark")).where("lang = 'en'").select("word", "n"), "counts")
    return languages.adjacent(rows, corpus.lexicon(counts).select("word")), counts


def _pmi(s, d):
    return corpus.pmi(*_pairs(s, d))


def _balance(s, d):
    keys = corpus.tokens(_docs(s, d)).where("seq is not null").select(F.explode(F.split("seq", "")).alias("key")).where("key <> ''")
    return keys.groupBy("key").agg(F.count("*").alias("n"))


QUERIES = {
    "o01_lines": (lambda s, d: lines(_docs(s, d)), f"with {LINES} select doc_id, lang, pos, line from lines"),
    "o02_budget": (_budget, f"""with {LINES}, {NORMED}, sized as (select *, cast(coalesce(sum(length(line) + 1) over (partition by lang order by doc_id, pos rows between unbounded preceding and 1 preceding), 0) as bigint) used from normed where length(line) >= 2)
        select doc_id, pos, lang, line, used from sized where used < {BUDGET}"""),
    "o07_normalise": (lambda s, d: corpus.normalised(_docs(s, d)), f"with {LINES}, {NORMED} select doc_id, lang, pos, line from normed"),
    "o09_sequences": (_words, f"{BASE} select distinct word, seq from tokens"),
    "o10_phrase_sequence": (lambda s, d: corpus.normalised(_docs(s, d)).select("doc_id", "pos", keypad.phrase_sequence(F.col("line")).alias("keys")).where("keys is not null"),
        f"with {LINES}, {NORMED} select doc_id, pos, translate(lower(line), '{A} ', '{B}0') keys from normed where regexp_full_match(lower(line), '[{A} ]*')"),
    "o20_pair_selection": (lambda s, d: _pairs(s, d)[0].where("n >= 3").orderBy(F.desc("n"), "prev", "word").limit(corpus.PAIR_KEEP),
        f"{LEX}, {PAIRS} select prev, word, n from pairs where n >= 3 order by n desc, prev, word limit {corpus.PAIR_KEEP}"),
    "o63_word_delete": (lambda s, d: corpus.normalised(_docs(s, d)).select("doc_id", "pos", F.regexp_replace("line", r"\S+\s*$", "").alias("left")),
        rf"with {LINES}, {NORMED} select doc_id, pos, regexp_replace(line, '\S+\s*$', '') as left from normed".replace("as left", 'as "left"')),
    "o12_pack": (lambda s, d: _words(s, d).where("seq is not null").select("word", keypad.packed(F.col("seq")).alias("packed")),
        f"{BASE} select distinct word, cast(('0x' || rpad(translate(seq[1:15], '23456789', '12345678'), 15, '0')) as bigint) packed from tokens where seq is not null"),
    "o13_case": (lambda s, d: _words(s, d).select("word", keypad.once(F.col("word")).alias("once"), F.upper("word").alias("locked")),
        f"{BASE} select distinct word, upper(word[1:1]) || word[2:] once, upper(word) locked from tokens"),
    "o14_fragments": (_fragments, f"{BASE}, k as (select *, row_number() over (partition by doc_id, pos order by i) - 1 k from tokens where seq is not null) select doc_id, pos, cast(k // 4 as int) part, string_agg(word, ' ' order by k) fragment from k group by all"),
    "o15_readable": (lambda s, d: _words(s, d).where(keypad.readable(F.col("word"))).select("word"), f"{BASE} select distinct word from tokens where {READABLE}"),
    "o15b_repeats": (lambda s, d: _words(s, d).where("seq is not null").select("word", keypad.repeats_in(F.col("seq")).alias("repeats")),
        f"{BASE} select distinct word, cast(len(list_filter(range(2, length(seq) + 1), lambda i: seq[i:i] = seq[i - 1:i - 1])) as int) repeats from tokens where seq is not null"),
    "o16_word_count": (lambda s, d: corpus.word_count(_docs(s, d), table(s, d, "benchmark")), f"{COUNTS} select lang, word, n from counts"),
    "o17_pairs": (lambda s, d: _pairs(s, d)[0], f"{LEX}, {PAIRS} select prev, word, n from pairs"),
    "o18_ambiguity": (lambda s, d: corpus.ambiguity(_en(s, d)), f"""{COUNTS}, by_seq as (select {SEQ.format('word')} seq, count(*) words, sum(n) n, max(n) first from counts where lang = 'en' group by 1)
        select count(*) sequences, cast(sum(case when words > 1 then words else 0 end) as bigint) sharing, round(100.0 * sum(first)::double / sum(n)::double, 9) first_choice from by_seq"""),
    "o19_pmi": (_pmi, f"""{LEX}, {PAIRS}, total as (select sum(n)::double t from en), chosen as (select * from pairs where n >= 3 order by n desc, prev, word limit {corpus.PAIR_KEEP})
        select c.prev, c.word, c.n, round(least(8.0, greatest(-2.0, ln((c.n / t) / ((a.n / t) * (b.n / t))))), 9)::double pmi from chosen c join en a on a.word = c.prev join en b on b.word = c.word, total"""),
    "o30b_key_balance": (_balance, f"{BASE}, keys as (select unnest(string_split(seq, '')) key from tokens where seq is not null) select key, count(*) n from keys where key <> '' group by key"),
    "o31_candidates": (lambda s, d: lexicon.candidates(_asked(s, d), _lex(s, d)), f"{LEX}, {ASKED}, {FOUND} select query, rank, word, score, exact from found"),
    "o32_contains": (lambda s, d: lexicon.contains(_asked_words(s, d), _lex(s, d)), f"{LEX}, {ASKED} select word from asked_words where word in (select word from lex)"),
    "o33_has_prefix": (lambda s, d: lexicon.has_prefix(_asked(s, d), _lex(s, d)), f"{LEX}, {ASKED}, p as (select distinct unnest(list_transform(range(1, least(length(seq), 15) + 1), lambda k: seq[1:k])) p from lex) select query, query[1:15] in (select p from p) live from asked"),
    "o38_first_words": (lambda s, d: lexicon.first_words(_lex(s, d)), f"{LEX} select seq, arg_min(word, pos) word, arg_min(score, pos) score from lex group by seq"),
    "o40_lexicon": (_lex, f"{LEX} select word, n, seq, score, pos from lex"),
    "o40c_front_coding": (lambda s, d: corpus.front_coded(_lex(s, d)), f"""{LEX}, p as (select pos, word, coalesce(lag(word) over (partition by pos // 32 order by pos), '') p from lex)
        select pos, word, cast(coalesce(list_max(list_filter(range(1, 33), lambda k: k <= length(word) and k <= length(p) and word[1:k] = p[1:k])), 0) as int) shared from p"""),
    "o40d_pair_hash": (lambda s, d: _pairs(s, d)[0].where("n >= 3").select("prev", "word", corpus.fnv(F.concat_ws(" ", "prev", "word")).alias("hash")), f"{LEX}, {PAIRS}, h as (select prev, word, {FNV} u from pairs where n >= 3) select prev, word, cast(case when u >= 9223372036854775808 then u::hugeint - 18446744073709551616 else u::hugeint end as bigint) hash from h"),
    "o30_user_words": (lambda s, d: lexicon.user_words(_spoken(s, d)), f"""with w as (select conv_id user_id, unnest(list_filter(string_split({NORM.format("replace(text, chr(10), ' ')")}, ' '), lambda w: w <> '')) word from conversations)
        select user_id, word, least(count(*), 1000) uses from w where {SEQ.format('word')} is not null group by all"""),
    # In SQL for stores that stay within their capacity.
    "o58_learn": (lambda s, d: words.folded(_spoken(s, d), CAPACITY), f"""with w as (select conv_id user_id, unnest(list_filter(string_split({NORM.format("replace(text, chr(10), ' ')")}, ' '), lambda w: w <> '')) word from conversations)
        select user_id, lower(word) word, cast(least(count(*), 1000) as int) uses from w where {SEQ.format('word')} is not null group by all"""),
    "o42_decode": (lambda s, d: _decoded(s, d).select("keys", "rank", "reading", "score", "mixed"), None),
    "o42_words": (lambda s, d: _decoded(s, d, 1).select("keys", F.posexplode("words").alias("i", "w")).select("keys", "i", "w.word", "w.language", "w.begin", "w.end", F.array_join("w.alternatives", " ").alias("alternatives")), None),
    "o46_exact_reading": (lambda s, d: lexicon.exact_reading(_typed(s, d).select(F.col("wanted").alias("keys")).distinct(), _lex(s, d)), f"""{LEX}, {FRAGMENTS}, best as (select seq, arg_min(word, pos) word from lex group by seq), g as (select keys, unnest(list_filter(string_split(keys, '0'), lambda x: x <> '')) seq, generate_subscripts(list_filter(string_split(keys, '0'), lambda x: x <> ''), 1) i from ask)
        select keys, case when count(best.word) = count(*) then string_agg(best.word, ' ' order by i) end reading from g left join best on g.seq = best.seq group by keys"""),
    "o50_multitap": (lambda s, d: presses.multitap(presses.presses(table(s, d, "events")), 30 * DAY), f"""with {PRESSES}, f as (select *, case when digit = lag(digit) over w and ms - lag(ms) over w <= {30 * DAY} then 0 else 1 end new from presses window w as (partition by user_id order by ms, event_id)),
        r as (select *, cast(sum(new) over (partition by user_id order by ms, event_id) as bigint) run from f), g as (select user_id, run, min(digit) digit, count(*) n from r group by user_id, run)
        select user_id, run, digit, n, substr({KEYMAP}[digit], cast((n - 1) % length({KEYMAP}[digit]) + 1 as int), 1) letter from g"""),
    "o57_debounce": (lambda s, d: presses.debounced(presses.presses(table(s, d, "events")), DAY // 4), f"""with {PRESSES}, f as (select *, case when ms - lag(ms) over (partition by user_id order by ms, event_id) < {DAY // 4} then 0 else 1 end new from presses),
        r as (select *, cast(sum(new) over (partition by user_id order by ms, event_id) as bigint) g from f) select user_id, g, count(*) n, max(ms) last_ms from r group by all"""),
    "o62_turn_over": (lambda s, d: presses.presses(table(s, d, "events")).select("event_id", keypad.turned_over(F.col("digit")).alias("digit")), f"with {PRESSES} select event_id, translate(digit, '123789', '789123') digit from presses"),
    "o80_word_cost": (lambda s, d: evaluate.word_cost(_asked_words(s, d), _lex(s, d)), f"""{LEX}, {ASKED}, exact_ as (select * from (select word, row_number() over (partition by seq order by pos) rank from lex) where rank <= 8)
        select w.word, cast(case when r.rank is not null then length({SEQ.format('w.word')}) + r.rank - 1 else 1 + coalesce(list_sum(list_transform(string_split(w.word, ''), lambda c: coalesce(({SPELL})[c], 1))), 0) end as bigint) presses, r.rank is null spelt from asked_words w left join exact_ r on w.word = r.word"""),
}


def queries() -> dict:
    from . import more, reports, streams, typing

    return {k: f for k, (f, _) in QUERIES.items()} | more.queries() | reports.queries() | streams.queries() | typing.queries()


def oracle_sql() -> dict:
    from . import more, reports, streams, typing

    return {k: q for k, (_, q) in QUERIES.items() if q} | more.oracle_sql() | reports.oracle_sql() | streams.oracle_sql() | typing.oracle_sql()
