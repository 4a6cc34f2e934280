"""SQL of the operators whose rows, or whose base columns, SQL can express; for small tables."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

# --- op1: places of the base phrases ----------------------------------------------------------------
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}  # fixed values
HITS = " union all ".join(
    f"select doc_id, '{label}' label, i from w, lateral (select unnest(range(1, len(ws) + 1)) i) where "
    + " and ".join(f"ws[i + {k}] = '{word}'" for k, word in enumerate(phrase.split()))
    for label, phrase in PHRASES.items()
)
LICENSES = rf"""with w as (select doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from documents), hits as ({HITS})
select w.doc_id, cast(len(any_value(w.ws)) as bigint) n_words, count(h.i) n_base, cast(min(h.i) - 1 as bigint) first_word, cast(max(h.i) - 1 as bigint) last_word,
    coalesce(string_agg(distinct h.label, ',' order by h.label), '') base_labels
from w left join hits h on w.doc_id = h.doc_id group by w.doc_id"""

# --- op5: bytes covered by a string of 100 bytes that starts earlier too -----------------------------
REPEATS = """with d as (select doc_id, hex(encode(coalesce(text, ''))) h from documents),
win as (select doc_id, i, substr(h, 2 * i + 1, 200) s from d, lateral (select unnest(range(0, length(h) // 2 - 99)) i)),
firsts as (select s, min((doc_id, i)) f from win group by s),
again as (select win.doc_id, i from win join firsts on win.s = firsts.s where (win.doc_id, i) > f),
steps as (select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= 100 then 0 else 1 end new from again),
marked as (select doc_id, i, sum(new) over (partition by doc_id order by i) run from steps),
runs as (select doc_id, min(i) a, max(i) + 100 z from marked group by doc_id, run),
pieces as (select doc_id, a, coalesce(lag(z) over (partition by doc_id order by a), 0) b, a e, z - a n from runs
    union all select d.doc_id, length(any_value(h)) // 2 + 1, coalesce(max(z), 0), length(any_value(h)) // 2, 0 from d left join runs on d.doc_id = runs.doc_id group by d.doc_id)
select d.doc_id, cast(length(any_value(h)) // 2 as bigint) n_bytes, cast(sum(n) as bigint) n_removed, count(*) - 1 n_spans,
    sha256(unhex(string_agg(substr(h, 2 * b + 1, 2 * (e - b)), '' order by a))) kept_sha256
from d join pieces p on d.doc_id = p.doc_id group by d.doc_id"""

# --- op6: sets of five words, links at 0.8, components by a recursive union --------------------------
COMPONENTS = rf"""with recursive w as (select doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') ws from documents),
sh as (select distinct doc_id, s from (select doc_id, unnest(case when len(ws) >= 5 then list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) s from w)),
n as (select doc_id, count(*) n from sh group by doc_id),
shared as (select a.doc_id a, b.doc_id b, count(*) c from sh a join sh b on a.s = b.s and a.doc_id <> b.doc_id group by all),
links as (select a, b from shared join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 80 * (na.n + nb.n - c)),
reach as (select doc_id, doc_id r from w union select doc_id, b from reach join links on r = a)
select reach.doc_id, coalesce(any_value(n.n), 0) n_shingles, min(r) component_id from reach left join n on reach.doc_id = n.doc_id group by reach.doc_id"""

# --- op7: spans of the base patterns ----------------------------------------------------------------
KINDS = [
    ("assign", r"""(?i:(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?)[A-Za-z0-9+/_.=-]+""", r"""(?i:(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?)([A-Za-z0-9+/_.=-]+)""", 12),
    ("access", r"AKIA[A-Z0-9]+", r"(AKIA[A-Z0-9]+)", 18),
    ("hex", r"[0-9a-f]+", r"([0-9a-f]+)", 16),
]


def _kind(order: int, kind: str, whole: str, part: str, least: int) -> str:
    """All matches m of a kind in order; the text between them gives their places."""
    return f"""select doc_id, {order} k, '{kind}' kind, a, a + length(m) z, length(g) >= {least} kept from (select doc_id, m, g,
        sum(length(gap)) over w + coalesce(sum(length(m)) over (partition by doc_id order by j rows between unbounded preceding and 1 preceding), 0) a from
        (select doc_id, unnest(regexp_extract_all(t, '{whole}')) m, unnest(regexp_extract_all(t, '{part}', 1)) g, unnest(regexp_split_to_array(t, '{whole}')[:len(regexp_extract_all(t, '{whole}'))]) gap,
            unnest(range(1, len(regexp_extract_all(t, '{whole}')) + 1)) j from t) window w as (partition by doc_id order by j))"""


SECRETS = f"""with t as (select doc_id, coalesce(text, '') t from documents),
found as ({' union all '.join(_kind(i, *k) for i, k in enumerate(KINDS))}), kept as (select * from found where kept)
select t.doc_id, count(*) filter (where kind = 'assign') n_assign, count(*) filter (where kind = 'access') n_access, count(*) filter (where kind = 'hex') n_hex,
    sha256(coalesce(string_agg(kind || ':' || cast(a as bigint) || ':' || cast(z as bigint), ',' order by a, k), '')) base_sha256
from t left join kept on t.doc_id = kept.doc_id group by t.doc_id"""

# --- op12: all pairs of a band, in a range join; the checksum bit by bit ------------------------------
CRC32 = """cast(xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split({0}, ''), lambda c: unicode(c)::ubigint)), lambda h, c:
    list_reduce(list_prepend(xor(h, c), [1::ubigint, 2, 3, 4, 5, 6, 7, 8]), lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384::ubigint) else x >> 1 end)), 4294967295::ubigint) as bigint)"""
BANDS = f"""with a as (select sale_id, cast(line_no as bigint) line_no, item_id line_item_id, cast(quantity as bigint) q, cast(floor(100 * amount + 0.5) as bigint) a from sale_lines
    where sale_id is not null and item_id is not null and quantity is not null and amount is not null and quantity <> 0),
l as (select *, {CRC32.format("sale_id || ',' || coalesce(cast(line_no as varchar), '') || ',' || line_item_id")} crc, ((2 * a + q) * sign(q) - ((2 * a + q) * sign(q) % (2 * abs(q)) + 2 * abs(q)) % (2 * abs(q))) // (2 * abs(q)) u from a),
i as (select row_number() over () k, item_id, cast(floor(100 * price + 0.5) as bigint) p from items),
pairs as (select k, abs(u - p) gap, u, sale_id, line_no, line_item_id, crc from i join l on u between p - greatest(10, p // 500) and p + greatest(10, p // 500) where (abs(u - p) <= 10 or 1000 * abs(u - p) <= 2 * p) and i.item_id is distinct from l.line_item_id),
sums as (select k, count(*) n_pairs, sum(gap) gap_sum, sum(crc) lines_crc from pairs group by k),
heads as (select * from (select *, row_number() over (partition by k order by gap, u, sale_id, line_no nulls first, line_item_id) rank from pairs) where rank <= 5)
select item_id, cast(coalesce(rank, 0) as int) rank, cast(gap as bigint) gap, cast(u as bigint) u, sale_id, line_no, line_item_id,
    cast(coalesce(n_pairs, 0) as bigint) n_pairs, cast(coalesce(gap_sum, 0) as bigint) gap_sum, cast(coalesce(lines_crc, 0) as bigint) lines_crc
from i left join sums using (k) left join heads using (k)"""

# --- op13: the filters of each order one after the other, with what was removed before ----------------
AUDIT = r"""with t as (select doc_id, coalesce(lang, '') part, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from documents),
firsts as (select t, min(doc_id) least from t group by t),
lab as (select doc_id, max(cast(quality = 1 as int)) good, max(cast(toxic = 1 as int)) toxic from labels group by doc_id),
f as (select part, coalesce(good, 0) good, coalesce(toxic, 0) toxic, len(ws) < 100 "A", 100 * len(list_distinct(ws)) < 80 * len(ws) "B", 100 * length(regexp_replace(t.t, '[^A-Z]', '', 'g')) > 10 * length(t.t) "C",
    regexp_matches(t.t, '[#$%&*|]') "D", coalesce(t.doc_id > least, false) "E" from t join firsts using (t) left join lab on lab.doc_id = t.doc_id),
pat as (select part, good, toxic, list_concat(case when "A" then ['A'] else [] end, case when "B" then ['B'] else [] end, case when "C" then ['C'] else [] end, case when "D" then ['D'] else [] end, case when "E" then ['E'] else [] end) fails, count(*) n from f group by all),
l as (select unnest(['A', 'B', 'C', 'D', 'E']) x),
orders as (select a.x || b.x || c.x || d.x || e.x filter_order from l a, l b, l c, l d, l e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s as (select filter_order, unnest(range(1, 6)) step from orders),
r as (select part, filter_order, step, filter_order[step:step] x, n, good, toxic, list_contains(fails, filter_order[step:step]) hit, len(fails) n_fails, len(list_filter(fails, lambda y: strpos(filter_order, y) < step)) > 0 gone from pat, s),
sums as (select part, filter_order, step, x, cast(sum(case when not gone and not hit then n else 0 end) as bigint) kept, cast(sum(case when not gone and hit then n else 0 end) as bigint) removed, cast(sum(case when gone and hit then n else 0 end) as bigint) redundant,
    cast(sum(case when hit and n_fails = 1 then n else 0 end) as bigint) unique_fails, cast(sum(case when not gone and hit then n * good else 0 end) as bigint) good_lost, cast(sum(case when not gone and hit then n * toxic else 0 end) as bigint) toxic_lost from r group by all)
select part, filter_order, cast(step as int) step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, cast(sum(removed) over (partition by part, x) as bigint) shapley from sums"""

# --- op11: windows of words and lines as they are -----------------------------------------------------
COVERAGE = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}  # fixed values: percent of characters by n-gram length
RULES = rf"""with w as (select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from documents),
ns as (select w.doc_id, w.ws, n from w, (select unnest({list(COVERAGE)}) n)),
win as (select doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') g from ns, lateral (select unnest(range(1, len(ws) - n + 2)) i)),
rep as (select doc_id, n, i from (select doc_id, n, i, count(*) over (partition by doc_id, n, g) c from win) where c > 1),
cov as (select distinct doc_id, n, j from rep, lateral (select unnest(range(i, i + n)) j)),
per as (select cov.doc_id, n, count(*) words, sum(length(ws[j])) chars from cov join w on cov.doc_id = w.doc_id group by all),
ln as (select doc_id, unnest(string_split(t, chr(10))) line, generate_subscripts(string_split(t, chr(10)), 1) k from w),
lk as (select doc_id, line, row_number() over (partition by doc_id, line order by k) nth from ln where regexp_matches(line, '[^\x20\x09-\x0D]')),
ls as (select doc_id, sum(length(line)) line_chars, count(*) filter (where nth > 1) n_dup_lines, coalesce(sum(length(line)) filter (where nth > 1), 0) dup_line_chars from lk group by doc_id),
m as (select w.doc_id, cast(len(ws) as bigint) n_words, cast(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) as bigint) word_chars, cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) n_symbols,
    cast(coalesce(n_dup_lines, 0) as bigint) n_dup_lines, cast(coalesce(any_value(per.words) filter (where n = 5), 0) as bigint) n_repeat_words, cast(coalesce(line_chars, 0) as bigint) line_chars, cast(coalesce(dup_line_chars, 0) as bigint) dup_line_chars,
    {', '.join(f"cast(coalesce(any_value(per.chars) filter (where n = {n}), 0) as bigint) dup_chars_{n}" for n in COVERAGE)}
    from w left join ls on w.doc_id = ls.doc_id left join per on w.doc_id = per.doc_id group by w.doc_id, ws, t, n_dup_lines, line_chars, dup_line_chars)
select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed, not (n_words < 10 or 100 * n_repeat_words > 20 * n_words or 100 * dup_line_chars > 20 * line_chars
    or {' or '.join(f"100 * dup_chars_{n} > {most} * word_chars" for n, most in COVERAGE.items())}) kept from m"""
