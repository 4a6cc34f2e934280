import base64
import gzip
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import Row
from pyspark.sql import functions as F

from keyloom.llm import decontam, html_extract, imatch, jaccard, license, packing, quality, queries, repeats, secrets, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    long = " ".join(word() for _ in range(400))
    out = [" ".join(word() for _ in range(r.randint(3, 120))) for _ in range(40)]
    out += [out[3], out[3], None, "", "x", long, long.replace("a", "b", 2), "z " * 30 + long[50:400], "a" * 500, "a" * 500 + "b", "İ Σ <|endoftext|> \x85 end"]
    out += [" ".join([w if r.random() > 0.01 else "q" for w in long.split()]) for _ in range(5)]
    return docs(spark, out), [t or "" for t in out]


def test_license_automaton():
    a = license.Automaton("a <<opt>>b c<</opt>> d <<var:1-2>> e")
    assert a.match("a d x e".split(), 0) == 4
    assert a.match("a b c d x y e".split(), 0) == 7
    assert a.match("a b d x e".split(), 0) == -1 and a.match("a d e".split(), 0) == -1


def test_license_scan(spark):
    got = license.license_scan(docs(spark, ["Released Under the MIT License. under the mit license", None, "the CC-BY-NC 4.0"])).orderBy("doc_id").collect()
    assert (got[0].n_base, got[0].first_word, got[0].last_word, got[0].base_labels) == (2, 1, 5, "mit")
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].labels, got[1].score) == (0, 0, None, "", 0.0)
    assert got[2].base_labels == "cc-by-nc"


def test_secret_layers():
    plain = "password = abcdefghijkl1"
    inner = base64.b64encode(gzip.compress(plain.encode())).decode()
    outer = base64.b64encode(inner.encode()).decode()
    text = f"see {outer} and token: short"
    n_assign, _, _, _, spans = secrets.scan(text)
    assert n_assign == 0 and f"assign:4:{4 + len(outer)}" in spans
    assert secrets.scan("")[-1] == ""
    assert secrets.masked("a password=abcdefghijkl1 b", secrets.scan("a password=abcdefghijkl1 b")[-1]) == "a [SECRET] b"


def test_secret_layers_are_whole():
    plain = b"password = abcdefghijkl1"
    token = lambda raw: base64.b64encode(raw).decode()
    deep = plain
    for _ in range(12):
        deep = gzip.compress(deep)
    far = gzip.compress(b"a " * (1 << 25) + plain)
    for raw in (deep, gzip.compress(b"first") + gzip.compress(plain), far):
        assert secrets.scan(token(raw))[-1].startswith("assign:0:")
    url = "caf%E9?password%3Dabcdefghijkl1"
    assert secrets.scan(url)[-1] == f"assign:0:{len(url)}"
    assert secrets.masked(url, secrets.scan(url)[-1]) == "[SECRET]"


def test_packing_round_trip(spark, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    df, texts = corpus
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: np.array([*lib.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in enumerate(texts)}
    rows = packing.pack(df.repartition(3), size=128, open_windows=4).collect()
    seen, fill = {}, {}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(part.tobytes()) == r.ids_crc32 and len(ids[r.doc_id]) == r.doc_tokens
        seen.setdefault(r.doc_id, []).append((r.start, r.length))
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in [*fill.values(), *seen.values()]:
        at = 0
        for start, length in sorted(pieces):
            assert start == at
            at += length
    assert all(sum(n for _, n in p) <= 128 for p in fill.values())
    assert {d: sum(n for _, n in p) for d, p in seen.items()} == {d: len(x) for d, x in ids.items()}


def test_sharding(spark, corpus):
    df, texts = corpus
    rows = sharding.shard(df, 4, block_rows=3).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    total = sum(r["size"] for r in rows)
    for k in range(4):
        mine = [r for r in rows if r.shard == k]
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
        assert abs(sum(r["size"] for r in mine) - total / 4) <= max(r["size"] for r in rows)
    assert sharding.shard(df.limit(0)).count() == 0


def test_html():
    page = '<html><body><nav><a href="/x">Menu</a></nav><div class="ad">Buy</div><article><h1>A &amp; B</h1><p>one <b>two\n three<br><p>four five six seven</article><div class="comments">hi</div><footer>f</footer>'
    assert html_extract.extract(page) == "A & B\n\none two three\n\nfour five six seven"
    assert html_extract.extract("") == "" and html_extract.extract("<div>" * 3000 + "x").endswith("x")


def test_html_keeps_every_dense_block():
    r = random.Random(5)
    text = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    ten = [[text(200) for _ in range(10)] for _ in range(2)]
    sections = "".join("<section>" + "".join(f"<p>{p}</p>" for p in s) + "</section>" for s in ten)
    menu = "<ul>" + "".join(f'<li><a href="/{i}">Link {i}</a></li>' for i in range(20)) + "</ul>"
    for page in (f"<body>{menu}<article>{sections}</article>{menu}</body>", f"<body>{menu}<div>{sections}</div>{menu}</body>"):
        assert html_extract.extract(page) == "\n\n".join(ten[0] + ten[1])
    five = [text(300) for _ in range(5)]
    div = "<div>" + "".join(f"<p>{p}</p>" for p in five) + "</div>"
    for tag in ("article", "div"):
        assert html_extract.extract(f"<body>{menu}<{tag}><h1>Headline</h1>{div}</{tag}>{menu}</body>") == "\n\n".join(["Headline", *five])


def test_repeats_by_brute_force(spark, corpus):
    df, texts = corpus
    got = {r.doc_id: r for r in repeats.remove_repeats(df).collect()}
    seen = set()
    for d, t in enumerate(texts):
        b = t.encode()
        gone = [False] * len(b)
        for i in range(len(b) - 99):
            w = b[i : i + 100]
            if w in seen:
                gone[i : i + 100] = [True] * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans, got[d].kept_sha256) == (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()), d


def test_repeats_without_doc_id(spark):
    r = random.Random(3)
    x, y, z = ("".join(r.choice("abcdefgh ") for _ in range(300)) for _ in range(3))
    big = (1 << 53) + 1
    rows = [(None, x), (3, x), (4, x), (None, x), (None, x), (big, y), (None, z), (big + 2, z + y), (None, "s"), (None, "s")]
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], SCHEMA)
    got = sorted(((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans) for r in repeats.remove_repeats(df).collect()))
    assert got == sorted([(0, 300, 0, 0), (3, 300, 300, 1), (4, 300, 300, 1), (0, 300, 300, 1), (0, 300, 300, 1), (big, 300, 0, 0), (0, 300, 0, 0), (big + 2, 600, 600, 1), (0, 1, 0, 0), (0, 1, 0, 0)])


def test_jaccard_by_brute_force(spark, corpus):
    df, texts = corpus
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower() if t.isascii() else "".join(c.lower() if c.isascii() else c for c in t))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    comp = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, task_tokens=300).collect()}
    assert got == {i: (len(s), comp[i]) for i, s in enumerate(sets)}


def test_pipeline_keeps_documents_without_doc_id(spark):
    import corpus_pipeline

    a, b, c = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    rows = [(None, a), (None, a), (None, b), (1, b), (2, c), (3, c), (None, ""), (None, None)]
    df = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], SCHEMA)
    got = corpus_pipeline.distinct(spark, df, "")
    assert got.columns == df.columns
    assert sorted(((r.doc_id or 0, r.text or "") for r in got.collect())) == sorted([(0, a), (1, b), (2, c), (0, ""), (0, "")])


def test_tiling_catches_reordered_passages(spark):
    item = " ".join(f"w{i}" for i in range(40))
    parts = item.split()
    text = "x y " + " ".join(parts[20:]) + " z " + " ".join(parts[:20])
    bench = spark.createDataFrame([(5, item), (6, None)], "item_id long, text string")
    got = decontam.decontaminate(docs(spark, [text, "w1 w2 w3", None]), bench, block_bytes=64).orderBy("doc_id").collect()
    assert (got[0].best_item, got[0].coverage, got[0].contaminated) == (5, 1.0, True)
    assert not got[1].contaminated and not got[2].contaminated


def test_imatch(spark, corpus):
    df, texts = corpus
    rows = {r.doc_id: r for r in imatch.fingerprints(df).collect()}
    for i, t in enumerate(texts):
        k, n = len(t) // 2, texts[(i + 1) % len(texts)]
        assert rows[i].edited_sha256 == hashlib.sha256((t[: len(t) - k] + n[:k]).encode()).hexdigest()
        assert 0 <= rows[i].near_edited <= 1 and 0 <= rows[i].near_next <= 1
    assert rows[3].fingerprint == rows[40].fingerprint == rows[41].fingerprint
    assert rows[40].near_next == 1


@pytest.mark.parametrize("most", [1 << 21, 3])
def test_imatch_by_brute_force(spark, corpus, most):
    df, texts = corpus
    df = df.withColumn("doc_id", F.expr("case when doc_id = 57 then 9223372036854775807 when doc_id = 0 then -9223372036854775808 else doc_id end"))
    words = [{w for w in re.split(r"[^\w]+|_", t.lower()) if w} for t in texts]
    edited = [t[: len(t) - len(t) // 2] + texts[(i + 1) % len(texts)][: len(t) // 2] for i, t in enumerate(texts)]
    changed = [{w for w in re.split(r"[^\w]+|_", t.lower()) if w} for t in edited]
    vocabulary = sorted(set().union(*words, *changed))
    code = {r.w: r.c for r in spark.createDataFrame([(w,) for w in vocabulary], "w string").selectExpr("w", "hash(w) c").collect()}
    df_of = {w: sum(w in d for d in words) for w in vocabulary}
    lex = {code[w] for w in vocabulary if 2 <= df_of[w] <= max(2, 0.1 * len(texts))}
    xx = lambda v, n, seed: xxhash.xxh64(v.to_bytes(n, "little"), seed).intdigest()

    def prints(terms):
        terms = {code[w] for w in terms}
        whole = 42
        for c in sorted(terms):
            whole = xx(c % 2**32, 4, whole)
        out, known = [], sorted(terms & lex)
        for k in range(24):
            hashes = sorted(xx(k, 4, xx(c % 2**32, 4, 42)) >> 1 for c in known)
            subsets = [[h for h in hashes if h < 2**bits] for bits in range(1, 64)]
            part, h = next((p for p in subsets if p), [whole]), 42
            for c in part:
                h = xx(c, 8, h)
            out.append(f"{xx(k, 4, h):016x}")
        return out

    got = {r.edited_sha256 + str(r.n_chars): r for r in imatch.fingerprints(df, most=most).collect()}
    for i, t in enumerate(edited):
        r = got[hashlib.sha256(t.encode()).hexdigest() + str(len(texts[i]))]
        mine, after, following = prints(words[i]), prints(changed[i]), prints(words[(i + 1) % len(texts)])
        if words[i]:
            assert r.fingerprint == "-".join(mine), i
        if words[i] and changed[i]:
            assert r.near_edited == sum(a == b for a, b in zip(mine, after)) / 24
        if words[i] and words[(i + 1) % len(texts)]:
            assert r.near_next == sum(a == b for a, b in zip(mine, following)) / 24


def test_quality_learns(spark):
    r = random.Random(1)
    texts = [" ".join(r.choice(["alpha", "beta", "gamma"]) + ("!!" if i % 4 == 0 else "") for _ in range(30)) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(400)], "doc_id long, quality int")
    rows = quality.quality_scores(docs(spark, texts + [None]), labels).collect()
    held = [x for x in rows if x.held_out and x.doc_id < 400]
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in rows)
    assert sum(x.predicted == (x.doc_id % 4 != 0) for x in held) >= 0.95 * len(held)


@pytest.mark.parametrize("most", [1, 16_384])
def test_repeats_of_hot_passages_by_brute_force(spark, most):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abé\0") for _ in range(r.randint(1, 9)))
    passage = " ".join(word() for _ in range(90))
    texts = [" ".join(word() for _ in range(r.randint(0, 60))) + passage[r.randint(0, 40) : r.randint(150, 400)] + " ".join(word() for _ in range(r.randint(0, 40))) for _ in range(60)]
    got = {x.doc_id: x for x in repeats.remove_repeats(docs(spark, texts).repartition(5), most=most, bucket_entries=50).collect()}
    seen = set()
    for d, t in enumerate(texts):
        b = t.encode()
        gone = [False] * len(b)
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = [True] * 100
            seen.add(b[i : i + 100])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        assert (got[d].n_bytes, got[d].n_removed, got[d].kept_sha256) == (len(b), sum(gone), hashlib.sha256(kept).hexdigest()), d


def test_maximal_repeats_have_all_occurrences(spark):
    r = random.Random(2)
    some = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    shared = some(130)
    texts = [some(50) + shared + some(60) for _ in range(4)]
    rows = repeats.maximal_repeats(docs(spark, texts)).collect()
    whole = {}
    for x in rows:
        assert texts[x.doc_id][x.start : x.start + x.n] == texts[x.first_doc_id][x.first_start : x.first_start + x.n] and x.n >= 100
        whole.setdefault((x.first_doc_id, x.first_start, x.n), set()).add(x.doc_id)
    assert any(len(v) == 4 for v in whole.values())


def test_tokens_are_those_of_the_library():
    import public_tokenizers

    tokens = packing.Tokens(public_tokenizers.path("word_bpe_49k.json"))
    r = random.Random(4)
    chars = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    odd = list(" \n\t\r\x0b\x0c\x1c\x1f\x85\xa0\u2028\u200b\u0300\u0301\u0345\u1100\u1161\u11a8\u03a3\u0130'sS") + ["<|endoftext|>", "<|", "\u208f", "\u209d"]
    texts = ["".join(r.choice(odd if r.random() < 0.5 else chars) for _ in range(r.randint(0, 30))) for _ in range(8000)]
    texts += [f"a{c}b {c}c" for c in chars[:0x10000]]
    for i in range(0, len(texts), 1000):
        for t, got in zip(texts[i : i + 1000], tokens.ids(texts[i : i + 1000])):
            assert got.tolist() == [*tokens.lib.encode(t, add_special_tokens=False).ids, 1], repr(t)


def test_secret_spans_and_encodings():
    plain = "password=abcdefghijkl1"
    quoted = "".join(f"%{ord(c):02X}" for c in plain)
    text = f"x {quoted} y"
    a, b = text.index(quoted), text.index(quoted) + len(quoted)
    assert secrets.scan(text)[-1] == f"assign:{a}:{b}"
    mixed = "say pass%77ord=abcdefghijkl1 ok"
    assert secrets.scan(mixed)[-1] == "assign:4:28"
    inner = base64.b64encode(b"hello there password=abcdefghijkl1 and bye").decode()
    a, b = map(int, secrets.scan(inner)[-1].split(":")[1:])
    assert 0 < a < b < len(inner) and secrets.masked(inner, secrets.scan(inner)[-1]).startswith(inner[:a])
    assert secrets.scan(base64.encodebytes(b"some words first " * 5 + plain.encode()).decode())[-1].startswith("assign:")
    assert secrets.scan(base64.b64encode(b"caf\xe9 " + plain.encode()).decode())[-1].startswith("assign:")
    assert secrets.scan("\\u0070assword=abcdefghijkl1")[-1] == "assign:0:27"


def test_hostile_texts_take_linear_time():
    import time

    start = time.time()
    secrets.scan("ab" * 300_000 + "%zz" + "\\" * 100_000)
    html_extract.extract("<a " * 100_000)
    html_extract.extract("<!" * 100_000)
    assert time.time() - start < 20


def test_license_labels():
    automata = [license.Automaton(t) for _, _, t in license.TEMPLATES]
    label = lambda t: license.scan(t, automata)[5]
    assert label("Creative Commons Attribution 4.0 International") == "cc-by"
    assert label("Creative Commons Attribution-NonCommercial 4.0 International License") == "cc-by-nc"
    assert label("Creative Commons Attribution-ShareAlike 4.0 International") == "cc-by-sa"
    assert label("under the terms of the GNU Lesser General Public License") == "lgpl"
    assert label("This is licensed under the Apache License, Version 2.0") == "apache-2"
    assert license.scan("under the MIT license", automata)[6] == 0.7


def test_html_attributes():
    body = "<p>" + "some words of an article " * 8 + "</p>"
    for tag in ('<body style="overflow:hidden"><div>', '<body><article title="hidden gems">', '<body><div data-id="ad">', '<body><div class="share-price">', '<body><div class="widget">'):
        assert html_extract.extract(f"<html>{tag}{body}").startswith("some words"), tag
    assert html_extract.extract(f'<body><div>{body}</div><div class="ad-box">buy this now</div></body>') == " ".join(["some words of an article"] * 8)


CLASH = "doc_id long, text string, lang string, source string, n_chars long, n long, x long, bucket int, id long, row string, h long, block int, uid long"


def odd_rows(spark):
    """Null, large and repeated ids beside each other, null, empty, repeated and long texts, clashing names."""
    big = (1 << 60) + 1
    long_ = " ".join(f"w{i}" for i in range(30_000))
    rows = [(None, "a b c d e f"), (big, "a b c d e f"), (big, "a b c d e f"), (7, None), (8, ""), (big + 2, long_), (None, long_ + " end"), (None, None)]
    return spark.createDataFrame([(d, t, None, None, None, 1, 2, 3, 4, "r", 5, 6, 7) for d, t in rows], CLASH), rows


def every_operator(spark):
    bench = spark.createDataFrame([(1, "one two three four five six"), (None, None)], "item_id long, text string")
    labels = spark.createDataFrame([(7, 1), (8, 0), (None, None)], "doc_id long, quality int")
    return {
        "license": license.license_scan, "packing": packing.pack, "sharding": sharding.shard, "repeats": repeats.remove_repeats,
        "jaccard": jaccard.jaccard_components, "secrets": secrets.secret_scan, "imatch": imatch.fingerprints,
        "decontam": lambda d: decontam.decontaminate(d, bench), "blocks": lambda d: decontam.decontaminate(d, bench, block_bytes=8),
        "quality": lambda d: quality.quality_scores(d, labels), "kept": jaccard.kept, "clean": lambda d: decontam.clean(d, bench),
    }


def test_odd_rows_and_empty_tables(spark):
    df, rows = odd_rows(spark)
    ids = sorted(d or 0 for d, _ in rows)
    for name, apply in every_operator(spark).items():
        got = apply(df.coalesce(1)).collect()
        seen = sorted(r.doc_id or 0 for r in got)
        if name == "packing":
            assert set(seen) == set(ids)
        elif name == "kept":
            big = (1 << 60) + 1
            assert seen == sorted([big, 7, 8, big + 2, 0]), seen
        else:
            assert seen == ids, name
        assert apply(df.limit(0)).count() == 0, name
    pages = spark.createDataFrame([(None, None, None), ((1 << 60) + 1, "u", "<p>one two")], "page_id long, url string, html string")
    assert sorted((r.page_id or 0, r.text) for r in html_extract.main_text(pages.coalesce(1)).collect()) == [(0, ""), ((1 << 60) + 1, "one two")]
    assert html_extract.main_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_gives_the_same_rows(spark, tmp_path, name):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [None, "", "a b", "A  b", passage, "x " + passage, passage[:-4], "é" * 99, "é" * 120, f"under the MIT license; {passage} CC-BY-NC apache license version 2", "password = 'abcdefghijkl1' AKIA" + "Q" * 20 + " deadbeefdeadbeef0 token: short"]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    for table in ("items", "sale_lines", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").write.parquet(f"{tmp_path}/{table}.parquet")
    got = queries.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    for table in ("documents", "items", "sale_lines", "labels"):
        con.sql(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    assert sorted(map(str, got.select(*names).toLocalIterator())) == sorted(str(Row(**dict(zip(names, r)))) for r in want.select(*names).fetchall())
