import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from keyloom.functions import keypad
from keyloom.operators import align, corpus, decode, lexicon, presses, users
from keyloom.plans import registry


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def test_sequences(spark):
    assert one(spark, keypad.sequence_of(F.lit("Wiedźmin"))) == "94339646"
    assert one(spark, keypad.sequence_of(F.lit("don't"))) is None
    assert one(spark, keypad.turned_over(F.lit("123456789"))) == "789456123"
    assert one(spark, keypad.once(F.lit("łódź"))) == "Łódź"
    assert one(spark, keypad.normalise(F.lit("- Don’t—go…"))) == "don't-go..."


@pytest.mark.parametrize(("pair", "value"), [("pink floyd", -2251039057464462053), ("ma ma", 6333728650633612191), ("z jego", -1810105805726866284), ("cię trzeba", -301744899490304790)])
def test_hashes(spark, pair, value):
    assert one(spark, corpus.fnv(F.lit(pair))) == value


def test_candidates(spark):
    counts = spark.createDataFrame([("los", 900000), ("kos", 4000), ("kop", 300), ("kotek", 90), ("kotlet", 80), ("kot", 100)], "word string, n long")
    lex = corpus.lexicon(counts)
    asked = spark.createDataFrame([("567",), ("568",), ("9999",)], "query string")
    got = lexicon.candidates(asked, lex).orderBy("query", "rank").collect()
    assert [r.word for r in got if r["query"] == "567"] == ["los", "kos", "kop"]
    assert [(r.word, r.exact) for r in got if r["query"] == "568"] == [("kot", True), ("kotek", False), ("kotlet", False)]
    assert {r["query"]: r.live for r in lexicon.has_prefix(asked, lex).collect()} == {"567": True, "568": True, "9999": False}


POLISH = {"kot": 5000, "kos": 400, "los": 900000, "to": 800000, "on": 700000, "anna": 500000, "ma": 600000, "mama": 30000}


@pytest.fixture(scope="module")
def beam(spark):
    def source(language, prior, counts):
        lex = corpus.lexicon(spark.createDataFrame(list(counts.items()), "word string, n long"))
        return decode.Source(language, prior, [tuple(r) for r in lex.orderBy("pos").select("seq", "word", "score").collect()])

    one, two = source("pl", 0.8, POLISH), source("en", 0.2, {"the": 900000, "cat": 20000})
    return decode.Beam([one]), decode.Beam([one, two])


@pytest.mark.parametrize(("keys", "reading"), [("568", "kot"), ("5670868", "los to"), ("568868", "kot to"), ("558", "kot"), ("262", "anna"), ("5688", "kot")])
def test_decode(beam, keys, reading):
    assert beam[0].readings([keys])[0][0].text == reading


def test_decode_two_languages(beam):
    got = beam[1].readings(["8430228"])[0][0]
    assert got.text == "the cat" and [w[1] for w in got.words] == ["en", "en"] and not got.mixed
    assert beam[0].readings(["999", "", "568"])[:2] == [[], []]


def test_spans_and_alternatives(beam):
    got = beam[0].readings(["568868"])[0][0]
    assert [(w[0], w[2], w[3]) for w in got.words] == [("kot", 0, 3), ("to", 3, 6)]
    assert [(w[0], w[2], w[3]) for w in beam[0].readings(["5670868"])[0][0].words] == [("los", 0, 3), ("to", 4, 7)]
    assert beam[0].readings(["567"])[0][0].words[0][4] == ["kos"]


def test_readings_do_not_depend_on_the_batch(beam):
    keys = ["568", "5670868", "568868", "558", "262", "5688", "8430228", "999"]
    together = beam[1].readings(keys)
    for k, got in zip(keys, together):
        alone = beam[1].readings([k])[0]
        assert [(r.text, round(r.score, 9)) for r in got] == [(r.text, round(r.score, 9)) for r in alone]


def test_context_and_learnt_words():
    rows = [("2", "a", 200), ("2", "b", 190), ("3", "d", 200)]
    plain = decode.Beam([decode.Source("en", 1.0, rows)])
    assert plain.readings(["203"])[0][0].text == "a d"
    weights = decode.Weights(context=1.0)
    pulled = decode.Beam([decode.Source("en", 1.0, rows, {("a", "d"): 3.0})], weights=weights).readings(["203"])[0][0]
    assert pulled.score == pytest.approx(plain.readings(["203"])[0][0].score + 3.0)
    learnt = decode.Beam([decode.Source("en", 0.65, rows), decode.Source(None, 1.0, [("4", "g", 220)])])
    got = learnt.readings(["204"])[0][0]
    assert got.text == "a g" and not got.mixed


def test_multitap(spark):
    p = spark.createDataFrame([(1, i, 100 * i, "9") for i in range(5)] + [(2, i, 100 * i, "4") for i in range(4)], "user_id long, event_id long, ms long, digit string")
    assert {r.user_id: r.letter for r in presses.multitap(p, 1200).collect()} == {1: "ź", 2: "g"}


def test_align():
    assert [s[0] for s in align.align("2662", "262")].count("deletion") == 1
    assert align.align("", "2") == [("insertion", 0, 0)]


def test_every_fragment_is_typed(spark, tmp_path):
    line = "one two three four five six seven eight nine"
    rows = [(0, "en", f"{line}\nit's ten"), (1, "en", "42 a"), (2, "en", None)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    seqs = [r.seq for r in spark.createDataFrame([(w,) for w in [*line.split(), "ten", "a"]], "w string").select(keypad.sequence_of(F.col("w")).alias("seq")).collect()]
    got = registry._typed(spark, str(tmp_path)).collect()
    assert sorted(r.wanted for r in got) == sorted(["0".join(seqs[:4]), "0".join(seqs[4:8]), seqs[8], seqs[9], seqs[10]])
    assert len({r.id for r in got}) == 5
    fragments = registry.queries()["o14_fragments"](spark, str(tmp_path)).collect()
    assert {r.fragment for r in fragments} == {"one two three four", "five six seven eight", "nine", "ten", "a"}


def test_whole_turns_are_decoded(spark, tmp_path):
    rows = [(1, 0, "user", "the cat sat on the mat, it's a cat"), (1, 1, "system", "no"), (2, 0, "user", "42"), (2, 2, "user", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(0, "en", "the cat sat on a mat")], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "the cat")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = registry.queries()["o42_decode"](spark, str(tmp_path)).collect()
    assert {r["keys"] for r in got} == {"84302280728066", "843020228"}


def test_limits_of_the_reference(spark, tmp_path):
    many = ["".join(w) for w in product("abcdefgh", repeat=5)][:20_500]
    spark.createDataFrame([(0, "en", " ".join(many))], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 0, "user", " ".join(many[:60]))], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    read = registry.queries()["o46_exact_reading"](spark, str(tmp_path))
    assert read.where("reading is null").count() == 0
    assert registry.queries()["o58_learn"](spark, str(tmp_path)).count() == 60


def test_align_is_cheapest_and_replays():
    r = random.Random(3)
    for _ in range(200):
        a, b = ("".join(r.choice("234") for _ in range(r.randint(0, 9))) for _ in range(2))
        path = align.align(a, b)
        cost = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i, j in product(range(1, len(a) + 1), range(1, len(b) + 1)):
            cost[i][j] = min(cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
        assert sum(op != "ok" for op, _, _ in path) == cost[-1][-1]
        assert [i for op, i, _ in path if op != "insertion"] == list(range(len(a)))
        assert [j for op, _, j in path if op != "deletion"] == list(range(len(b)))


def test_error_reports(spark):
    rows = spark.createDataFrame([(1, "2662", "262"), (2, "568", "558"), (3, "23", "23")], "id long, wanted string, typed string")
    steps = align.aligned(rows).cache()
    n = align.error_counts(steps).first()
    assert (n.ok, n.substitution, n.deletion, n.insertion, n.phrases, n.perfect, n.wanted) == (7, 1, 1, 0, 3, 1, 9)
    m = align.missed(steps).first()
    assert (m.in_repeat, m.isolated, m.repeats, m.wanted) == (1, 0, 1, 9)
    assert [(r.wanted_key, r.typed_key, r.n, r.adjacent) for r in align.worst_slips(steps).collect()] == [("6", "5", 1, True)]
    pooled = {r.source: r.wanted for r in align.by_source(steps.withColumn("source", F.when(F.col("id") == 1, "a").otherwise("b"))).collect()}
    assert pooled == {"a": 4, "b": 5, "ALL": 9}
    p = align.pace(spark.createDataFrame([([0, 120, 70],), ([0, 200],)], "millis array<long>")).first()
    assert (p["median"], p.p10, p.p90, p.longest, p.gaps) == (120.0, 70, 200, 200, 3)


def test_learnt_words_move_up(spark):
    lex = corpus.lexicon(spark.createDataFrame([("los", 900000), ("kos", 4000), ("kop", 300)], "word string, n long"))
    asked = spark.createDataFrame([(1, "567")], "user_id long, query string")
    for uses, place in ((1, 2), (3, 1)):
        events = spark.createDataFrame([(1, i, "Kop", False) for i in range(uses)], "user_id long, at long, word string, forget boolean")
        mine = users.user_candidates(asked, users.store(events))
        got = users.merged(asked, mine, lexicon.candidates(asked.select("query"), lex)).collect()
        assert {r.word: r["rank"] for r in got}["kop"] == place
    events = spark.createDataFrame([(1, 0, "kot", False), (1, 1, "kot", True), (1, 2, "don't", False)], "user_id long, at long, word string, forget boolean")
    assert users.store(events).count() == 0
