"""Words made to collide, and labelled documents that repeat."""

import zlib

from keyloom.llm import jaccard, quality


def test_thue_morse_words_are_told_apart(spark):
    a = "a"
    while len(a) < 1024:
        a += a.translate({97: 98, 98: 97})
    b = a.translate({97: 98, 98: 97})
    docs = spark.createDataFrame([(1, a), (2, b), (3, a.upper())], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_a_repeated_doc_id_is_learned_from_once(spark):
    ids = [i for i in range(40) if not (zlib.crc32(str(i).encode()) % 4 == 2)]
    rows = [(i, "good words of a text" if i % 2 else "bad %% $$ ## noise") for i in ids]
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    once = spark.createDataFrame(rows, "doc_id long, text string")
    again = spark.createDataFrame(rows + [(ids[0], rows[0][1] + " zz")] * 500, "doc_id long, text string")
    assert (quality.fit(once, labels) == quality.fit(again, labels)).all()
