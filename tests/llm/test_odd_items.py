"""Deeply nested escapes, and benchmark items whose ids are null or strings."""

import pytest

from keyloom.llm import decontam, secrets

PASSAGE = "one two three four five six seven eight nine ten"


@pytest.mark.parametrize("text", ["%" + "25" * 1500 + "41KIAABCDEFGHIJKLMNOPQ", "\\x5c" * 1 + "x5c" * 1200 + "x41KIAABCDEFGHIJKLMNOPQ", "%" + "25" * 1500 + "41"])
def test_escapes_nested_a_thousand_times(text):
    spans = secrets.scan(text)[-1]
    assert ("access" in spans) == text.endswith("Q")
    assert "ABCDEFGHIJKLMNOPQ" not in secrets.masked(text, spans)


@pytest.mark.parametrize("block_bytes", [1 << 24, 30])
@pytest.mark.parametrize(("kind", "ids", "best"), [("long", (None, 7, 3), 3), ("string", (None, "b", "a"), "a"), ("long", (None, None, None), None)])
def test_items_without_id_or_with_string_ids(spark, kind, ids, best, block_bytes):
    docs = spark.createDataFrame([(1, f"before {PASSAGE} after"), (2, "nothing of the kind at all here"), (None, None)], "doc_id long, text string")
    items = spark.createDataFrame([(i, PASSAGE) for i in ids] + [(ids[1], None)], f"item_id {kind}, text string")
    out = decontam.decontaminate(docs, items, block_bytes=block_bytes)
    assert dict(out.dtypes)["best_item"] == {"long": "bigint"}.get(kind, kind)
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].contaminated and got[1].n_items == 3 and got[1].best_item == best and got[1].coverage == 1.0
    assert not got[2].contaminated and got[2].n_items == 0 and got[2].best_item is None
    assert [r.doc_id for r in decontam.clean(docs, items, block_bytes=block_bytes).collect()] in ([2, None], [None, 2])
