"""Ids of any type, short items and clashing columns."""

import pytest

from roomledger.llm import decontam, simhash

WORDS = "one two three four five six seven eight nine ten"


@pytest.mark.parametrize("kind", ["int", "long", "string", "smallint"])
def test_decontamination_keeps_the_type_of_ids(spark, kind):
    docs = spark.createDataFrame([(1, f"so {WORDS} it goes"), (2, "clean"), (None, WORDS)], "doc_id long, text string")
    items = spark.createDataFrame([(7, WORDS), (None, WORDS)], "item_id long, text string")
    found = decontam.contaminations(docs.selectExpr(f"CAST(doc_id AS {kind}) AS doc_id", "text"), items.selectExpr(f"CAST(item_id AS {kind}) AS item_id", "text"))
    types = dict(found.dtypes)
    assert types["doc_id"] == types["item_id"] == {"long": "bigint"}.get(kind, kind)
    item = "7" if kind == "string" else 7
    assert {(str(r.doc_id), r.item_id) for r in found.collect()} == {(d, i) for d in ("1", "None") for i in (item, None)}
    nobody = items.filter("item_id IS NULL").selectExpr(f"CAST(item_id AS {kind}) AS item_id", "text")
    assert {r.item_id for r in decontam.contaminations(docs, nobody).collect()} == {None}


def test_short_items_are_found_only_as_whole_documents(spark):
    docs = spark.createDataFrame([(1, "I live in New York today"), (2, "New York!"), (3, "york new"), (4, None), (5, "")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "New York"), (2, ""), (3, None)], "item_id long, text string")
    found = decontam.contaminations(docs, items).collect()
    assert [tuple(r) for r in found] == [(2, 1, 1.0, 0, 2)]
    assert sorted(r.doc_id for r in decontam.decontaminated(docs, items).collect()) == [1, 3, 4, 5]


def test_one_of_each_keeps_columns_of_any_name(spark):
    rows = [(3, WORDS, "a", "x", 1), (1, WORDS, "b", "y", 2), (2, "another text altogether", "c", "z", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __id string, __text string, node int")
    found = simhash.one_of_each(docs)
    assert found.columns == docs.columns
    assert sorted(map(tuple, found.collect())) == [(1, WORDS, "b", "y", 2), (2, "another text altogether", "c", "z", 3)]
