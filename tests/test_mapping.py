"""Per-document and per-batch callables."""

import pytest

from leafgrid.functions import mapping


def test_map_documents(spark):
    rows = spark.createDataFrame([(i, f"a b{i}", [i]) for i in range(1000)], "doc_id long, text string, more array<long>").repartition(3)

    def upper(doc, tail):
        return {**doc, "text": doc["text"].upper() + tail} if doc["doc_id"] % 2 else None

    found = mapping.map_documents(rows, upper, kwargs={"tail": "!"})
    assert found.columns == rows.columns
    assert sorted((r.doc_id, r.text, r.more) for r in found.collect()) == [(i, f"A B{i}!", [i]) for i in range(1, 1000, 2)]

    def words(doc):
        for w in doc["text"].split():
            yield {"doc_id": doc["doc_id"], "word": w, "odd": 1}

    found = mapping.map_documents(rows, words, "doc_id long, word string, lacking int", rows_per_batch=7)
    assert sorted((r.doc_id, r.word, r.lacking) for r in found.collect()) == sorted((i, w, None) for i in range(1000) for w in ("a", f"b{i}"))
    assert mapping.map_documents(rows.filter("false"), words, "doc_id long, word string").count() == 0


def test_map_batches(spark):
    rows = spark.range(25).withColumnRenamed("id", "doc_id").coalesce(1)

    def sizes(docs, plus):
        return [{"doc_id": d["doc_id"], "size": len(docs) + plus} for d in docs]

    found = mapping.map_batches(rows, sizes, 10, "doc_id long, size int", {"plus": 1})
    assert sorted((r.doc_id, r.size) for r in found.collect()) == [(i, 11 if i < 20 else 6) for i in range(25)]
    with pytest.raises(ValueError):
        mapping.map_batches(rows, sizes, 0)
