import random

import pytest

from leafgrid.functions.batching import batch_by_boxes, batch_by_pages, greedy_batches


def brute(rows, size, drop_last=False):
    """The batches of (group, key, count) by filling them one after the other."""
    out = {}
    for g in {r[0] for r in rows}:
        batches, held, total = [], [], 0
        for _, key, n in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2] or 0)):
            if held and total + (n or 0) > size:
                batches.append(held)
                held, total = [], 0
            held.append(key)
            total += n or 0
        if held and not drop_last:
            batches.append(held)
        out |= {(g, key): i for i, b in enumerate(batches) for key in b}
    return out


@pytest.mark.parametrize("size", [0, 1, 64])
@pytest.mark.parametrize("drop_last", [False, True])
def test_greedy_batches(spark, size, drop_last):
    rng = random.Random(size)
    rows = [(rng.choice(["a", "b", None, ""]) if i % 3 else "hot", i, rng.choice([0, 0, 1, 5, 30, 70, 200, None])) for i in range(300)]
    rows += [("zeros", 1000 + i, 0) for i in range(30)] + [("large", 2000 + i, 500) for i in range(9)] + [("one", 3000, 3)]
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], "source string, doc_id long, n long, i string, g string").repartition(7)
    found = greedy_batches(table, size, "n", "source", drop_last=drop_last)
    assert found.columns == [*table.columns, "batch"]
    assert {(r.source, r.doc_id): r.batch for r in found.collect()} == brute(rows, size, drop_last)


def test_one_long_chain_without_groups(spark):
    rows = [("", i, 1 + i % 3) for i in range(500)]
    found = greedy_batches(spark.createDataFrame(rows, "g string, doc_id long, n long"), 3, "n")
    assert {("", r.doc_id): r.batch for r in found.collect()} == brute(rows, 3)


def test_boxes_pages_and_empty_tables(spark):
    docs = spark.createDataFrame([(i,) for i in range(6)], "doc_id long")
    boxes = spark.createDataFrame([(i, p) for i in range(5) for p in range(i) for _ in range(2)], "doc_id long, page_num int")
    by_box = {r.doc_id: (r.n_boxes, r.batch) for r in batch_by_boxes(boxes, docs, 6).collect()}
    assert by_box == {0: (0, 0), 1: (2, 0), 2: (4, 0), 3: (6, 1), 4: (8, 2), 5: (0, 3)}
    by_page = {r.doc_id: (r.n_pages, r.batch) for r in batch_by_pages(boxes, docs, 3).collect()}
    assert by_page == {0: (0, 0), 1: (1, 0), 2: (2, 0), 3: (3, 1), 4: (4, 2), 5: (0, 3)}
    assert batch_by_boxes(boxes, docs.limit(0), 6).collect() == []
