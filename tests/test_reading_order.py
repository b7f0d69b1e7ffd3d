import random
from functools import cmp_to_key

from leafgrid.model import derive_boxes
from leafgrid.operators import geometry

SCHEMA = "doc_id long, page_num int, box_idx int, x0 double, x1 double, y0 double, y1 double, text string"
#: Each of these is before the next, and the last before the first.
CYCLE = [(0.0, 0.2, 0.0, 0.5), (0.3, 0.5, 0.2, 0.9), (-0.4, -0.2, 0.5, 1.6)]


def before(a, b, shrink=0.2):
    """Reading order of rectangles (x0, x1, y0, y1) by its definition: vertical, then horizontal separation, then centres."""
    for lo, hi in ((2, 3), (0, 1)):
        a0, a1, b0, b1 = a[lo] + shrink * (a[hi] - a[lo]), a[hi] - shrink * (a[hi] - a[lo]), b[lo] + shrink * (b[hi] - b[lo]), b[hi] - shrink * (b[hi] - b[lo])
        if b0 > a1 and b1 > a0:
            return True
        if b0 < a1 and b1 < a0:
            return False
    centre = lambda r: ((r[2] + r[3]) / 2, (r[0] + r[1]) / 2)
    return centre(a) < centre(b)


def test_pages_are_sorted_alone_and_follow_each_other(spark):
    rng = random.Random(12)
    rows = []
    for d in range(8):
        for b in range(40):
            x, y = rng.randint(0, 60) / 64, rng.randint(0, 60) / 64
            rows.append((d, rng.choice([None, 0, 1, 2]), b, x, x + rng.choice([0.0, 0.02, 0.3]), y, y + rng.choice([0.0, 0.015, 0.2]), "t"))
    rows += [(99, 0, i, *r, "t") for i, r in enumerate(CYCLE)]
    found = {(r.doc_id, r.box_idx): r.order_idx for r in geometry.reading_order(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    for d in {r[0] for r in rows}:
        want = []
        for page in (0, 1, 2):
            own = sorted((r for r in rows if r[0] == d and (r[1] or 0) == page), key=lambda r: r[2])
            want += sorted(own, key=cmp_to_key(lambda a, b: -1 if before(a[3:7], b[3:7]) else 1 if before(b[3:7], a[3:7]) else 0))
        assert [found[d, r[2]] for r in want] == list(range(len(want)))


def test_clear_layouts_and_empty_tables(spark):
    columns = [(0, 0, i, 0.6 * (i // 3), 0.6 * (i // 3) + 0.3, 0.2 * (i % 3), 0.2 * (i % 3) + 0.1, "t") for i in range(6)]
    found = {r.box_idx: r.order_idx for r in geometry.reading_order(spark.createDataFrame(columns, SCHEMA)).collect()}
    assert found == {0: 0, 3: 1, 1: 2, 4: 3, 2: 4, 5: 5}
    assert geometry.reading_order(spark.createDataFrame([], SCHEMA)).collect() == []


def test_every_box_of_the_corpus_has_its_place(spark):
    boxes = derive_boxes(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    found = geometry.reading_order(boxes)
    assert found.columns == [*boxes.columns, "order_idx"]
    by = {}
    for r in found.collect():
        by.setdefault(r.doc_id, []).append((r.order_idx, r.page_num))
    assert all([o for o, _ in sorted(v)] == list(range(len(v))) and [p for _, p in sorted(v)] == sorted(p for _, p in v) for v in by.values())
