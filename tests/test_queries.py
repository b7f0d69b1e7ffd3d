"""Each registered query against its SQL, and the layout cases by hand."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from leafgrid.operators import aggregate, classify, geometry
from leafgrid.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return f"{v + 0.0:.9g}"
    if isinstance(v, list | tuple):
        return [plain(x) for x in v]
    return v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cur = duck.execute(catalog.ORACLES[name])
    cols = [c[0] for c in cur.description]
    order = sorted(df.columns)
    assert sorted(cols) == order
    want = sorted(repr([plain(x[cols.index(c)]) for c in order]) for x in cur.fetchall())
    assert sorted(repr([plain(x[c]) for c in order]) for x in df.collect()) == want


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() >= 0
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


KIND = "doc_id long, page_num int, box_idx int, x0 double, x1 double, y0 double, y1 double, label string, text string"


def sheet(spark, pages=1):
    """On each page a title across the top quarter, a note at the left and a table at the right below it."""
    rows = [(7, p, 3 * p + i, *r, None, t) for p in range(pages) for i, (r, t) in enumerate([((0.0, 1.0, 0.0, 0.25), "title"), ((0.0, 0.25, 0.5, 0.75), "note"), ((0.5, 1.0, 0.5, 1.0), "table")])]
    return spark.createDataFrame(rows, KIND)


def labels(df):
    return [r.label for r in df.orderBy("box_idx").collect()]


def test_masks(spark):
    # the mask covers the whole note and half of the table
    assert labels(classify.mask_classify(sheet(spark), 0, 0.5, 0.75, 1, threshold=0.5)) == ["pollution", "body", "body"]
    assert labels(classify.mask_classify(sheet(spark), 0, 0.5, 0.75, 1, threshold=0.75)) == ["pollution", "body", "pollution"]
    assert labels(classify.dummy_classify(sheet(spark), "any")) == ["any"] * 3


def test_align(spark):
    kind = "doc_id long, page_num int, src_idx int, x0 double, x1 double, y0 double, y1 double, label string"
    paged = spark.createDataFrame([(7, 1, 0, 0.0, 1.0, 0.5, 1.0, "lower"), (7, 2, 1, 0.0, 0.5, 0.0, 1.0, "left")], kind)
    found = geometry.align_box_labels(paged, sheet(spark, 3), 0.5, "none")
    assert labels(found) == ["none", "lower", "lower", "left", "left", "none"]  # page 0 has no annotation
    everywhere = spark.createDataFrame([(7, None, 0, 0.0, 1.0, 0.0, 1.0, "page"), (7, None, 1, 0.5, 1.0, 0.5, 1.0, "corner")], kind)
    assert labels(geometry.align_box_labels(everywhere, sheet(spark, 2), 0.5)) == ["page", "page", "corner"] * 2


def test_aggregate_pages(spark):
    lines = [(0, 0.25, 0.0, 0.125, "Dear"), (0, 0.5, 0.0, 0.125, "reader,"), (0, 0.25, 0.25, 0.375, "far below"), (1, 0.25, 0.0, 0.125, "overleaf")]
    rows = [(7, p, i, x, x + 0.25, a, b, "letter", t) for i, (p, x, a, b, t) in enumerate(lines)]
    found = aggregate.aggregate(spark.createDataFrame(rows, KIND)).collect()
    assert [(r.label, r.text, r.n_boxes) for r in found] == [("letter", "Dear reader,\n\nfar below\n\noverleaf", 4)]


def test_merge():
    rects = [(0, 1, 0, 0.1), (0, 1, 0.1, 0.2), (0, 1, 0.3, 0.4), (0, 1, 0.5, 0.6)]
    first, second, other, last = geometry.merge_keys(rects, ["body", "body", "other", "body"])
    assert first == second and len({first, other, last}) == 3


def test_random_classify_of_text_ids(spark):
    rows = [(f"doc-{i}", j) for i in range(200) for j in range(5)]
    found = classify.random_classify(spark.createDataFrame(rows, "doc_id string, box_idx int"), {"body": 3, "header": 1}, 1).groupBy("label").count().collect()
    counts = {r["label"]: r["count"] for r in found}
    assert sum(counts.values()) == 1000 and 600 < counts["body"] < 900
