"""Runs of style by line against the flat table, and merging against one rectangle at a time."""

import random

from pyspark.sql import functions as F

from leafgrid.operators import extract, geometry
from leafgrid.plans import catalog


def test_style_runs_of_lines_are_those_of_characters(spark):
    rng = random.Random(4)
    rows = [(d, b, [(i, rng.choice("ab é \t🙂"), rng.choice(["Times-Bold", "x-ITALIC", "Times", None]), rng.choice([True, True, False, None])) for i in range(rng.randint(0, 14))]) for d in range(30) for b in range(4)]
    lines = spark.createDataFrame(rows, "doc_id long, box_idx int, c array<struct<pos:int,ch:string,fontname:string,upright:boolean>>").persist()
    want = extract.style_runs(lines.select("doc_id", "box_idx", F.inline("c")))
    found = extract.style_runs_in_lines(lines.select("doc_id", "box_idx", "c.ch", "c.fontname", "c.upright"))
    assert sorted(map(repr, found.collect())) == sorted(map(repr, want.collect()))
    plan = catalog.QUERIES["style_runs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_pages_are_merged_as_rows_and_rectangles_without_sides(spark):
    rows = [(1, 0, 2, None, 0.5, 0.0, 0.1, "x"), (1, 0, 1, None, 0.7, 0.0, 0.1, "x"), (1, None, 0, 0.0, 0.5, 0.0, 0.1, None)]
    merged = geometry.merge_boxes(spark.createDataFrame(rows, "doc_id long, page_num int, box_idx int, x0 double, x1 double, y0 double, y1 double, label string"))
    assert sorted((r.page_num is None, r.box_idx, r.label, r.x0, r.x1, r.n_boxes) for r in merged.collect()) == [(False, 1, "x", None, 0.7, 2), (True, 0, None, 0.0, 0.5, 1)]
    assert "FlatMapGroups" not in merged._jdf.queryExecution().executedPlan().toString()


def test_text_embedding_folds_each_word_once(spark, monkeypatch):
    kept, settle = [], catalog.settle
    monkeypatch.setattr(catalog, "settle", lambda df: kept.append(settle(df)) or kept[-1])
    catalog.text_embedding(spark, "/root/testdata/sf0.001")
    words = catalog._read(spark, "/root/testdata/sf0.001", "documents").select(F.explode(F.split("text", "[ \n]", -1)).alias("w")).filter("w <> ''")
    assert [t.count() for t in kept] == [words.distinct().count()]
