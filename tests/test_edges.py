"""Edge cases of the layout operators: boxes without area, equal scores, thresholds beyond reach, pages without annotations, lines without height."""

import pytest
from pyspark.sql import functions as F

from leafgrid.functions.features import combine_embeddings, layout_embedding, layout_features
from leafgrid.operators import aggregate, geometry
from leafgrid.operators.geometry import Region

BOX = "doc_id long, page_num int, box_idx int, x0 double, x1 double, y0 double, y1 double, label string, text string"
SRC = "doc_id long, page_num int, src_idx int, x0 double, x1 double, y0 double, y1 double, label string"


def boxes(spark, *rows):
    return spark.createDataFrame([(1, r[0], i, *r[1:5], r[5] if len(r) > 5 else None, r[6] if len(r) > 6 else "t") for i, r in enumerate(rows)], BOX)


def labels(df):
    return [r.label for r in df.orderBy("box_idx").collect()]


def test_equal_scores_go_to_the_first_region(spark):
    found = geometry.align_regions(boxes(spark, (0, 0.1, 0.2, 0.1, 0.2)), [Region("a", 0, 0, 1, 1), Region("b", 0, 0, 1, 1)], 0.5)
    assert labels(found) == ["a"]


def test_threshold_above_one_leaves_pollution_aside_for_the_first(spark):
    found = geometry.align_regions(boxes(spark, (0, 0.1, 0.2, 0.1, 0.2)), [Region("a", 0, 0, 1, 1)], 1.5, "pollution")
    assert labels(found) == ["a"]  # every score is zero, and the first of equals wins


def test_box_without_area_takes_the_first_region(spark):
    found = geometry.align_regions(boxes(spark, (0, 0.1, 0.1, 0.1, 0.1)), [Region("a", 0.5, 0.5, 1, 1), Region("b", 0, 0, 1, 1)], 0.5, "pollution")
    assert labels(found) == ["a"]


def test_pages_without_annotations_are_dropped(spark):
    src = spark.createDataFrame([(1, 0, 0, 0.0, 1.0, 0.0, 1.0, "a")], SRC)
    found = geometry.align_box_labels(src, boxes(spark, (0, 0.1, 0.2, 0.1, 0.2), (1, 0.1, 0.2, 0.1, 0.2), (None, 0.1, 0.2, 0.1, 0.2)))
    assert [(r.box_idx, r.label) for r in found.orderBy("box_idx").collect()] == [(0, "a"), (2, "a")]


def test_lines_without_height_and_without_text_or_label(spark):
    rows = boxes(spark, (0, 0.1, 0.2, 0.1, 0.1, "body", "one"), (0, 0.1, 0.2, 0.3, 0.3, "body", "two"), (0, 0.1, 0.2, 0.4, 0.4, "body", ""), (0, 0.1, 0.2, 0.5, 0.5, None, "no"), (1, 0.1, 0.2, 0.5, 0.5, "body", "three"))
    found = {r.label: (r.text, r.n_boxes) for r in aggregate.aggregate(rows).collect()}
    assert set(found) == {"body"} and found["body"][1] == 3
    assert found["body"][0].split() == ["one", "two", "three"] and found["body"][0].endswith("\n\nthree")


def test_cliques_of_boxes_without_labels_merge_by_their_own_kind(spark):
    rows = boxes(spark, (0, 0.0, 0.1, 0.0, 0.1, None), (0, 0.2, 0.3, 0.0, 0.1, None), (0, 0.0, 0.3, 0.4, 0.5, "x"))
    found = {(r.label, r.n_boxes) for r in geometry.merge_boxes(rows).collect()}
    assert found == {(None, 2), ("x", 1)}


def test_layout_embeddings_and_their_sum(spark):
    rows = layout_embedding(layout_features(boxes(spark, (0, 0.0, 0.5, 0.0, 0.25), (1, 0.5, 1.0, 0.5, 1.0))), 64, 24).select("doc_id", "box_idx", "embedding")
    found = {r.box_idx: r.embedding for r in rows.collect()}
    assert all(len(v) == 24 for v in found.values()) and found[0][:4] == [0.0, 1.0, 0.0, 1.0] and found[0] != found[1]
    doubled = combine_embeddings(rows.withColumnRenamed("embedding", "a").withColumn("b", F.col("a")), ["a", "b"])
    assert {r.box_idx: r.embedding for r in doubled.collect()} == {k: [2 * x for x in v] for k, v in found.items()}
    beside = combine_embeddings(rows, ["embedding", "embedding"], "cat", "both")
    assert {r.box_idx: r.both for r in beside.collect()} == {k: v + v for k, v in found.items()}
    with pytest.raises(ValueError):
        combine_embeddings(rows, ["embedding"], "mean")
