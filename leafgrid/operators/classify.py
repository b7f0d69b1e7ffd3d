"""Classifiers: masks, constants, random draws and a trained linear model."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline as MlPipeline
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .geometry import MARGIN, Region, align_regions


def multi_mask_classify(boxes: DataFrame, masks: Mapping[str, Sequence[float]], threshold: float = 1.0) -> DataFrame:
    """Label boxes by named masks (x0, y0, x1, y1), in order; what none covers is pollution."""
    regions = [Region(name, *map(float, m)) for name, m in masks.items()]
    return align_regions(boxes, [*regions, Region("pollution", -MARGIN, -MARGIN, MARGIN, MARGIN)], threshold)


def mask_classify(boxes: DataFrame, x0: float, y0: float, x1: float, y1: float, threshold: float = 1.0) -> DataFrame:
    """Label boxes body inside one mask and pollution elsewhere."""
    return multi_mask_classify(boxes, {"body": (x0, y0, x1, y1)}, threshold)


def dummy_classify(boxes: DataFrame, label: str) -> DataFrame:
    return boxes.withColumn("label", F.lit(label))


def random_classify(boxes: DataFrame, labels: Sequence[str] | Mapping[str, float], seed: int = 0) -> DataFrame:
    """Draw labels by weight from a generator keyed by document, box and seed.

    The draw depends on nothing else, so it is the same in any partitioning; it is integer
    arithmetic, so that other engines can repeat it.  Ids that are no integers count by their CRC-32.
    """
    weights = dict(labels) if isinstance(labels, Mapping) else {x: 1.0 for x in labels}
    total, up = sum(weights.values()), 0.0
    number = "doc_id" if isinstance(boxes.schema["doc_id"].dataType, IntegralType) else "crc32(CAST(doc_id AS BINARY))"
    draw = F.expr(f"pmod(({number} % 1000003 * 7919 + box_idx * 104729 + {seed}) * 48271, 2147483647) / 2147483647D")
    label = None
    names = list(weights)
    for name in names[:-1]:
        up += weights[name] / total
        label = F.when(draw < up, F.lit(name)) if label is None else label.when(draw < up, F.lit(name))
    return boxes.withColumn("label", F.lit(names[-1]) if label is None else label.otherwise(F.lit(names[-1])))


LAYOUT = ("xmin", "ymin", "xmax", "ymax", "width", "height", "first_page", "last_page")


def train_classifier(featured: DataFrame, features: Sequence[str] = LAYOUT, label_col: str = "label", reg: float = 1e-3) -> PipelineModel:
    """A linear classifier of boxes; boxes without a label take no part in training.

    Labels are indexed by name, so new ones are found by the fit itself.
    """
    index = StringIndexer(inputCol=label_col, outputCol="__y", stringOrderType="alphabetAsc").fit(featured.filter(F.col(label_col).isNotNull()))
    stages = [VectorAssembler(inputCols=list(features), outputCol="__x"), LogisticRegression(featuresCol="__x", labelCol="__y", predictionCol="__p", rawPredictionCol="__raw", probabilityCol="__prob", regParam=reg, maxIter=50)]
    model = MlPipeline(stages=stages).fit(index.transform(featured.filter(F.col(label_col).isNotNull())))
    return PipelineModel(stages=[*model.stages, IndexToString(inputCol="__p", outputCol="predicted", labels=index.labels)])


def trained_classify(featured: DataFrame, model: PipelineModel) -> DataFrame:
    """The most likely label of each box; boxes without text get none."""
    out = model.transform(featured)
    label = F.when(F.length("text") > 0, F.col("predicted"))
    return out.withColumn("label", label).drop("__x", "__y", "__p", "__raw", "__prob", "predicted")


def adapt_annotations(boxes: DataFrame, annotations: DataFrame, relabel: Mapping[str, str] | None = None, threshold: float = 1e-4) -> DataFrame:
    """Labelled boxes for training: aligned, relabelled, and without unlabelled boxes that have text."""
    from .geometry import align_box_labels

    out = align_box_labels(annotations, boxes, threshold)
    for old, new in (relabel or {"section_title": "body", "table": "body"}).items():
        out = out.withColumn("label", F.when(F.col("label") == old, F.lit(new)).otherwise(F.col("label")))
    return out.filter("text = '' OR label IS NOT NULL")
