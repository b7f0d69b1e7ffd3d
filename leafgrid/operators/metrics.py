"""Scores of predicted labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label_scores(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """label, precision, recall, f1, support and the overall accuracy, over boxes with text.

    Labels that occur on either side are listed; ratios without a denominator are zero.
    """
    both = gold.filter("text <> ''").select("doc_id", "box_idx", F.col("label").alias("gold")).join(predicted.select("doc_id", "box_idx", F.col("label").alias("pred")), ["doc_id", "box_idx"])
    counts = both.groupBy("gold", "pred").agg(F.count(F.lit(1)).alias("n"))
    each = counts.select(F.explode(F.array_distinct(F.array("gold", "pred"))).alias("label"), "gold", "pred", "n").filter("label IS NOT NULL")
    sums = each.groupBy("label").agg(
        F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)).alias("hit"),
        F.sum(F.when(F.col("pred") == F.col("label"), F.col("n")).otherwise(0)).alias("said"),
        F.sum(F.when(F.col("gold") == F.col("label"), F.col("n")).otherwise(0)).alias("support"),
    )
    total = counts.agg(F.expr("sum(CASE WHEN gold <=> pred THEN n ELSE 0 END) / sum(n)").alias("accuracy"))
    ratio = lambda a, b: f"CASE WHEN {b} = 0 THEN 0D ELSE {a} / {b} END"
    out = sums.selectExpr("label", f"{ratio('hit', 'said')} AS precision", f"{ratio('hit', 'support')} AS recall", f"{ratio('2 * hit', '(said + support)')} AS f1", "support")
    return out.withColumn("__one", F.lit(1)).join(F.broadcast(total.withColumn("__one", F.lit(1))), "__one").drop("__one")


def label_averages(scores: DataFrame) -> DataFrame:
    """average (macro, weighted), precision, recall, f1, support, accuracy over the labels of label_scores.

    macro counts labels alike, weighted by their support; no support at all gives zeros, no labels no rows.
    """
    mean = lambda c: F.avg(c).alias(c)
    shared = lambda c: F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")), F.lit(0.0)).alias(c)
    parts = [scores.agg(F.lit(name).alias("average"), *[how(c) for c in ("precision", "recall", "f1")], F.sum("support").alias("support"), F.max("accuracy").alias("accuracy")) for name, how in (("macro", mean), ("weighted", shared))]
    return parts[0].unionByName(parts[1]).filter("support IS NOT NULL")
