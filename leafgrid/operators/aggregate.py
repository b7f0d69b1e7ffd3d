"""Rebuilding styled text per label from ordered, labelled boxes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import PROPS


def aggregate(
    boxes: DataFrame,
    sort: bool = False,
    new_line_threshold: float = 0.2,
    new_paragraph_threshold: float = 1.5,
    label_map: Mapping[str, str | Sequence[str]] | None = None,
) -> DataFrame:
    """doc_id, label, text, properties, n_boxes: the text of each label with its breaks restored.

    Between two lines stands a blank line after a page, or if the next line lies more than
    new_paragraph_threshold of the label's median height below; a line break beyond
    new_line_threshold; else a space.  A label mapped to two outputs counts in both; every output of
    label_map appears, empty if it has no lines.  With sort, lines go by label, page, row and x.
    A median height of zero breaks the paragraph if the next line is lower.

    All windows and the final aggregate share one exchange on (doc_id, label); a document's label
    bounds a group.
    """
    props = F.col("props") if "props" in boxes.columns else F.array().cast(PROPS)
    rows = boxes.withColumn("props", F.coalesce(props, F.array().cast(PROPS)))
    if sort:
        rows = rows.withColumn("__row", F.avg(F.col("y1") - F.col("y0")).over(Window.partitionBy("doc_id")))
        rows = rows.withColumn("__row", F.floor(F.try_divide("y1", "__row")))
        order = ["__old", "page_num", "__row", "x0", "box_idx"]
    else:
        order = ["box_idx"]
    lines = rows.filter("length(text) > 0 AND label IS NOT NULL").withColumn("__old", F.col("label"))
    outputs = {k: [v] if isinstance(v, str) else list(v) for k, v in (label_map or {}).items()}
    if outputs:
        new: dict[str, list[str]] = {}
        for out, olds in outputs.items():
            for old in olds:
                new.setdefault(old, []).append(out)
        named = F.array(F.col("label"))
        for old, outs in new.items():
            named = F.when(F.col("__old") == old, F.array(*map(F.lit, outs))).otherwise(named)
        lines = lines.withColumn("label", F.explode(named))
    within = Window.partitionBy("doc_id", "label")
    at = within.orderBy(*order)
    lines = lines.withColumn("__h", F.median(F.col("y1") - F.col("y0")).over(within)).withColumn("__ord", F.row_number().over(at))
    lines = lines.withColumns({f"__{c}": F.lead(c).over(at) for c in ("page_num", "y0", "y1")}).withColumn("__last", F.lead(F.lit(1)).over(at).isNull())
    beyond = lambda t: f"(CASE WHEN __h = 0 THEN __y1 > y1 ELSE (__y1 - y1) / __h > {float(t)!r}D END) AND __y0 > y1"
    sep = F.expr(f"""CASE WHEN __last THEN '' WHEN NOT (page_num <=> __page_num) THEN '\n\n'
        WHEN {beyond(new_paragraph_threshold)} THEN '\n\n' WHEN {beyond(new_line_threshold)} THEN '\n' ELSE ' ' END""")
    lines = lines.withColumn("__piece", F.concat("text", sep))
    offset = F.coalesce(F.sum(F.length("__piece")).over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    lines = lines.withColumn("__off", offset)
    moved = F.transform("props", lambda p: F.struct(p["italic"].alias("italic"), p["bold"].alias("bold"), (p["begin"] + F.col("__off")).alias("begin"), (p["end"] + F.col("__off")).alias("end"), p["fontname"].alias("fontname")))
    pieces = F.array_sort(F.collect_list(F.struct(F.col("__ord").alias("o"), F.col("__piece").alias("t"), moved.alias("p"))))
    texts = lines.groupBy("doc_id", "label").agg(pieces.alias("__all"), F.count(F.lit(1)).alias("n_boxes"))
    texts = texts.select("doc_id", "label", F.array_join(F.transform("__all", lambda x: x["t"]), "").alias("text"), F.flatten(F.transform("__all", lambda x: x["p"])).alias("properties"), "n_boxes")
    if outputs:
        wanted = boxes.select("doc_id").distinct().withColumn("label", F.explode(F.array(*map(F.lit, outputs))))
        texts = wanted.join(texts, ["doc_id", "label"], "full").select("doc_id", "label", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("properties", F.array().cast(PROPS)).alias("properties"), F.coalesce("n_boxes", F.lit(0)).alias("n_boxes"))
    return texts


def to_map(texts: DataFrame) -> DataFrame:
    """One row for each document: label -> (text, properties)."""
    return texts.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("label", F.struct("text", "properties")))).alias("aggregated_texts"))


def markdown(texts: DataFrame) -> DataFrame:
    """The texts with bold and italic runs marked, bold inside italic; empty runs are left out."""
    runs = F.filter("properties", lambda p: p["begin"] < p["end"])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, p):
        snippet = F.substring("text", p["begin"] + 1, p["end"] - p["begin"])
        snippet = F.when(p["bold"], F.concat(F.lit("**"), snippet, F.lit("**"))).otherwise(snippet)
        snippet = F.when(p["italic"], F.concat(F.lit("_"), snippet, F.lit("_"))).otherwise(snippet)
        gap = F.substring("text", acc["at"] + 1, F.greatest(p["begin"] - acc["at"], F.lit(0)))
        return F.struct(p["end"].alias("at"), F.concat(acc["out"], gap, snippet).alias("out"))

    done = lambda acc: F.concat(acc["out"], F.substring("text", acc["at"] + 1, F.greatest(F.length("text") - acc["at"], F.lit(0))))
    return texts.withColumn("text", F.aggregate(runs, start, step, done))
