"""Geometry of boxes: alignment with labelled regions, reading order, merging, relative positions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

UNIVERSE = 100000.0
MARGIN = 10000.0


@dataclass(frozen=True)
class Region:
    """A labelled rectangle that holds on every page."""

    label: str | None
    x0: float
    y0: float
    x1: float
    y1: float


def overlap_score(src: dict[str, Column], threshold: float) -> Column:
    """The share of a source rectangle that a box (columns x0..y1) covers.

    Zero if the overlap is less than threshold of the box; areas of zero count as one.
    """
    dx = F.least(src["x1"], F.col("x1")) - F.greatest(src["x0"], F.col("x0"))
    dy = F.least(src["y1"], F.col("y1")) - F.greatest(src["y0"], F.col("y0"))
    overlap = F.greatest(dx, F.lit(0.0)) * F.greatest(dy, F.lit(0.0))
    one = lambda a: F.when(a == 0, F.lit(1.0)).otherwise(a)
    src_area = one((src["x1"] - src["x0"]) * (src["y1"] - src["y0"]))
    dst_area = one((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    return F.when(overlap / dst_area < threshold, F.lit(0.0)).otherwise(overlap / src_area)


def _first_best(scores: Sequence[tuple[Column, Column]]) -> Column:
    """The label of the first greatest score: a chain of comparisons without a join."""
    best, label = scores[0]
    for score, other in scores[1:]:
        label = F.when(score > best, other).otherwise(label)
        best = F.greatest(best, score)
    return label


def align_regions(boxes: DataFrame, regions: Sequence[Region], threshold: float = 1e-4, pollution_label: str | None = None) -> DataFrame:
    """Label boxes by the best covered of a few fixed regions: one projection, no join, no shuffle."""
    every = [*regions, Region(pollution_label, -UNIVERSE, -UNIVERSE, UNIVERSE, UNIVERSE)]
    score = lambda r: overlap_score({k: F.lit(float(getattr(r, k))) for k in ("x0", "x1", "y0", "y1")}, threshold)
    return boxes.withColumn("label", _first_best([(score(r), F.lit(r.label).cast("string")) for r in every]))


def align_box_labels(src: DataFrame, boxes: DataFrame, threshold: float = 1e-4, pollution_label: str | None = None) -> DataFrame:
    """Label boxes by the annotations of their document and page.

    An annotation without a page holds on every page.  The smallest covering annotation wins, the
    first of equals; a box that none covers well enough gets pollution_label, unless its score for
    the whole plane is zero too (no area), when the first annotation wins.  Boxes of a page without
    annotations are dropped; a box without a page takes all of its document's annotations.

    Annotations are gathered per document, so the join makes one row for each box.
    """
    each = src.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("src_idx", "page_num", "x0", "x1", "y0", "y1", "label"))).alias("__src"))
    joined = boxes.join(each, "doc_id").withColumn("__src", F.filter("__src", lambda s: s["page_num"].isNull() | F.col("page_num").isNull() | (s["page_num"] == F.col("page_num"))))
    scored = F.transform("__src", lambda s: F.struct(overlap_score({k: s[k] for k in ("x0", "x1", "y0", "y1")}, threshold).alias("score"), (-s["src_idx"]).alias("order"), s["label"].alias("label")))
    plane = overlap_score({"x0": F.lit(-UNIVERSE), "x1": F.lit(UNIVERSE), "y0": F.lit(-UNIVERSE), "y1": F.lit(UNIVERSE)}, threshold)
    joined = joined.filter(F.size("__src") > 0).withColumn("__best", F.array_max(scored))
    label = F.when(plane > F.col("__best.score"), F.lit(pollution_label).cast("string")).otherwise(F.col("__best.label"))
    return joined.withColumn("label", label).drop("__src", "__best")


def renumber(boxes: DataFrame) -> DataFrame:
    """box_idx anew by page, then former order."""
    order = Window.partitionBy("doc_id").orderBy("page_num", "box_idx")
    return boxes.withColumn("box_idx", F.row_number().over(order) - 1)


def reading_order_center(boxes: DataFrame) -> DataFrame:
    """Adds order_idx: place by page, then centre (y, x), then box_idx; a total order."""
    order = Window.partitionBy("doc_id").orderBy(F.coalesce("page_num", F.lit(0)), (F.col("y0") + F.col("y1")) / 2, (F.col("x0") + F.col("x1")) / 2, "box_idx")
    return boxes.withColumn("order_idx", (F.row_number().over(order) - 1).cast("int"))


def precedes(a: dict, b: dict, shrink: float = 0.2) -> bool:
    """Whether box a is read before box b: by page, then vertical, then horizontal separation.

    Both are shrunk by a fifth on each side, so that boxes that barely overlap count as apart.
    """
    if (a["page_num"] or 0) != (b["page_num"] or 0):
        return (a["page_num"] or 0) < (b["page_num"] or 0)
    for lo, hi in (("y0", "y1"), ("x0", "x1")):
        da, db = shrink * (a[hi] - a[lo]), shrink * (b[hi] - b[lo])
        before = (b[lo] + db) - (a[hi] - da)
        across = (b[hi] - db) - (a[lo] + da)
        if before > 0 and across > 0:
            return True
        if before < 0 and across < 0:
            return False
    return ((a["y0"] + a["y1"]) / 2, (a["x0"] + a["x1"]) / 2) < ((b["y0"] + b["y1"]) / 2, (b["x0"] + b["x1"]) / 2)


def reading_order(boxes: DataFrame) -> DataFrame:
    """Adds order_idx by ``precedes``, which is no strict order: the sort is Python's, for each page by box_idx.

    A box without a page is on the first one.  A task sorts a page; pages follow each other in a window.
    """
    page, place = "__page", "__place"
    narrow = boxes.select("doc_id", F.coalesce("page_num", F.lit(0)).alias(page), "box_idx", "x0", "x1", "y0", "y1")
    schema = StructType([boxes.schema["doc_id"], StructField(page, IntegerType()), boxes.schema["box_idx"], StructField(place, IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, number, rows in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                rows = [r | {"page_num": 0} for r in rows]
                rows.sort(key=cmp_to_key(lambda a, b: -1 if precedes(a, b) else 1 if precedes(b, a) else 0))
                out += [(doc, number, r["box_idx"], i) for i, r in enumerate(rows)]
            types = (batch.schema.field(0).type, pa.int32(), batch.schema.field(2).type.value_type.field("box_idx").type, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [()] * 4, types, strict=True)], ["doc_id", page, "box_idx", place])

    pages = narrow.withColumn(page, F.col(page).cast("int")).groupBy("doc_id", page).agg(F.array_sort(F.collect_list(F.struct("box_idx", "x0", "x1", "y0", "y1"))).alias("rows"))
    placed = pages.mapInArrow(run, schema)
    order = Window.partitionBy("doc_id").orderBy(page, place)
    ranked = placed.select("doc_id", "box_idx", (F.row_number().over(order) - 1).cast("int").alias("order_idx"))
    return boxes.join(ranked, ["doc_id", "box_idx"]).select(*boxes.columns, "order_idx")


def merge_adjacency(boxes: DataFrame) -> DataFrame:
    """Pairs (i < j) of boxes of one page and label whose joint rectangle meets no box of another label.

    A self-join and an anti-join on (doc_id, page_num): bounded by the square of a page's boxes.
    """
    side = lambda s: boxes.select("doc_id", "page_num", *[F.col(c).alias(f"{s}_{c}") for c in ("box_idx", "label", "x0", "x1", "y0", "y1")])
    pairs = side("a").join(side("b"), ["doc_id", "page_num"]).filter("a_box_idx < b_box_idx AND a_label <=> b_label")
    pairs = pairs.selectExpr("doc_id", "page_num", "a_box_idx AS i", "b_box_idx AS j", "a_label AS label", "least(a_x0, b_x0) AS x0", "greatest(a_x1, b_x1) AS x1", "least(a_y0, b_y0) AS y0", "greatest(a_y1, b_y1) AS y1")
    block = side("o").withColumnsRenamed({"doc_id": "o_doc_id", "page_num": "o_page_num"})
    meets = F.expr("doc_id = o_doc_id AND page_num = o_page_num AND NOT (label <=> o_label) AND least(x1, o_x1) - greatest(x0, o_x0) > 0 AND least(y1, o_y1) - greatest(y0, o_y0) > 0")
    return pairs.join(block, meets, "left_anti").select("doc_id", "page_num", "label", "i", "j")


def merge_bbox(boxes: DataFrame, keys: Sequence[str] = ("doc_id", "page_num", "label")) -> DataFrame:
    """The rectangle around the boxes of each key."""
    return boxes.groupBy(*keys).agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.count(F.lit(1)).alias("n_boxes"))


def _members(bits: int) -> list[int]:
    out = []
    while bits:
        low = bits & -bits
        out.append(low.bit_length() - 1)
        bits ^= low
    return out


def _cliques(near: list[int]) -> Iterator[list[int]]:
    """Maximal cliques, by smallest member: Bron-Kerbosch with pivots on an explicit stack.

    near[i] and all sets are bit masks over the boxes.  Members with the same closed neighbourhood
    are in the same cliques, so one stands for all of them.
    """
    twins: dict[int, int] = {}
    for i, m in enumerate(near):
        twins[m | 1 << i] = twins.get(m | 1 << i, 0) | 1 << i
    first = sum(t & -t for t in twins.values())
    whole = {(t & -t).bit_length() - 1: t for t in twins.values()}
    stack = [(0, first, 0)] if near else []
    found = []
    while stack:
        chosen, open_, seen = stack.pop()
        if not open_:
            if not seen:
                found.append(sorted(_members(chosen)))
            continue
        pivot = max(_members(open_ | seen), key=lambda v: (near[v] & open_).bit_count())
        for v in _members(open_ & ~near[pivot]):
            stack.append((chosen | whole[v], open_ & near[v], seen & near[v]))
            open_, seen = open_ & ~(1 << v), seen | 1 << v
    return iter(sorted(found))


def merge_keys(rects: list[tuple[float, float, float, float]], labels: list) -> list[int]:
    """The group of each rectangle (x0, x1, y0, y1): rectangles merge where no other group lies between.

    Groups start as labels and are split into cliques of mergeable members until these are disjoint.
    """
    names: dict = {}
    keys = [names.setdefault(x, len(names)) for x in labels]
    r = np.array(rects, float).reshape(-1, 4)
    low, high = r[:, (0, 2)], r[:, (1, 3)]
    joint_low, joint_high = np.minimum(low[:, None], low[None]), np.maximum(high[:, None], high[None])
    while True:
        group = np.array(keys)
        near = []
        step = max(1, (1 << 20) // max(len(r), 1) ** 2)
        for lo in range(0, len(r), step):
            # rectangles that the joint ones of each i and each j meet, of another group than i
            some = slice(lo, lo + step)
            meets = (np.minimum(joint_high[some, :, None], high) > np.maximum(joint_low[some, :, None], low)).all(-1)
            free = ~(meets & (group != group[some, None])[:, None]).any(-1) & (group == group[some, None])
            free[np.arange(len(free)), np.arange(lo, lo + len(free))] = False
            near += [int.from_bytes(x.tobytes(), "little") for x in np.packbits(free, axis=1, bitorder="little")]
        taken: dict[int, int] = {}
        clash = False
        for number, clique in enumerate(_cliques(near)):
            for i in clique:
                clash |= i in taken
                taken.setdefault(i, number)
        keys = [taken[i] for i in range(len(rects))]
        if not clash:
            return keys


def merge_boxes(boxes: DataFrame) -> DataFrame:
    """doc_id, page_num, box_idx (of the first member), label, x0, x1, y0, y1, n_boxes of merged boxes.

    One task handles a page; a page's boxes bound its work.
    """
    schema = StructType([boxes.schema["doc_id"], boxes.schema["page_num"], boxes.schema["box_idx"], *StructType.fromDDL("label string, x0 double, x1 double, y0 double, y1 double, n_boxes bigint").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, page, rows in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                groups: dict[int, list[dict]] = {}
                for k, r in zip(merge_keys([tuple(r[c] for c in ("x0", "x1", "y0", "y1")) for r in rows], [r["label"] for r in rows]), rows, strict=True):
                    groups.setdefault(k, []).append(r)
                for g in groups.values():
                    side = lambda c, f, g=g: f((r[c] for r in g if r[c] is not None), default=None)
                    out.append((doc, page, g[0]["box_idx"], g[0]["label"], side("x0", min), side("x1", max), side("y0", min), side("y1", max), len(g)))
            types = (batch.schema.field(0).type, batch.schema.field(1).type, batch.schema.field(2).type.value_type.field("box_idx").type, pa.string(), *[pa.float64()] * 4, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [()] * 9, types, strict=True)], schema.fieldNames())

    pages = boxes.groupBy("doc_id", "page_num").agg(F.array_sort(F.collect_list(F.struct("box_idx", "x0", "x1", "y0", "y1", "label"))).alias("rows"))
    return pages.mapInArrow(run, schema)


def relative_positions(boxes: DataFrame, n: int = 64) -> DataFrame:
    """dx and dy for every ordered pair of boxes of a page, and both clamped to table positions.

    dx counts grid steps, dy lines of the upper box's height.  Boxes without height count as far
    below or above as the clamp allows, or level.
    """
    side = lambda s: boxes.select("doc_id", "page_num", *[F.col(c).alias(f"{s}_{c}") for c in ("box_idx", "x0", "y0", "y1")])
    pairs = side("q").join(side("k"), ["doc_id", "page_num"])
    pairs = pairs.selectExpr("*", "CASE WHEN k_y0 >= q_y0 THEN q_y1 - q_y0 ELSE k_y1 - k_y0 END AS ref", "k_y1 - q_y0 AS far", "k_y0 - q_y1 AS near")
    dy = f"""CASE WHEN far + 0.5D > 0 AND near + 0.5D > 0 THEN CASE WHEN ref = 0 THEN sign(least(far, near)) * {n} ELSE ceil(least(far, near) / ref + 0.5D) END
        WHEN far - 0.5D < 0 AND near - 0.5D < 0 THEN CASE WHEN ref = 0 THEN sign(greatest(far, near)) * {n} ELSE floor(greatest(far, near) / ref - 0.5D) END ELSE 0 END"""
    pairs = pairs.selectExpr("doc_id", "page_num", "q_box_idx AS i", "k_box_idx AS j", f"CAST((k_x0 - q_x0) * {n} AS INT) AS dx", f"CAST({dy} AS INT) AS dy")
    clamp = lambda c: f"greatest(least({n} div 2 + {c}, {n} - 1), 0)"
    return pairs.selectExpr("*", f"CAST({clamp('dx')} AS INT) AS dx_pos", f"CAST({clamp('dy')} AS INT) AS dy_pos")
