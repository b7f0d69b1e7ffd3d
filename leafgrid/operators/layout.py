"""From characters to lines, from lines to blocks, and the order of blocks on a page.

Coordinates are in page units, y upwards.  Tables carry (doc_id, page_num) and a place within the page.
Where a page is one row with arrays (``*_in_pages``), nothing is shuffled; flat tables are gathered to pages
in one exchange.  A page bounds a row.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType
from pyspark.sql.window import Window

_PAGE = ("doc_id", "page_num")
_CHAR = ("pos", "x0", "x1", "y0", "y1", "ch")
_BLOCK = ("block", "x0", "x1", "y0", "y1", "n_lines")
Rect = tuple[float, float, float, float]


def pages_of_chars(chars: DataFrame) -> DataFrame:
    """One row a page: doc_id, page_num and arrays pos, x0, x1, y0, y1, ch, for chars(doc_id, page_num, pos, x0, x1, y0, y1, ch)."""
    each = chars.groupBy(*_PAGE).agg(F.array_sort(F.collect_list(F.struct(*_CHAR))).alias("c"))
    return each.select(*_PAGE, *[F.col(f"c.{k}").alias(k) for k in _CHAR])


def _numbers(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


def _nullable(values: np.ndarray) -> pa.Array:
    return pa.array(values, mask=np.isnan(values))


def lines_in_pages(pages: DataFrame, line_overlap: float = 0.5, char_margin: float = 2.05, word_margin: float = 0.1) -> DataFrame:
    """doc_id, page_num, lines (line_idx, x0, x1, y0, y1, text, n_chars) for pages with arrays of characters, see ``pages_of_chars``.

    A character goes on with the line of the one before it (by pos) if they overlap vertically by
    more than line_overlap of the lower one, and lie closer than char_margin of the wider one.  A gap
    of more than word_margin of its larger side puts a blank in front of it.  Lines of blanks alone
    are dropped; null coordinates start a line and add nothing to its rectangle.

    A page is a row and its characters are compared in its task: nothing is shuffled.
    """
    schema = StructType([*pages.select(*_PAGE).schema.fields, *StructType.fromDDL("lines array<struct<line_idx:int,x0:double,x1:double,y0:double,y1:double,text:string,n_chars:bigint>>").fields])

    def lines(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = {k: batch.column(i + 2) for i, k in enumerate(_CHAR)}
        bound = at["pos"].offsets.to_numpy().astype(np.int64)
        bound = bound - bound[0]
        each = {k: v.flatten() for k, v in at.items()}
        page = np.repeat(np.arange(len(batch)), np.diff(bound))
        pos = each["pos"].fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        if ((np.diff(pos) < 0) & (np.diff(page) == 0)).any():
            order = np.lexsort((pos, page))
            each = {k: v.take(pa.array(order)) for k, v in each.items()}
        x0, x1, y0, y1 = (_numbers(each[k]) for k in ("x0", "x1", "y0", "y1"))
        wide, high = x1 - x0, y1 - y0
        px0, px1, py0, py1 = x0[:-1], x1[:-1], y0[:-1], y1[:-1]
        cx0, cx1, cy0, cy1 = x0[1:], x1[1:], y0[1:], y1[1:]
        level = (py0 <= cy1) & (cy0 <= py1)
        shared = np.fmin(np.abs(py0 - cy1), np.abs(py1 - cy0))
        meet = (px0 <= cx1) & (cx0 <= px1)
        apart = np.where(meet, 0.0, np.fmin(np.abs(px0 - cx1), np.abs(px1 - cx0)))
        goes_on, spaced = np.zeros(len(page), bool), np.zeros(len(page), bool)
        goes_on[1:] = level & (np.fmin(high[1:], high[:-1]) * line_overlap < shared) & (apart < np.fmax(wide[1:], wide[:-1]) * char_margin) & (page[1:] == page[:-1])
        spaced[1:] = goes_on[1:] & (px1 < cx0 - word_margin * np.fmax(wide[1:], high[1:]))
        first = np.flatnonzero(~goes_on)
        own = page[first]
        until = np.searchsorted(own, np.arange(len(batch) + 1))
        piece = pc.binary_join_element_wise(pc.if_else(pa.array(spaced), " ", ""), each["ch"].fill_null(""), "")
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([*first, len(page)], pa.int32()), piece), "")
        if len(first):
            rect = [_nullable(f.reduceat(v, first)) for f, v in ((np.fmin, x0), (np.fmax, x1), (np.fmin, y0), (np.fmax, y1))]
        else:
            rect = [pa.array([], pa.float64())] * 4
        columns = [pa.array(np.arange(len(first)) - until[own], pa.int32()), *rect, text, pa.array(np.diff([*first, len(page)]), pa.int64())]
        rows = pa.StructArray.from_arrays(columns, [f.name for f in schema["lines"].dataType.elementType])
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(until, pa.int32()), rows)], [*_PAGE, "lines"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, 2):
                yield lines(part)

    found = pages.select(*_PAGE, *_CHAR).mapInArrow(run, schema)
    return found.withColumn("lines", F.filter("lines", lambda x: x["text"].rlike(r"[^\s\p{Z}]")))


def _parts(batch: pa.RecordBatch, column: int, most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """The rows in slices of about most elements of a list column, a row at least."""
    bound = batch.column(column).offsets.to_numpy()
    lo = 0
    while lo < len(batch):
        hi = max(int(np.searchsorted(bound, bound[lo] + most, "right")) - 1, lo + 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def lines_of_chars(chars: DataFrame, line_overlap: float = 0.5, char_margin: float = 2.05, word_margin: float = 0.1) -> DataFrame:
    """doc_id, page_num, line_idx, x0, x1, y0, y1, text, n_chars for chars(doc_id, page_num, pos, x0, x1, y0, y1, ch).

    Characters that lie anywhere meet by page in one exchange; see ``lines_in_pages``, which takes pages without one.
    """
    return lines_in_pages(pages_of_chars(chars), line_overlap, char_margin, word_margin).select(*_PAGE, F.inline("lines"))


def _near(line_idx: np.ndarray, x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray, line_margin: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of lines of a page where b lies near a, about as high and aligned left, right or centrally.

    Near is a's rectangle with line_margin of its height added above and below; other tolerances are
    as large.  Lines are sorted by their lower edge, so a is compared with those on its own height alone.
    """
    high = y1 - y0
    d = high * line_margin
    by = np.argsort(y0, kind="stable")
    slack = 1e-9 * (1 + np.abs(y0) + np.abs(y1))
    lo = np.searchsorted(y0[by], y0 - 2 * np.abs(d) - np.abs(high) - slack, "left")
    hi = np.searchsorted(y0[by], y1 + np.abs(d) + slack, "right")
    n = np.maximum(hi - lo, 0)
    n[np.isnan(high)] = 0
    a = np.repeat(np.arange(len(y0)), n)
    b = by[np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
    da = d[a]
    ok = (line_idx[a] != line_idx[b]) & (x1[b] > x0[a]) & (x0[b] < x1[a]) & (y1[b] > y0[a] - da) & (y0[b] < y1[a] + da) & (np.abs(high[b] - high[a]) <= da)
    ok &= (np.abs(x0[b] - x0[a]) <= da) | (np.abs(x1[b] - x1[a]) <= da) | (np.abs((x0[b] + x1[b]) / 2 - (x0[a] + x1[a]) / 2) <= da)
    return a[ok], b[ok]


def _least_linked(idx: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each place the least idx that links (a, b) reach from it."""
    above = list(range(len(idx)))

    def top(i: int) -> int:
        while above[i] != i:
            above[i] = above[above[i]]
            i = above[i]
        return i

    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        i, j = top(i), top(j)
        if i != j:
            i, j = (i, j) if idx[i] <= idx[j] else (j, i)
            above[j] = i
    return idx[[top(i) for i in range(len(idx))]] if len(idx) else idx


def blocks_in_pages(pages: DataFrame, line_margin: float = 0.5) -> DataFrame:
    """pages(doc_id, page_num, lines) whose lines have block: the first line_idx of the lines that neighbours connect (see ``_near``)."""
    line = pages.schema["lines"].dataType.elementType
    places = [line.fieldNames().index(c) for c in ("line_idx", "x0", "x1", "y0", "y1")]
    schema = StructType([*pages.select(*_PAGE).schema.fields, StructField("lines", ArrayType(StructType([*line.fields, StructField("block", line["line_idx"].dataType)])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bound = batch.column(2).offsets.to_numpy().astype(np.int64)
            bound = bound - bound[0]
            rows = batch.column(2).flatten()
            fields = rows.flatten()
            idx, rect = fields[places[0]].to_numpy(zero_copy_only=False), [_numbers(fields[k]) for k in places[1:]]
            found = [_least_linked(idx[lo:hi], *_near(idx[lo:hi], *(v[lo:hi] for v in rect), line_margin)) for lo, hi in zip(bound[:-1], bound[1:], strict=True)]
            block = pa.array(np.concatenate(found) if found else idx, fields[places[0]].type)
            out = pa.StructArray.from_arrays([*fields, block], [*line.fieldNames(), "block"])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(bound, pa.int32()), out)], [*_PAGE, "lines"])

    return pages.select(*_PAGE, "lines").mapInArrow(run, schema)


def pages_of_lines(lines: DataFrame) -> DataFrame:
    """One row a page: doc_id, page_num, lines; in one exchange by page."""
    return lines.groupBy(*_PAGE).agg(F.collect_list(F.struct(*[c for c in lines.columns if c not in _PAGE])).alias("lines"))


def blocks_of_lines(lines: DataFrame, line_margin: float = 0.5) -> DataFrame:
    """lines with block: the first line_idx of the lines that neighbours connect."""
    return blocks_in_pages(pages_of_lines(lines), line_margin).select(*_PAGE, F.inline("lines")).select(*lines.columns, "block")


def merge_order(rects: list[Rect], flow: float) -> list[int]:
    """The order of rectangles (x0, y0, x1, y1) on a page: their places in the list, first to last.

    The two groups whose joint rectangle wastes least area merge, again and again; pairs that have
    something between them wait until no other pair is left.  Of equal pairs the one made first goes
    first.  Within a group the part that lies further to the top left, by flow (-1: only left counts,
    1: only top), comes first.
    """
    live: dict[int, Rect] = dict(enumerate(rects))
    parts: dict[int, tuple[int, int]] = {}
    joint = lambda p, q: (min(p[0], q[0]), min(p[1], q[1]), max(p[2], q[2]), max(p[3], q[3]))
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])

    def entry(i: int, j: int) -> tuple[bool, float, int, int]:
        return False, area(joint(live[i], live[j])) - area(live[i]) - area(live[j]), i, j

    heap = [entry(i, j) for i in live for j in live if i < j]
    heapq.heapify(heap)
    number = len(rects)
    while heap:
        waits, waste, i, j = heapq.heappop(heap)
        if i not in live or j not in live:
            continue
        whole = joint(live[i], live[j])
        if not waits and any(k not in (i, j) and r[0] < whole[2] and r[2] > whole[0] and r[1] < whole[3] and r[3] > whole[1] for k, r in live.items()):
            heapq.heappush(heap, (True, waste, i, j))
            continue
        key = {k: (1 - flow) * live[k][0] - (1 + flow) * (live[k][1] + live[k][3]) for k in (i, j)}
        parts[number] = (i, j) if (key[i], i) <= (key[j], j) else (j, i)
        del live[i], live[j]
        live[number] = whole
        for k in [k for k in live if k != number]:
            heapq.heappush(heap, entry(k, number))
        number += 1
    out, stack = [], sorted(live)
    while stack:
        i = stack.pop()
        if i in parts:
            stack += reversed(parts[i])
        else:
            out.append(i)
    return out


def _order(pages: DataFrame, flow: float | None) -> DataFrame:
    """doc_id, page_num, block, x0, x1, y0, y1, n_lines, order_idx for pages(doc_id, page_num, b), b the blocks of a page."""
    schema = StructType([*pages.select(*_PAGE).schema.fields, *pages.schema["b"].dataType.elementType.fields, *StructType.fromDDL("order_idx int").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            out = []
            for r in rows:
                b = sorted(r["b"], key=lambda x: x["block"])
                for place, k in enumerate(merge_order([(x["x0"], x["y0"], x["x1"], x["y1"]) for x in b], flow)):
                    out.append({"doc_id": r["doc_id"], "page_num": r["page_num"], **b[k], "order_idx": place})
            yield pa.RecordBatch.from_pylist(out, pa.schema([batch.schema.field(0), batch.schema.field(1), *batch.schema.field(2).type.value_type, ("order_idx", pa.int32())]))

    return pages.select(*_PAGE, "b").mapInArrow(run, schema)


def block_order(blocks: DataFrame, flow: float | None = 0.5) -> DataFrame:
    """doc_id, page_num, block, x0, x1, y0, y1, n_lines, order_idx for lines with a block.

    With flow, blocks merge to groups by the area that their joint rectangles waste, and groups give
    the order (see ``merge_order``); the work of a page is bounded by the square of its blocks.
    Without, blocks go by their lower edge from the top, then from the left, in a window.
    """
    each = blocks.groupBy(*_PAGE, "block").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.count(F.lit(1)).alias("n_lines"))
    if flow is None:
        top = Window.partitionBy(*_PAGE).orderBy(F.desc("y0"), "x0", "block")
        return each.withColumn("order_idx", (F.row_number().over(top) - 1).cast("int"))
    return _order(each.groupBy(*_PAGE).agg(F.collect_list(F.struct(*_BLOCK)).alias("b")), flow)


def _rects_in_pages(pages: DataFrame) -> DataFrame:
    """pages(doc_id, page_num, lines with a block) with b: the blocks' rectangles and numbers of lines, by block; nothing is shuffled."""
    line = pages.schema["lines"].dataType.elementType
    places = [line.fieldNames().index(c) for c in _BLOCK[:-1]]
    kind = line["block"].dataType.simpleString()
    schema = StructType([*pages.schema.fields, *StructType.fromDDL(f"b array<struct<block:{kind},x0:double,x1:double,y0:double,y1:double,n_lines:bigint>>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("lines")
            bound = batch.column(at).offsets.to_numpy().astype(np.int64)
            fields = batch.column(at).flatten().flatten()
            page, block = np.repeat(np.arange(len(batch)), np.diff(bound)), fields[places[0]].to_numpy(zero_copy_only=False)
            by = np.lexsort((block, page))
            page, block = page[by], block[by]
            first = np.flatnonzero(np.r_[True, (np.diff(page) != 0) | (np.diff(block) != 0)]) if len(by) else np.zeros(0, int)
            rect = [_nullable(f.reduceat(_numbers(fields[k])[by], first)) if len(by) else pa.array([], pa.float64()) for f, k in zip((np.fmin, np.fmax, np.fmin, np.fmax), places[1:], strict=True)]
            out = pa.StructArray.from_arrays([pa.array(block[first], fields[places[0]].type), *rect, pa.array(np.diff([*first, len(by)]), pa.int64())], list(_BLOCK))
            until = pa.array(np.searchsorted(page[first], np.arange(len(batch) + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(until, out)], [*batch.schema.names, "b"])

    return pages.mapInArrow(run, schema)


def order_in_pages(pages: DataFrame, flow: float = 0.5) -> DataFrame:
    """``block_order`` of pages(doc_id, page_num, lines with a block): a page is a row, nothing is shuffled."""
    return _order(_rects_in_pages(pages.select(*_PAGE, "lines")), flow)


def lines_of_pages_in_order(pages: DataFrame) -> DataFrame:
    """doc_id, page_num, block, box_idx, text of pages(doc_id, page_num, lines with a block), one row a page.

    Blocks go by their lower edge from the top, then from the left; their lines from the top.  A
    page's lines are sorted in its row; the one exchange carries pages to their document for the
    number of lines before them.
    """
    line = pages.schema["lines"].dataType.elementType
    places = [line.fieldNames().index(c) for c in ("block", "line_idx", "x0", "y0", "y1", "text")]
    schema = StructType([*pages.select(*_PAGE).schema.fields, StructField("s", ArrayType(StructType([StructField("block", line["block"].dataType), *StructType.fromDDL("text string").fields])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bound = batch.column(2).offsets.to_numpy().astype(np.int64)
            bound = bound - bound[0]
            fields = batch.column(2).flatten().flatten()
            page = np.repeat(np.arange(len(batch)), np.diff(bound))
            block, idx = (fields[k].to_numpy(zero_copy_only=False) for k in places[:2])
            x0, y0, y1 = (_numbers(fields[k]) for k in places[2:5])
            by = np.lexsort((block, page))
            first = np.flatnonzero(np.r_[True, (np.diff(page[by]) != 0) | (np.diff(block[by]) != 0)]) if len(by) else by
            left, low = np.empty(len(by)), np.empty(len(by))
            if len(by):
                n = np.diff([*first, len(by)])
                left[by], low[by] = (np.repeat(np.fmin.reduceat(v[by], first), n) for v in (x0, y0))
            order = pa.array(np.lexsort((idx, -y1, block, np.where(np.isnan(left), -np.inf, left), -low, page)))
            out = pa.StructArray.from_arrays([fields[places[0]].take(order), fields[places[5]].take(order)], ["block", "text"])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(bound, pa.int32()), out)], [*_PAGE, "s"])

    slim = pages.select(*_PAGE, "lines").mapInArrow(run, schema).filter(F.size("s") > 0)
    before = F.sum(F.size("s")).over(Window.partitionBy("doc_id").orderBy("page_num").rowsBetween(Window.unboundedPreceding, -1))
    out = slim.withColumn("before", F.coalesce(before, F.lit(0))).select(*_PAGE, "before", F.posexplode("s").alias("i", "x"))
    return out.select(*_PAGE, "x.block", (F.col("before") + F.col("i")).cast("int").alias("box_idx"), "x.text")


def lines_in_order(blocks: DataFrame, order: DataFrame) -> DataFrame:
    """Lines with box_idx, their place in the document: by page, by the order of blocks, from the top."""
    rows = blocks.join(order.select(*_PAGE, "block", "order_idx"), [*_PAGE, "block"])
    place = Window.partitionBy("doc_id").orderBy("page_num", "order_idx", F.desc("y1"), "line_idx")
    return rows.withColumn("box_idx", (F.row_number().over(place) - 1).cast("int"))
