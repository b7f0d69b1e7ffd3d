"""From raw documents to boxes: style runs, page filters, error policy and PDF readers."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .geometry import precedes
from .layout import _parts

#: One line of text as an extractor gives it: page, rectangle in page units (y upwards), text, styles.
Line = tuple[int, float, float, float, float, str, list[dict]]
Extractor = Callable[[bytes], tuple[list[tuple[float, float]], list[Line]]]
_extractors: dict[str, Extractor] = {}
EXTRACTED = "doc_id string, page_num int, box_idx int, x0 double, x1 double, y0 double, y1 double, label string, text string, props array<struct<italic:boolean,bold:boolean,begin:int,end:int,fontname:string>>, width double, height double, error boolean, num_pages int"


class DocumentError(Exception):
    """A document that can't be parsed."""


def extractor(name: str) -> Callable[[Extractor], Extractor]:
    """Register an extractor under a name."""

    def add(f: Extractor) -> Extractor:
        _extractors[name] = f
        return f

    return add


def normalise_boxes(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Boxes in shares of their page, y downwards, without empty ones and those that leave the page."""
    rows = lines.join(pages.select("doc_id", "page_num", "width", "height"), ["doc_id", "page_num"])
    rows = rows.withColumns({"x0": F.col("x0") / F.col("width"), "x1": F.col("x1") / F.col("width"), "y0": 1 - F.col("y1") / F.col("height"), "y1": 1 - F.col("y0") / F.col("height")})
    return rows.drop("width", "height").filter("length(text) > 0 AND x0 >= 0 AND y0 >= 0 AND x1 <= 1 AND y1 <= 1")


def style_runs(chars: DataFrame) -> DataFrame:
    """doc_id, box_idx, run, begin, end, fontname, italic, bold for chars(doc_id, box_idx, pos, ch, fontname, upright).

    Blanks take the style before them, do not lengthen a run, and neither lead a text nor follow
    each other; leading blanks open a run without style.  Windows are bounded by one line.
    """
    line = Window.partitionBy("doc_id", "box_idx").orderBy("pos")
    upto, before = line.rowsBetween(Window.unboundedPreceding, 0), line.rowsBetween(Window.unboundedPreceding, -1)
    rows = chars.withColumn("blank", F.col("ch").rlike(r"^\s$"))
    rows = rows.withColumn("kept", ~F.col("blank") | F.coalesce(~F.lag("blank").over(line), F.lit(False)))
    style = F.when(~F.col("blank"), F.struct(F.col("fontname"), (~F.col("upright") | F.contains(F.lower("fontname"), F.lit("italic"))).alias("italic"), F.contains(F.lower("fontname"), F.lit("bold")).alias("bold")))
    rows = rows.withColumn("style", F.last(style, ignorenulls=True).over(upto))
    rows = rows.withColumn("at", F.coalesce(F.sum(F.col("kept").cast("int")).over(before), F.lit(0)))
    new = F.lag(F.lit(1)).over(line).isNull() | ~F.col("style").eqNullSafe(F.lag("style").over(line))
    rows = rows.withColumn("run", F.sum(new.cast("int")).over(upto) - 1)
    runs = rows.groupBy("doc_id", "box_idx", "run").agg(F.min("at").alias("begin"), F.max(F.when(~F.col("blank"), F.col("at") + 1)).alias("end"), F.first("style").alias("style"))
    return runs.select("doc_id", "box_idx", F.col("run").cast("int").alias("run"), F.col("begin").cast("int").alias("begin"), F.coalesce("end", "begin").cast("int").alias("end"), "style.fontname", "style.italic", "style.bold")


def style_runs_in_lines(lines: DataFrame) -> DataFrame:
    """``style_runs`` for lines(doc_id, box_idx, ch, fontname, upright), a line's characters as arrays in its row; no character is null.

    Runs are found where the line lies: nothing is shuffled.
    """
    keys = ("doc_id", "box_idx")
    schema = StructType([*lines.select(*keys).schema.fields, *StructType.fromDDL("run int, begin int, end int, fontname string, italic boolean, bold boolean").fields])

    def runs(batch: pa.RecordBatch) -> pa.RecordBatch:
        bound = batch.column(2).offsets.to_numpy().astype(np.int64)
        ch, font, upright = (batch.column(i).flatten() for i in (2, 3, 4))
        line = np.repeat(np.arange(len(batch)), np.diff(bound))
        blank = pc.is_in(ch, pa.array([" ", "\t", "\n", "\x0b", "\f", "\r"])).to_numpy(zero_copy_only=False)
        coded = font.dictionary_encode()
        names = coded.dictionary.to_pylist()
        code = coded.indices.fill_null(len(names)).to_numpy(zero_copy_only=False).astype(np.int64)
        slanted = np.array([*("italic" in x.lower() for x in names), False])[code]
        # italic: 0 no, 1 yes, 2 unknown
        straight = pc.if_else(pc.is_null(upright), 2, pc.if_else(upright, 0, 1)).to_numpy(zero_copy_only=False)
        italic = np.where(slanted | (straight == 1), 1, np.where((code == len(names)) | (straight == 2), 2, 0))
        starts = np.r_[True, np.diff(line) != 0] if len(line) else np.zeros(0, bool)
        at = np.arange(len(line))
        opened = np.maximum.accumulate(np.where(starts, at, 0)) if len(line) else at
        source = np.maximum.accumulate(np.where(blank, -1, at)) if len(line) else at
        style = np.where(source >= opened, (code * 3 + italic)[source], -1) if len(line) else at
        kept = ~blank
        kept[1:] |= ~starts[1:] & ~blank[:-1]
        spot = np.cumsum(kept) - kept
        spot = spot - spot[opened]
        new = starts.copy()
        new[1:] |= style[1:] != style[:-1]
        first = np.flatnonzero(new)
        number = np.cumsum(new)
        end = np.maximum.reduceat(np.where(blank, -1, spot + 1), first) if len(first) else at
        begin, style = spot[first], style[first]
        f = np.where(style < 0, len(names), style // 3)
        named = pa.array([*names, None], pa.string()).take(pa.array(f))
        heavy = pa.array([*("bold" in x.lower() for x in names), None], pa.bool_()).take(pa.array(f))
        slant = pa.array([False, True, None], pa.bool_()).take(pa.array(np.where(style < 0, 2, style % 3)))
        own = pa.array(line[first])
        columns = [batch.column(0).take(own), batch.column(1).take(own), *(pa.array(x, pa.int32()) for x in ((number - number[opened])[first], begin, np.where(end < 0, begin, end))), named, slant, heavy]
        return pa.RecordBatch.from_arrays(columns, schema.fieldNames())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, 2):
                yield runs(part)

    return lines.select(*keys, "ch", "fontname", "upright").mapInArrow(run, schema)


@extractor("plain-pdf")
def read_plain_pdf(content: bytes) -> tuple[list[tuple[float, float]], list[Line]]:
    """A small reader of simple PDFs: FlateDecode or plain content streams with Td, Tm, TL, T*, Tj and TJ.

    No encrypted files, object streams or font encodings; each shown string is a line whose width is
    estimated at half its font size a character.
    """
    if not content.startswith(b"%PDF"):
        raise DocumentError("not a PDF")
    objects = {int(m[1]): m[2] for m in re.finditer(rb"(\d+)\s+\d+\s+obj\b(.*?)endobj", content, re.S)}
    fonts = {}
    for body in objects.values():
        for name, ref in re.findall(rb"/(\w+)\s+(\d+)\s+0\s+R", body):
            if m := re.search(rb"/BaseFont\s*/([^\s/>]+)", objects.get(int(ref), b"")):
                fonts[name] = m[1].decode("latin-1")
    pages, lines = [], []
    for number in sorted(n for n, b in objects.items() if re.search(rb"/Type\s*/Page\b", b)):
        body = objects[number]
        box = re.search(rb"/MediaBox\s*\[\s*([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)", body + b"".join(b for b in objects.values() if re.search(rb"/Type\s*/Pages\b", b)))
        width, height = (float(box[3]) - float(box[1]), float(box[4]) - float(box[2])) if box else (612.0, 792.0)
        pages.append((width, height))
        refs = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+0\s+R)", body)
        for ref in re.findall(rb"(\d+)\s+0\s+R", refs[1] if refs else b""):
            lines += _shown(_stream(objects.get(int(ref), b"")), fonts, len(pages) - 1)
    return pages, lines


def _stream(body: bytes) -> bytes:
    m = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", body, re.S)
    if not m:
        return b""
    try:
        return zlib.decompress(m[1]) if b"/FlateDecode" in body else m[1]
    except zlib.error as e:
        raise DocumentError(str(e)) from e


_TOKEN = re.compile(rb"\((?:\\.|[^\\()])*\)|/[\w.+-]+|\[|\]|[-+]?\d*\.?\d+|[A-Za-z*'\"]+")


def _shown(stream: bytes, fonts: dict[bytes, str], page: int) -> Iterator[Line]:
    stack: list = []
    x = y = lead = 0.0
    size, font = 12.0, ""
    for token in _TOKEN.findall(stream):
        if token[:1] in b"([/" or token in (b"]",) or re.fullmatch(rb"[-+]?\d*\.?\d+", token):
            stack.append(token)
            continue
        nums = [float(t) for t in stack if re.fullmatch(rb"[-+]?\d*\.?\d+", t)]
        if token == b"BT":
            x = y = 0.0
        elif token == b"Tf" and nums:
            size, font = nums[-1], fonts.get(next((t[1:] for t in stack if t[:1] == b"/"), b""), "")
        elif token in (b"Td", b"TD") and len(nums) >= 2:
            x, y = x + nums[-2], y + nums[-1]
            lead = -nums[-1] if token == b"TD" else lead
        elif token == b"Tm" and len(nums) >= 6:
            x, y = nums[-2:]
        elif token == b"TL" and nums:
            lead = nums[-1]
        elif token in (b"T*", b"'"):
            y -= lead
        if token in (b"Tj", b"TJ", b"'"):
            raw = b"".join(t[1:-1] for t in stack if t[:1] == b"(")
            text = re.sub(rb"\\([()\\])", rb"\1", raw).decode("latin-1")
            text = re.sub(r"\s+", " ", text).strip()
            low = font.lower()
            style = {"italic": "italic" in low or "oblique" in low, "bold": "bold" in low, "begin": 0, "end": len(text), "fontname": font}
            yield page, x, x + len(text) * size / 2, y, y + size, text, [style]
        stack = []


def extract_boxes(docs: DataFrame, name: str = "plain-pdf", extract_style: bool = False, raise_on_error: bool = False) -> DataFrame:
    """Boxes of docs(doc_id, content), page-normalised and in reading order within each page.

    A document that can't be parsed gives one row with error = true and no box; with raise_on_error
    the job fails.  Each document is parsed where it lies; nothing is shuffled.
    """
    read = _extractors[name]

    def boxes_of(doc_id: str, content: bytes) -> Iterator[tuple]:
        try:
            pages, lines = read(bytes(content) if content is not None else b"")
        except DocumentError:
            if raise_on_error:
                raise
            yield (doc_id, *[None] * 11, True, 0)
            return
        rows = []
        for page, x0, x1, y0, y1, text, props in lines:
            w, h = pages[page]
            r = {"page_num": page, "x0": x0 / w, "x1": x1 / w, "y0": 1 - y1 / h, "y1": 1 - y0 / h, "text": text, "props": props if extract_style else [], "w": w, "h": h}
            if text and r["x0"] >= 0 and r["y0"] >= 0 and r["x1"] <= 1 and r["y1"] <= 1:
                rows.append(r)
        from functools import cmp_to_key

        rows.sort(key=cmp_to_key(lambda a, b: -1 if precedes(a, b) else 1 if precedes(b, a) else 0))
        if not rows:
            yield (doc_id, *[None] * 11, False, len(pages))
        for i, r in enumerate(rows):
            yield doc_id, r["page_num"], i, r["x0"], r["x1"], r["y0"], r["y1"], None, r["text"], r["props"], r["w"], r["h"], False, len(pages)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in re.split(r", (?=\w+ (?:string|int|double|array|boolean))", EXTRACTED)]
        for pdf in batches:
            out = pd.DataFrame([r for d, c in zip(pdf["doc_id"], pdf["content"], strict=True) for r in boxes_of(d, c)], columns=names)
            for c in ("page_num", "box_idx"):
                out[c] = out[c].astype("Int32")
            yield out

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("content").cast("binary").alias("content")).mapInPandas(run, EXTRACTED)


def error_policy(docs: DataFrame, valid: str, on_error: str = "flag") -> DataFrame:
    """Adds error where the expression valid does not hold; with on_error = 'raise' the job fails there."""
    ok = F.coalesce(F.expr(valid), F.lit(False))
    if on_error == "raise":
        return docs.withColumn("error", F.when(ok, F.lit(False)).otherwise(F.raise_error(F.lit("document can't be parsed")).cast("boolean")))
    return docs.withColumn("error", ~ok)


def ensure_doc(rows: DataFrame, content_col: str = "content", id_col: str | None = "id", filename_col: str | None = None) -> DataFrame:
    """doc_id and content: the id, else the file name, else the SHA-256 of the content."""
    given = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in (id_col, filename_col) if c]
    return rows.withColumn("doc_id", F.coalesce(*given, F.sha2(F.col(content_col).cast("binary"), 256)))


def summarise_annotations(boxes: DataFrame) -> DataFrame:
    """Boxes and covered area for each document, page and label: what a drawing of them would show."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return boxes.groupBy("doc_id", "page_num", "label").agg(F.count(F.lit(1)).alias("n_boxes"), F.sum(area).alias("area"))
