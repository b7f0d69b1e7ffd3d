"""Readers, writers, the document data source, the extractor and pipelines, on files made here."""

import json
import zlib

import pandas as pd
import pytest
from pyspark.errors import PySparkException

from leafgrid.functions import collections
from leafgrid.operators import extract, geometry
from leafgrid.plans import pipeline
from leafgrid.sources import readers, sinks

STREAM = b"BT /F1 10 Tf 50 700 Td (Upper line) Tj 0 -100 Td (Lower \\(bold\\)) Tj ET BT /F1 10 Tf 50 900 Td (off the page) Tj ET"


def pdf(packed: bool = True) -> bytes:
    body = zlib.compress(STREAM) if packed else STREAM
    kind = b"/Filter /FlateDecode " if packed else b""
    return (
        b"%PDF-1.4\n1 0 obj << /Type /Page /MediaBox [0 0 600 800] /Contents 2 0 R /Resources << /Font << /F1 3 0 R >> >> >> endobj\n"
        b"2 0 obj << " + kind + b"/Length " + str(len(body)).encode() + b" >> stream\n" + body + b"\nendstream endobj\n"
        b"3 0 obj << /Type /Font /BaseFont /Courier-Bold >> endobj\n%%EOF"
    )


@pytest.fixture
def folder(tmp_path):
    for name, content in {"a.pdf": pdf(), "sub/b.pdf": pdf(False), "c.pdf": b"plain text", ".ipynb_checkpoints/a.pdf": pdf(), "note.txt": b"x"}.items():
        at = tmp_path / "docs" / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(content)
    side = {"note_id": "a", "annotations": [{"page": 0, "x0": 0, "x1": 1, "y0": 0, "y1": 0.5, "label": "body"}, {"page": None, "x0": 0, "x1": 1, "y0": 0, "y1": 1, "label": "rest"}]}
    (tmp_path / "docs" / "a.json").write_text(json.dumps(side))
    return str(tmp_path / "docs")


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_read_files(spark, folder, tmp_path):
    assert ids(readers.read_files(spark, folder)) == ["a", "c"]
    assert ids(readers.read_files(spark, folder, recursive=True)) == ["a", "c", "sub/b"]
    assert len(ids(readers.read_files(spark, folder, recursive=True, keep_ipynb_checkpoints=True))) >= 3
    assert ids(readers.read_files(spark, folder, require_annotations=True)) == ["a"]
    both = readers.read_files(spark, folder, load_annotations=True)
    assert {r.doc_id: r.annotations is None for r in both.collect()} == {"a": False, "c": True}
    found = readers.parse_annotations(both.filter("annotations IS NOT NULL")).orderBy("src_idx").collect()
    assert [(r.page_num, r.src_idx, r.label) for r in found] == [(0, 0, "body"), (None, 1, "rest")]
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        readers.read_files(spark, str(tmp_path / "none"))
    assert readers.match_files(spark, folder, r"b\.pdf$").count() == 1


def test_located():
    assert readers.located("/x") == "/x" and readers.located("/x", "file") == "file:///x" and readers.located("file:///x", "file") == "file:///x"
    with pytest.raises(ValueError):
        readers.located("s3://x", "file")


def test_tables_and_converters(spark, tmp_path):
    df = readers.from_pandas(spark, pd.DataFrame({"doc_id": ["x", "y"], "n": [1, 2]}))
    at = str(tmp_path / "t")
    sinks.write_parquet(df, at, rows_per_file=1)
    with pytest.raises(PySparkException):
        sinks.write_parquet(df, at)
    sinks.write_parquet(df.limit(1), at, overwrite=True, single=True)
    keep = lambda d, least: d.filter(f"n >= {least}")
    assert readers.read_parquet(spark, at, keep, least=1).count() == 1
    with pytest.raises(TypeError):
        readers.read_parquet(spark, at, keep, most=1)
    with pytest.raises(TypeError):
        readers.read_parquet(spark, at, least=1)
    with pytest.raises(TypeError):
        readers.from_pandas(spark, [1])
    assert readers.from_iterable(spark, [b"one", b"two"]).columns == ["content"]
    assert readers.from_iterable(spark, iter([(1, "a")]), "doc_id int, text string").first().text == "a"
    assert readers.ensure_frame(spark, df) is df
    assert sorted(r.n for r in sinks.to_iterable(df)) == [1, 2] and sinks.to_pandas(df, {"n": "float64"})["n"].dtype == "float64"


def test_write_files(spark, tmp_path):
    at = str(tmp_path / "out")
    rows = [("a", b"one", {"k": 1}), ("sub/b", b"two", None)]
    df = spark.createDataFrame(rows, "doc_id string, content binary, meta map<string,int>")
    sinks.write_files(df, at, json_col="meta")
    found = spark.read.format("document_files").option("path", at).load()
    assert {r.id: (bytes(r.content), r.json) for r in found.collect()} == {"a": (b"one", '{"k":1}'), "sub/b": (b"two", None)}
    with pytest.raises(PySparkException):
        sinks.write_files(df, at)
    sinks.write_files(df.filter("doc_id = 'a'"), at, overwrite=True)
    assert [r.id for r in found.sparkSession.read.format("document_files").option("path", at).load().collect()] == ["a"]
    for bad in ("../out of it", "/tmp/elsewhere", "a/../../b", ""):
        with pytest.raises(PySparkException):
            sinks.write_files(spark.createDataFrame([(bad, b"x")], "doc_id string, content binary"), str(tmp_path / "safe"))


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_document_files_on_schemes(spark, tmp_path, scheme):
    """Written, read back, refused where data lies, replaced whole, and left alone by a job that fails."""
    at = f"{scheme}{tmp_path}/out"
    read = lambda: {(r.id, bytes(r.content), r.json) for r in spark.read.format("document_files").option("path", at).load().collect()}
    rows = [(f"d{i % 3}/{i}", f"body {i}".encode(), f'{{"n": {i}}}' if i % 2 else None) for i in range(150)]
    table = spark.createDataFrame(rows, "doc_id string, content binary, note string").repartition(5)
    sinks.write_files(table, at, json_col="note")
    assert read() == set(rows)
    with pytest.raises(PySparkException):
        sinks.write_files(table, at)
    sinks.write_files(table.limit(2), at, overwrite=True)
    kept = read()
    assert len(kept) == 2
    with pytest.raises(PySparkException):
        sinks.write_files(spark.createDataFrame([("ok", b"x"), ("../bad", b"y")], "doc_id string, content binary"), at, overwrite=True)
    assert read() == kept and sorted(x.name for x in tmp_path.iterdir()) == ["out"]
    assert spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(at).count() == 2


def test_iterables_of_many_pieces(spark):
    found = readers.from_iterable(spark, ((i, f"t{i}") for i in range(25)), "doc_id int, text string", chunk=10)
    assert sorted(map(tuple, found.collect())) == [(i, f"t{i}") for i in range(25)]
    assert readers.from_iterable(spark, iter([b"a", b"b", b"c"]), chunk=2).count() == 3
    assert readers.from_iterable(spark, [], "doc_id int").count() == 0


def test_extract(spark, folder):
    docs = readers.read_files(spark, folder, recursive=True)
    found = extract.extract_boxes(docs, extract_style=True).orderBy("doc_id", "box_idx").collect()
    assert [(r.doc_id, r.box_idx, r.text, r.error) for r in found] == [
        ("a", 0, "Upper line", False), ("a", 1, "Lower (bold)", False), ("c", None, None, True), ("sub/b", 0, "Upper line", False), ("sub/b", 1, "Lower (bold)", False),
    ]
    upper = found[0]
    assert upper.page_num == 0 and upper.num_pages == 1 and abs(upper.x0 - 50 / 600) < 1e-9 and abs(upper.y1 - 100 / 800) < 1e-9
    assert [(p.begin, p.end, p.bold, p.italic) for p in upper.props] == [(0, 10, True, False)]
    with pytest.raises(PySparkException):
        extract.extract_boxes(docs, raise_on_error=True).collect()


def slow_cliques(near):
    n = len(near)
    ok = [s for s in range(1, 1 << n) if all(s & ~(near[i] | 1 << i) == 0 for i in range(n) if s >> i & 1)]
    return sorted([i for i in range(n) if s >> i & 1] for s in ok if not any(s != t and s & t == s for t in ok))


def test_cliques_by_brute_force():
    import random

    rng = random.Random(3)
    for n in [0, 1, 2, *[rng.randint(3, 7) for _ in range(60)]]:
        near = [0] * n
        for i in range(n):
            for j in range(i):
                if rng.random() < 0.6:
                    near[i] |= 1 << j
                    near[j] |= 1 << i
        assert list(geometry._cliques(near)) == slow_cliques(near)


def test_pipeline(spark, tmp_path):
    p = pipeline.Pipeline()
    p.add_pipe("dummy-classifier", "first", {"label": "body"})
    p.add_pipe("mask-classifier", "mask", {"x0": 0, "y0": 0, "x1": 1, "y1": 0.5, "threshold": 0.5}, before="first")
    assert p.pipe_names == ["mask", "first"] and p.has_pipe("mask") and not p.has_pipe("x")
    for bad in (lambda: p.add_pipe("dummy-classifier", "first"), lambda: p.add_pipe("nothing"), lambda: p.add_pipe("dummy-classifier", "z", {"odd": 1}), lambda: p.add_pipe("dummy-classifier", "z", first=True, after="mask"), lambda: p.get_pipe("z")):
        with pytest.raises(ValueError):
            bad()
    boxes = spark.createDataFrame([("d", 0, 0, 0.1, 0.4, 0.1, 0.2, None, "t"), ("d", 0, 1, 0.1, 0.4, 0.7, 0.8, None, "u")], "doc_id string, page_num int, box_idx int, x0 double, x1 double, y0 double, y1 double, label string, text string")
    labels = lambda made: [r.label for r in made(boxes).orderBy("box_idx").collect()]
    assert labels(p) == ["body", "body"]
    with p.select_pipes(disable=["first"]):
        assert p.disabled == ["first"] and labels(p) == ["body", "pollution"]
    with pytest.raises(ValueError), p.select_pipes(enable=["z"]):
        pass
    at = str(tmp_path / "p.json")
    p.to_disk(at)
    again = pipeline.Pipeline.from_disk(at, {"first.label": "other"})
    assert again.pipe_names == p.pipe_names and labels(again) == ["other", "other"]
    with pytest.raises(ValueError):
        pipeline.load({"components": {"x": {"@factory": "nothing"}}})


def test_collections(spark):
    nested = {"a": {"b": 1, "c": {"d": 2}}, "e": 3}
    flat = {"a/b": 1, "a/c/d": 2, "e": 3}
    assert collections.flatten_dict(nested) == flat and collections.nest_dict(flat) == nested
    assert collections.nest_dict({"x|y/z": 1}) == {"x": 1, "y": {"z": 1}}
    assert list(collections.flatten([1, [2, [3]], []])) == [1, 2, 3]
    value = {"a": [{"b": 1}]}
    collections.set_deep_attr(value, "a.0.b", 5)
    assert collections.get_deep_attr(value, "a.0.b") == 5
    rows = [{"a": 1, "b": 2}, {"a": 3, "c": 4}]
    assert collections.rows_to_columns(rows) == {"a": [1, 3], "b": [2, None]} and collections.columns_to_rows({"a": [1, 2]}) == [{"a": 1}, {"a": 2}]
    df = spark.sql("SELECT named_struct('x', 1, 'y', named_struct('z', 2)) AS s, 3 AS t")
    assert collections.flatten_structs(df).columns == ["s/x", "s/y/z", "t"]
    assert collections.nest_columns(collections.flatten_structs(df)).first().asDict(True) == {"s": {"x": 1, "y": {"z": 2}}, "t": 3}
