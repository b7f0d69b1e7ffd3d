"""Readers: files, Parquet, pandas and plain iterables, all as lazy DataFrames."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterable
from functools import reduce
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..runtime import settle

FILENAME, CONTENT = "__FILENAME__", "__CONTENT__"


def _converted(df: DataFrame, converter: Callable[..., DataFrame] | None, kwargs: dict) -> DataFrame:
    """df through a converter of DataFrames; keyword arguments must be among its parameters."""
    if converter is None:
        if kwargs:
            raise TypeError(f"arguments without a converter: {', '.join(kwargs)}")
        return df
    known = inspect.signature(converter).parameters
    if not any(p.kind is p.VAR_KEYWORD for p in known.values()) and (odd := set(kwargs) - set(known)):
        raise TypeError(f"the converter has no argument {', '.join(sorted(odd))}")
    return converter(df, **kwargs)


def located(path: str, filesystem: str | None = None) -> str:
    """A path with its scheme; one that contradicts the file system given is refused."""
    scheme, _, rest = path.rpartition("://")
    if filesystem and scheme and scheme != filesystem:
        raise ValueError(f"{path} is not on {filesystem}")
    return f"{scheme or filesystem}://{rest}" if scheme or filesystem else path


def read_files(spark: SparkSession, path: str, recursive: bool = False, load_annotations: bool = False, require_annotations: bool = False, keep_ipynb_checkpoints: bool = False, pattern: str = "*.pdf", filesystem: str | None = None, converter: Callable[..., DataFrame] | None = None, **kwargs) -> DataFrame:
    """doc_id (path below the folder without extension), content and __FILENAME__ of each file.

    load_annotations adds the text of the JSON file with the same stem, null where there is none;
    require_annotations keeps only documents that have one.  An empty folder is an error.
    """
    at = located(path, filesystem)
    read = lambda glob: spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(at)
    base = at.rstrip("/").rpartition("://")[2].lstrip("/") + "/"
    stem = F.regexp_replace(F.substring_index(F.col("path"), base, -1), r"\.[^./]*$", "")
    files = read(pattern).select(stem.alias("doc_id"), "content", F.col("path").alias(FILENAME))
    if not keep_ipynb_checkpoints:
        files = files.filter(~F.contains(F.col(FILENAME), F.lit(".ipynb_checkpoints")))
    if files.select("doc_id").isEmpty():
        raise FileNotFoundError(f"no {pattern} in {path}")
    if load_annotations or require_annotations:
        sidecars = read("*.json").select(stem.alias("doc_id"), F.decode("content", "utf-8").alias("annotations"))
        files = files.join(sidecars, "doc_id", "inner" if require_annotations else "left")
    return _converted(files, converter, kwargs)


def match_files(spark: SparkSession, path: str, regex: str) -> DataFrame:
    """Files below a folder whose path matches a regular expression, without their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", "modificationTime").filter(F.col("path").rlike(regex))


def parse_annotations(files: DataFrame) -> DataFrame:
    """annotations(doc_id, page_num, src_idx, x0, x1, y0, y1, label) from JSON sidecars."""
    schema = "struct<annotations:array<struct<page:int,x0:double,x1:double,y0:double,y1:double,label:string>>>"
    each = files.select("doc_id", F.posexplode(F.from_json("annotations", schema)["annotations"]).alias("src_idx", "a"))
    return each.selectExpr("doc_id", "a.page AS page_num", "src_idx", "a.x0", "a.x1", "a.y0", "a.y1", "a.label")


def read_parquet(spark: SparkSession, path: str, converter: Callable[..., DataFrame] | None = None, filesystem: str | None = None, **kwargs) -> DataFrame:
    return _converted(spark.read.parquet(located(path, filesystem)), converter, kwargs)


def from_pandas(spark: SparkSession, data: pd.DataFrame, converter: Callable[..., DataFrame] | None = None, **kwargs) -> DataFrame:
    if not isinstance(data, pd.DataFrame):
        raise TypeError("from_pandas takes a pandas DataFrame")
    return _converted(spark.createDataFrame(data), converter, kwargs)


def from_iterable(spark: SparkSession, data: Iterable, schema: StructType | str | None = None, converter: Callable[..., DataFrame] | None = None, chunk: int = 10_000, **kwargs) -> DataFrame:
    """Rows (dicts or tuples) or raw documents (bytes) as a DataFrame.

    The driver holds chunk items at a time; an iterable of more is written to the shared folder
    piece by piece, with the schema of its first piece.
    """
    items, parts = iter(data), []
    while piece := list(islice(items, chunk)):
        if isinstance(piece[0], (bytes, bytearray)):
            piece, schema = [(bytes(x),) for x in piece], "content binary"
        part = spark.createDataFrame(piece, schema)
        schema = part.schema
        if parts or len(piece) == chunk:
            part = settle(part)
        parts.append(part)
    return _converted(reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema), converter, kwargs)


def ensure_frame(spark: SparkSession, data: DataFrame | pd.DataFrame | Iterable, schema: StructType | str | None = None) -> DataFrame:
    """Whatever is given as a DataFrame."""
    if isinstance(data, DataFrame):
        return data
    return from_pandas(spark, data) if isinstance(data, pd.DataFrame) else from_iterable(spark, data, schema)
