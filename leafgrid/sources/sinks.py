"""Writers: files, Parquet, pandas and iterators."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, overwrite: bool = False, rows_per_file: int | None = 8192, single: bool = False) -> None:
    """A folder of Parquet files of at most rows_per_file rows; with single, one file.

    Existing data is an error unless overwrite, which replaces it.
    """
    out = (df.coalesce(1) if single else df).write.mode("overwrite" if overwrite else "errorifexists")
    if rows_per_file and not single:
        out = out.option("maxRecordsPerFile", rows_per_file)
    out.parquet(path)


def write_files(df: DataFrame, path: str, id_col: str = "doc_id", content_col: str = "content", json_col: str | None = None, overwrite: bool = False, suffix: str = ".pdf") -> None:
    """``<id><suffix>`` for each document and, with json_col, ``<id>.json``, through the data source below."""
    columns = [F.col(id_col).cast("string").alias("id"), F.col(content_col).cast("binary").alias("content")]
    value = F.lit(None).cast("string") if json_col is None else F.col(json_col)
    if json_col is not None and df.schema[json_col].dataType.typeName() != "string":
        value = F.to_json(json_col)
    df.sparkSession.dataSource.register(_source())
    df.select(*columns, value.alias("json")).write.format("document_files").option("path", path).option("suffix", suffix).mode("overwrite" if overwrite else "append").save()


def _source():
    from .datasource import DocumentFiles

    return DocumentFiles


def to_pandas(df: DataFrame, dtypes: Mapping[str, str] | None = None) -> pd.DataFrame:
    """All rows on the driver: for results that fit there."""
    out = df.toPandas()
    return out.astype(dict(dtypes)) if dtypes else out


def to_iterable(df: DataFrame) -> Iterator[Row]:
    """Rows one partition at a time."""
    return df.toLocalIterator()
