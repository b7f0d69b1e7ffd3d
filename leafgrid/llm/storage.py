"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only where a local session sets none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="leafgrid-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back.

    Cuts lineage, so that lost executors never repeat earlier stages, and fixes values such as row
    numbers that another evaluation could assign differently.  Shuffle files go when the write ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/leafgrid/{uuid.uuid4().hex}-{tag}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._leafgrid_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete materialised tables; call when no DataFrame that reads them will run again."""
    for df in tables:
        if (path := df._leafgrid_path) in _written:
            release(df.sparkSession, [path])


def written() -> list[str]:
    """The tables written so far."""
    return list(_written)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables; call when no DataFrame that reads them will run again."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        if path in _written:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
            _written.remove(path)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df lacks, for a helper column."""
    taken = {c.lower() for c in df.columns}
    while f"__{name}".lower() in taken:
        name += "_"
    return f"__{name}"


def row_key(id_col: str, text_col: str) -> Column:
    """A key of a row's id and text that needs no row numbers: the same however the table is read.

    Null and empty, and ids and texts that only join to the same string, have different keys.
    """
    doc = F.col(id_col).cast("string")
    return F.md5(F.concat(F.coalesce(F.concat(F.length(doc), F.lit(":"), doc), F.lit("-")), F.lit(":"), F.coalesce(F.concat(F.lit("="), F.col(text_col)), F.lit(""))))


def only_rows(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of docs whose row key is in keys (its only column), one for each key: of equal ids and texts the first by the other columns."""
    key = free_name(docs, "key")
    kept = docs.withColumn(key, row_key(id_col, text_col)).join(keys.toDF(key).hint("merge"), key, "left_semi")
    if any("map" in kind for _, kind in docs.dtypes):  # maps have no order
        return kept.dropDuplicates([key]).drop(key)
    order = [*(c for c in docs.columns if c not in (id_col, text_col)), id_col, text_col]
    each = kept.groupBy(key).agg(F.min(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(order)])).alias("row"))
    return each.select(*[F.col(f"row.c{order.index(c)}").alias(c) for c in docs.columns])
