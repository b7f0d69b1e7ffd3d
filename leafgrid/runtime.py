"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

HOME = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def importable_on_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did, if it isn't installed there."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if HOME not in paths:
        env["PYTHONPATH"] = os.pathsep.join([HOME, *paths])


def settle(df: DataFrame) -> DataFrame:
    """df written once to the shared folder of ``spark.checkpoint.dir`` and read again, which cuts its lineage.

    A session that sets none gets a temporary folder if it is local, and an error otherwise.  Tables go when the session ends.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="leafgrid-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/leafgrid/{uuid.uuid4().hex}")
    df.write.parquet(path.toString())
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(path.toString())


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file on any file system that Spark reaches; it takes its name when it is whole."""
    part, files = _file(spark, path + ".part")
    out = files.create(part, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    at, _ = _file(spark, path)
    files.delete(at, False)
    if not files.rename(part, at):
        raise OSError(f"{path} could not be written")


def read_text(spark: SparkSession, path: str) -> str:
    at, files = _file(spark, path)
    stream = files.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()
