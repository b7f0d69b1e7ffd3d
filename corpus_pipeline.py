"""A corpus pipeline: toxic documents and copies go, sources are mixed to weight, texts are encoded.

Each stage takes the documents its predecessor kept, written as Parquet and read again.  In every
stage an empty table gives an empty table, columns beside those of documents stay, whatever their
names, and rows are told apart by id and text, so rows that repeat both count as one row.  One run at
a time in a process: a stage deletes the intermediate tables of the stage before it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgrid.llm import exact_dedup, jaccard_join, mixing, pieces, queries, storage
from leafgrid.runtime import importable_on_workers


_done: list[str] = []


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that first deletes the intermediate tables of the one before, whose result is written by then."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        importable_on_workers(spark)
        storage.release(spark, _done)
        _done.clear()
        before = set(storage.written())
        out = f(spark, docs, sf_dir)
        _done.extend(x for x in storage.written() if x not in before)
        return out

    return run_stage


@_stage
def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity chain does not reject; null and empty texts have no evidence and stay."""
    scored = queries.toxic_probabilities(spark, docs, sf_dir)
    return scored.filter(F.col("p_toxic") < 0.5).select(*docs.columns)


@_stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with equal text, blanks aside: the longest, then the smallest id; null counts as empty."""
    return exact_dedup.drop_copies(docs)


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingle similarity, five words and 80 per cent: the smallest id.

    Null texts and texts without words are linked with nothing and stay.
    """
    return jaccard_join.drop_near_copies(docs, k=5, percent=80)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, which may be not at all; a null source is a source."""
    return mixing.mix(docs)


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as pieces: doc_id, lang, source and tokens; null and empty texts have none, copies have equal ones."""
    return pieces.encode(docs).select("doc_id", "lang", "source", "tokens")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", keep_clean),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("pieces", encode),
]

#: The stages use trained models and keyed draws, which SQL can't express; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = storage.materialise(stage(spark, docs, sf_dir), name)
    return docs
