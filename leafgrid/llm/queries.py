"""The registered queries of this subpackage: thin digests over the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, fill_in_middle, language_id, mixing, pieces, pii, toxicity
from .exact_dedup import exact_dedup
from .jaccard_join import jaccard_join
from .oracles import ORACLES
from .quality_rules import quality_rules
from .secret_scan import RULES, extend_ledger, scan_secrets
from .substring_dedup import repeated_windows
from .winnowing import contamination


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _joined(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined in their order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_copies(_documents(spark, sf_dir)).drop("row_key")


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(_documents(spark, sf_dir))


def toxic_probabilities(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with p_low_quality and p_toxic: low quality first, since junk looks unlike prose."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumn("low_quality", 1 - F.col("quality"))
    train = _documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.train_chain(train, labels, ["low_quality", "toxic"]))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    found = toxic_probabilities(spark, docs, sf_dir).drop("text")
    return found.withColumn("toxic_pred", F.col("p_toxic") >= 0.5)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    profiles = language_id.train_profiles(docs.filter(~language_id.held_out()))
    rows = docs.select("doc_id", "text", language_id.held_out().alias("held_out"))
    return language_id.identify(rows, profiles).drop("text")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_windows(_documents(spark, sf_dir))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_documents(spark, sf_dir)).drop("row_key", "root")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_documents(spark, sf_dir).select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("pii_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in pii.KINDS], F.col("pii_sha256").alias("base_sha256"), _joined(F.col("pii")).alias("spans"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    # The first two rules fill a ledger; the third is added later and scans only its own pairs.
    _, new = scan_secrets(docs, rules=RULES[:2])
    found, _ = scan_secrets(docs, extend_ledger(None, new))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_joined(F.col("spans")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_documents(spark, sf_dir))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_documents(spark, sf_dir)).drop("row_key")


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    items = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.fill_in_middle(_documents(spark, sf_dir), check=True)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversation_repair.repair_conversations(conversation_repair.damage(turns))


__all__ = ["ORACLES", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_pieces": op2_pieces,
    "op3_toxicity": op3_toxicity,
    "op4_language_id": op4_language_id,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_pii": op7_pii,
    "op8_secret_scan": op8_secret_scan,
    "op9_quality_rules": op9_quality_rules,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_decontamination": op11_decontamination,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_conversation_repair": op13_conversation_repair,
}
