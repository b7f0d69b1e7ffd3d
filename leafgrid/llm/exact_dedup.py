"""Exact deduplication by distributed MSD radix partitioning.

Texts are compared as byte strings, most significant bytes first, each prefixed with its length.
Round 0 splits all documents by (length, first bytes); every later round splits the groups that
still have two or more members by their next, 16 times longer, run of bytes.  A group leaves when
it is a singleton or when its texts have ended, so only bytes decide equality.

Scale: a split is an aggregate with map-side combine, so a group of copies holding a third of all
rows sends one row per map task; the rows find their group again by an equi-join whose skewed
partitions adaptive execution can split.  Only members of unfinished groups carry text beyond
round 0, and the number of rounds is the logarithm of the longest repeated text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialise, only_rows, row_key

SPACE = r"[\x20\x09-\x0D]+"
FIRST, SECOND, GROWTH = 64, 1024, 16


def normalised(text: Column) -> Column:
    """UTF-8 bytes of the text without the characters of ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "").cast("binary")


def _split(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each group with two or more members: its size and the member that stays."""
    order = F.struct((-F.col("n_cp")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"), F.col("rid").alias("d"))
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("best")).filter("n > 1")
    return groups.select(*keys, "n", F.col("best.c").alias("keep_id"), F.col("best.d").alias("keep_rid"), F.monotonically_increasing_id().alias("new_gid"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, row_key for every row.

    Of equal normalised texts the row with the most code points in its original text stays, then
    the smallest id (null ids last).  Null and empty texts are equal.  Rows with the same id and
    text are told apart: exactly one of them is kept.  Other columns are ignored; an empty table
    gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.length(text).alias("n_cp"), normalised(F.col(text_col)).alias("norm"), row_key(id_col, text_col).alias("row_key"))
    rows = rows.select("doc_id", "n_cp", "row_key", F.octet_length("norm").alias("n_bytes"), F.substring("norm", 1, FIRST).alias("head"), "norm")
    sha = F.sha2("norm", 256).alias("text_sha256")
    heads = materialise(rows.select("doc_id", "n_cp", "row_key", "n_bytes", "head", sha, F.monotonically_increasing_id().alias("rid")), "heads")
    groups = materialise(_split(heads, ["n_bytes", "head"]), "groups")
    first = heads.join(groups, ["n_bytes", "head"], "left")
    done = [first.filter(F.col("n").isNull() | (F.col("n_bytes") <= FIRST))]
    more = groups.filter(F.col("n_bytes") > FIRST).select("n_bytes", "head", F.col("new_gid").alias("gid"))
    # A merge join at every size: the members' side grows with the corpus.
    rest = F.expr(f"substring(norm, {FIRST + 1})").alias("rest")
    state = materialise(rows.join(more.hint("merge"), ["n_bytes", "head"]).select("doc_id", "n_cp", "row_key", "n_bytes", sha, "gid", rest, F.monotonically_increasing_id().alias("rid")), "members")
    end, width = FIRST, SECOND
    while not state.isEmpty():
        end += width
        cut = state.withColumns({"chunk": F.substring("rest", 1, width), "rest": F.expr(f"substring(rest, {width + 1})")})
        groups = materialise(_split(cut, ["gid", "chunk"]), "groups")
        out = materialise(cut.join(groups, ["gid", "chunk"], "left").drop("chunk", "gid"), "split")
        over = F.col("n").isNull() | (F.col("n_bytes") <= end)
        done.append(out.filter(over))
        state = out.filter(~over).withColumnRenamed("new_gid", "gid").drop("n", "keep_id", "keep_rid")
        width *= GROWTH
    alone = F.col("n").isNull()
    return reduce(DataFrame.unionByName, [d.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("rid") == F.col("keep_rid"))).alias("kept"),
        "text_sha256", "row_key",
    ) for d in done])


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    kept = exact_dedup(docs, id_col, text_col).filter("kept").select(F.col("row_key").alias("__key"))
    return only_rows(docs, kept, id_col, text_col)
