"""Embedding of a box's text: the sum of its words' vectors by shape, prefix and suffix."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import affixes, word_shape
from .transliterate import ascii_fold

KINDS = ("shape", "prefix", "suffix")
BROADCAST = 64 << 20


def word_features(words: DataFrame, word_col: str = "word", keys: Sequence[str] = ("doc_id", "box_idx")) -> DataFrame:
    """keys, kind, value, n: how often a box has each shape, prefix and suffix of its words' ASCII forms."""
    folded = words.select(*keys, ascii_fold(F.col(word_col)).alias("word"))
    named = affixes(folded.withColumn("shape", word_shape(F.col("word"))), "word")
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in KINDS])
    return named.select(*keys, F.explode(each).alias("x")).groupBy(*keys, "x.kind", "x.value").agg(F.count(F.lit(1)).alias("n"))


def text_embedding(words: DataFrame, tables: Mapping[str, DataFrame], size: int, word_col: str = "word", keys: Sequence[str] = ("doc_id", "box_idx")) -> DataFrame:
    """keys, embedding for every box with words.

    tables: by kind, (value, vector) of that kind's vocabulary; the vector of a null value is for
    values that the vocabulary lacks, which count as zero without one.  Words are counted for each
    box first; the tables are broadcast up to BROADCAST bytes, which are counted, and joined by a
    shuffle beyond.  A box's vectors are summed in one order, so equal tables give equal sums.
    """
    features = word_features(words, word_col, keys)
    weights = None
    for kind, table in tables.items():
        own = table.select(F.lit(kind).alias("kind"), "value", "vector")
        weights = own if weights is None else weights.unionByName(own)
    known = weights.filter("value IS NOT NULL")
    if (known.agg(F.sum(F.octet_length("value") + 8 * size + 32)).first()[0] or 0) <= BROADCAST:
        known = F.broadcast(known)
    unknown = weights.filter("value IS NULL").select("kind", F.col("vector").alias("other"))
    zero = F.array_repeat(F.lit(0.0), size)
    found = features.join(known, ["kind", "value"], "left").join(F.broadcast(unknown), "kind", "left")
    found = found.select(*keys, F.struct("kind", "value", "n", F.coalesce("vector", "other", zero).alias("vector")).alias("x"))
    each = found.groupBy(*keys).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    add = lambda total, x: F.zip_with(total, x["vector"], lambda a, b: a + b * x["n"])
    return each.select(*keys, F.aggregate("xs", zero, add).alias("embedding"))
