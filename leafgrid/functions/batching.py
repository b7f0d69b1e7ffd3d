"""Greedy batches of documents by what they hold, without a task that fills them one after the other.

A batch takes documents in order until the next would make it larger than its size.  Prefix sums
over ranges of the order tell for each document where a batch that began with it would end: at the
document whose sums enclose the batch's limit, which a join by buckets of sums finds.  From these
links, pointer doubling marks the documents that batches do begin with: rounds follow the logarithm
of the batches of the largest group, and a group of any size is spread over all tasks.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import settle


def prefix_sums(rows: DataFrame, order: tuple[str, ...], count_col: str, place_col: str, before_col: str) -> DataFrame:
    """rows with their place in the order, from 0, and the sum of the counts before them.

    Rows are dealt by ranges of the order; one count and one sum of each range reach the driver, and
    a window lies within a range.  Equal keys share a range, so the order should tell rows apart.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = settle(rows.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()))
    sizes = sorted(tuple(r) for r in dealt.groupBy("__range").agg(F.count(F.lit(1)), F.sum(count_col)).collect())
    if not sizes:
        return dealt.drop("__range").withColumns({place_col: F.lit(0).cast("long"), before_col: F.lit(0).cast("long")})
    offsets = dealt.sparkSession.createDataFrame(
        [(r, *o) for (r, _, _), o in zip(sizes, zip(accumulate((n for _, n, _ in sizes), initial=0), accumulate((s for _, _, s in sizes), initial=0)), strict=False)],
        "__range int, __place long, __sum long",
    )
    own = Window.partitionBy("__range").orderBy(*order)
    earlier = own.rowsBetween(Window.unboundedPreceding, -1)
    found = dealt.join(F.broadcast(offsets), "__range")
    found = found.withColumn(place_col, F.col("__place") + F.row_number().over(own) - 1).withColumn(before_col, F.col("__sum") + F.coalesce(F.sum(count_col).over(earlier), F.lit(0)))
    return found.drop("__range", "__place", "__sum")


def _links(rows: DataFrame, size: int) -> DataFrame:
    """i, nxt: the document that begins the next batch after one that i begins; null at the end of a group."""
    wide = rows.agg(F.greatest(F.lit(1), F.ceil(8 * F.avg("n"))).cast("long")).first()[0] or 1
    bucket = lambda c: F.floor(c / wide)
    ends = rows.filter("n > 0").select(F.col("g").alias("h"), F.col("i").alias("j"), F.col("s").alias("lo"), (F.col("s") + F.col("n")).alias("hi"))
    ends = ends.withColumn("bucket", F.explode(F.sequence(bucket(F.col("lo")), bucket(F.col("hi") - 1))))
    starts = rows.select("i", "g", "n", (F.col("s") + size).alias("limit")).withColumn("bucket", bucket(F.col("limit")))
    found = starts.join(ends, ["bucket"], "left").filter("j IS NULL OR (lo <= limit AND limit < hi)")
    found = starts.select("i", "g", "n").join(found.select("i", "j", "h"), "i", "left")
    # A document larger than a batch encloses its own limit: the next one follows it at once.
    follow = rows.select((F.col("i") - 1).alias("i"), F.col("i").alias("k"), F.col("g").alias("after"))
    both = found.join(follow, "i", "left")
    at, group = F.when(F.col("n") > size, F.col("k")).otherwise(F.col("j")), F.when(F.col("n") > size, F.col("after")).otherwise(F.col("h"))
    return both.select("i", F.when(group.eqNullSafe(F.col("g")), at).alias("nxt"))


def greedy_batches(docs: DataFrame, size: int, count_col: str, group_col: str | None = None, key: str = "doc_id", drop_last: bool = False) -> DataFrame:
    """docs with batch: from 0 within each group, in the order of key.

    A document that would lift a batch beyond size begins the next; one larger than size is alone.
    Null counts are zero; documents of zero stay in the batch before them; null groups are one group;
    equal keys go by count.  drop_last leaves out each group's last batch.
    """
    if size < 0:
        raise ValueError("a batch has no negative size")
    group = F.col(group_col).cast("string") if group_col else F.lit("")
    named = docs.withColumn("__g", F.coalesce(F.concat(F.lit("="), group), F.lit(""))).withColumn("__n", F.coalesce(F.col(count_col).cast("long"), F.lit(0).cast("long")))
    placed = settle(prefix_sums(named, ("__g", key, "__n"), "__n", "__i", "__s"))
    rows = placed.select(F.col("__i").alias("i"), F.col("__g").alias("g"), F.col("__n").alias("n"), F.col("__s").alias("s"))
    jump = settle(_links(rows, size).filter("nxt IS NOT NULL"))
    reached = settle(rows.groupBy("g").agg(F.min("i").alias("i")).select("i"))
    while not jump.isEmpty():
        further = reached.join(jump, "i").select(F.col("nxt").alias("i"))
        reached = settle(reached.unionByName(further).distinct())
        jump = settle(jump.alias("a").join(jump.select(F.col("i").alias("nxt"), F.col("nxt").alias("far")), "nxt").select("i", F.col("far").alias("nxt")))
    begins = reached.withColumn("__one", F.lit(1).cast("long"))
    marked = placed.join(begins.withColumnRenamed("i", "__i"), "__i", "left").withColumn("__one", F.coalesce("__one", F.lit(0).cast("long")))
    # The batches before a document are the marked ones up to it, less those of earlier groups.
    summed = settle(prefix_sums(marked, ("__i",), "__one", "__j", "__before").withColumn("batch", F.col("__before") + F.col("__one") - 1))
    groups = summed.groupBy("__g").agg(F.min("batch").alias("__base"), F.max("batch").alias("__last"))
    out = summed.join(groups, "__g")
    if drop_last:
        out = out.filter("batch < __last")
    return out.withColumn("batch", F.col("batch") - F.col("__base")).select(*docs.columns, "batch")


def batch_by_boxes(boxes: DataFrame, docs: DataFrame, size: int, group_col: str | None = None, key: str = "doc_id", drop_last: bool = False) -> DataFrame:
    """docs with n_boxes and batch: at most size boxes in a batch."""
    counts = boxes.groupBy(key).agg(F.count(F.lit(1)).alias("n_boxes"))
    return greedy_batches(docs.join(counts, key, "left").withColumn("n_boxes", F.coalesce("n_boxes", F.lit(0).cast("long"))), size, "n_boxes", group_col, key, drop_last)


def batch_by_pages(pages: DataFrame, docs: DataFrame, size: int, group_col: str | None = None, key: str = "doc_id", drop_last: bool = False) -> DataFrame:
    """docs with n_pages and batch: at most size pages in a batch; pages that repeat count once."""
    counts = pages.groupBy(key).agg(F.countDistinct("page_num").alias("n_pages"))
    return greedy_batches(docs.join(counts, key, "left").withColumn("n_pages", F.coalesce("n_pages", F.lit(0).cast("long"))), size, "n_pages", group_col, key, drop_last)
