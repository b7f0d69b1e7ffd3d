"""Mixing sources to target weights by pivotal dependent rounding.

A source with target t and size s asks for t / s copies of each of its documents.  The whole part
is given to all; the fractional parts are rounded dependently: two documents meet and move mass in
words between them, at random and fairly, until one of them has a whole number of copies.  Words
are conserved in every meeting; the one document left open at the root is rounded to the nearest
whole number, so a source is off its target by at most half of its largest document.

Scale: documents meet in cells of about CELL members, chosen by a keyed hash, each cell leaving at
most one undecided document; those meet again in a reduction tree of fan-in FAN until each source
has one.  Only (key, size, source) is shuffled, never text; a source
with a third of all rows is just more cells.  The order of meetings and all coins are keyed hashes
of the documents, so reruns and other partitionings agree.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .kernel import mix as spread
from .storage import free_name, materialise, row_key

WORD = r"[^\x20\x09-\x0D]+"
CELL, FAN = 1024, 64


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """source, source_size, target for sizes(source, size): one row for each source.

    Sources by code point, null last, take the weights in turn.  A target above cap times its
    source's size stops there and the excess is shared by weight: with r = limit / weight, the
    sources that stop are the first in order of r, up to the level at which no other is above.
    The windows run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1) % len(weights)
    per = per.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), turn)).withColumn("limit", F.col("source_size") * cap)
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source")
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    share = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("level", left / share).withColumn("place", F.row_number().over(order))
    open_ = F.when(F.col("limit") / F.col("weight") > F.col("level"), F.struct("place", "level"))
    level = F.min(open_).over(every)["level"]
    return per.select("source", "source_size", F.when(level.isNull(), F.col("limit")).otherwise(F.least("limit", F.col("weight") * level)).alias("target"))


_STATE = "key string, source string, cell long, mark long, weight double, part double, up long, open boolean"


def _meet(seed: int):
    """Let the members of a cell meet in order of mark; at most one stays open."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["mark", "key"], kind="stable").reset_index(drop=True)
        w, p, mark = pdf["weight"].to_numpy(), pdf["part"].to_numpy(copy=True), pdf["mark"].to_numpy()
        coins = (spread(mark.astype(np.uint64) ^ np.uint64(seed * 2 + 1)) >> np.uint64(11)) * 2.0**-53
        up, done, i = np.zeros(len(p), np.int64), np.ones(len(p), bool), -1
        for j in range(len(p)):
            if i < 0:
                i = j
                continue
            rise, fall = min(w[i] * (1 - p[i]), w[j] * p[j]), min(w[i] * p[i], w[j] * (1 - p[j]))
            d = rise if coins[j] * (rise + fall) < fall else -fall
            a, b = p[i] + d / w[i], p[j] - d / w[j]
            p[i], p[j] = (0.0 if a < 1e-9 else 1.0 if a > 1 - 1e-9 else a), (0.0 if b < 1e-9 else 1.0 if b > 1 - 1e-9 else b)
            if p[i] in (0.0, 1.0):
                up[i] = int(p[i])
                i = j if p[j] not in (0.0, 1.0) else -1
                if i < 0:
                    up[j] = int(p[j])
            else:
                up[j] = int(p[j])
        if i >= 0:
            done[i] = False
        return pdf.assign(part=p, up=up, open=~done, cell=pdf["cell"] // FAN)

    return run


def _plan(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: float = 3.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """plan_copies, with each row's source."""
    rows = materialise(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), row_key(id_col, text_col).alias("row_key"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    ), "sizes")
    targets = materialise(source_targets(rows, weights, cap), "targets")
    units = rows.groupBy("row_key", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    per = units.groupBy("source").agg(F.count(F.lit(1)).alias("members"))
    asked = targets.alias("t").join(per.alias("p"), F.expr("t.source <=> p.source")).select("t.source", "source_size", "target", "members")
    asked = asked.withColumn("share", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    asked = asked.withColumn("whole", F.floor(F.col("share") + 1e-12).cast("long")).withColumn("part", F.greatest(F.col("share") - F.col("whole"), F.lit(0.0)))
    asked = materialise(asked, "shares")
    mark = F.xxhash64(F.lit(seed), "row_key", F.col("u.source"))
    state = units.alias("u").join(asked.alias("a"), F.expr("u.source <=> a.source")).filter("size > 0 and part > 1e-9").select(
        F.col("row_key").alias("key"), F.col("u.source").alias("source"), F.pmod(mark, F.ceil(F.col("members") / CELL)).alias("cell"), mark.alias("mark"),
        (F.col("size") * F.col("n")).cast("double").alias("weight"), "part", F.lit(0).cast("long").alias("up"), F.lit(True).alias("open"),
    )
    most = per.agg(F.max("members")).first()[0] or 0
    cells, decided = -(-most // CELL), []
    while most:
        state = materialise(state.groupBy("source", "cell").applyInPandas(_meet(seed), _STATE), "meetings")
        decided.append(state.filter("not open"))
        state = state.filter("open")
        if cells <= 1:
            break
        cells = -(-cells // FAN)
    decided.append(state.withColumn("up", (F.col("part") >= 0.5).cast("long")))
    ups = reduce(DataFrame.unionByName, [d.select("key", F.col("source").alias("s"), "up") for d in decided])
    out = rows.alias("r").join(asked.alias("a"), F.expr("r.source <=> a.source")).select("doc_id", "row_key", F.col("r.source").alias("source"), "size", "source_size", "target", "whole")
    out = out.join(ups, F.expr("row_key = key and source <=> s"), "left")
    copies = F.col("whole") + F.coalesce("up", F.lit(0))
    return out.select("doc_id", "row_key", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def plan_copies(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: float = 3.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, row_key, size, source_size, target, copies, taken for every row.

    Rows with equal id, text and source are decided together.  Documents without words take no
    part and get as many copies as the whole part gives.  A null source is a source of its own; an
    empty table gives an empty result; other columns are ignored.
    """
    return _plan(docs, weights, cap, seed, id_col, text_col, source_col).drop("source")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: float = 3.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs, each as often as the mix takes it; rows with equal id and text in two sources are apart.

    A row that the mix takes no copy of goes, as do all rows of an empty table.
    """
    key, copies, copy = (free_name(docs, n) for n in ("key", "copies", "copy"))
    named = F.md5(F.concat_ws(":", F.col("row_key"), F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))))
    plan = _plan(docs, weights, cap, seed, id_col, text_col, source_col).filter("copies > 0")
    plan = plan.groupBy(named.alias(key)).agg(F.max("copies").cast("int").alias(copies))
    own = F.md5(F.concat_ws(":", row_key(id_col, text_col), F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit(""))))
    keyed = docs.withColumn(key, own).join(plan.hint("merge"), key)
    return keyed.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).drop(key, copies, copy)
