"""Secret scanning with an incremental blob ledger, in DataFrame functions only.

Every row is one historical version of a path.  Versions are content-addressed: the SHA-256 of the
text names a blob.  A ledger holds, for each (blob, rule, rule version) that was ever scanned, the
spans found.  A scan reads only pairs that the ledger lacks, and findings are joined back to all
versions, so copies and unchanged files cost one hash.

Scale: hashes are compared with the ledger before any text moves.  A rule version that the ledger
never saw is due for every blob and runs where the rows lie; only for rules that some blobs have
behind them are rows joined to what is due.  Texts with a match alone are shuffled, one for each
blob, and go on to the span arithmetic, whose windows are bounded by one blob.  Findings are joined
to versions by blob and salt, so the copies of one blob are dealt over SALT tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import materialise

LEDGER = "sha string, rule string, version int, spans array<struct<start:int,end:int>>"
SALT = 32
_PAIR = ["sha", "rule", "version"]
_SPANS = "array<struct<start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """A pattern (Java syntax), the group whose length counts, and its least length in code points."""

    name: str
    pattern: str
    group: int
    least: int
    version: int = 1


# The three base rules.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)


def _pieces(rule: Rule) -> Column:
    """Text between matches and the matches: lengths from which positions follow as running sums."""
    pattern = F.lit(rule.pattern)
    gaps = F.transform(F.split("text", rule.pattern, -1), lambda x: F.length(x))
    hits = F.transform(F.regexp_extract_all("text", pattern, F.lit(0)), lambda x: F.length(x))
    sizes = F.transform(F.regexp_extract_all("text", pattern, F.lit(rule.group)), lambda x: F.length(x))
    return F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), sizes.alias("size"))


def _matching(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """rows with matched, the names of the rules (of those in due, if there) that the text matches; others leave."""
    due = lambda r: F.array_contains("due", r.name) if "due" in rows.columns else F.lit(True)
    matched = F.array_compact(F.array(*[F.when(due(r) & F.col("text").rlike(r.pattern), F.lit(r.name)) for r in rules]))
    return rows.select("sha", "text", matched.alias("matched")).filter(F.size("matched") > 0)


def _spans(matching: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """sha, rule, version, spans of one text for each blob, for the rules that it matches."""
    parts = F.array(*[
        F.when(F.array_contains("matched", r.name), F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"), F.lit(r.least).alias("least"), _pieces(r).alias("pieces")))
        for r in rules
    ])
    blobs = matching.dropDuplicates(["sha"])
    todo = blobs.select("sha", F.explode(F.filter(parts, lambda x: x.isNotNull())).alias("p")).select("sha", "p.*")
    found = todo.select(*_PAIR, "least", F.posexplode("pieces"))
    before = Window.partitionBy("sha", "rule").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("col.gap") + F.coalesce(F.col("col.hit"), F.lit(0))).over(before), F.lit(0)) + F.col("col.gap")
    found = found.select(*_PAIR, start.cast("int").alias("start"), (start + F.col("col.hit")).cast("int").alias("end"), (F.col("col.size") >= F.col("least")).alias("ok"))
    spans = F.array_sort(F.collect_list(F.when(F.col("ok"), F.struct("start", "end"))))
    return found.groupBy(*_PAIR).agg(spans.alias("spans"))


def _named(pairs: DataFrame, rules: tuple[Rule, ...]) -> tuple[Rule, ...]:
    """The rules that pairs holds in their present version: at most as many rows as rules reach the driver."""
    held = {(r["rule"], r["version"]) for r in pairs.join(F.broadcast(_table(pairs, rules)), ["rule", "version"]).select("rule", "version").distinct().collect()}
    return tuple(r for r in rules if (r.name, r.version) in held)


def _table(like: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    return like.sparkSession.range(1).select(F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules])).alias("p")).select("p.*")


def scan_secrets(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(findings for every version, new ledger rows).

    Findings: doc_id, sha, spans array of (start, kind, end) by start, then order of the rules;
    code points, end exclusive.  Null text counts as empty; repeated rows each get their findings;
    other columns are ignored; an empty table gives two empty results.  Rule names are unique.  New
    ledger rows are one for each blob and rule version that the ledger lacks, also without findings.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.sha2(text, 256).alias("sha"))
    versions = rows.select("doc_id", "sha")
    due = versions.select("sha").distinct().select("sha", F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules])).alias("p")).select("sha", "p.*")
    fresh, partly = rules, ()
    if ledger is not None:
        due = materialise(due.join(ledger.select(*_PAIR), _PAIR, "left_anti"), "due")
        known = _named(ledger, rules)
        fresh = tuple(r for r in rules if r not in known)
        partly = _named(due, known) if known else ()
    scans = []
    if fresh:
        scans.append(_spans(_matching(rows, fresh), fresh))
    if partly:
        wanted = due.join(F.broadcast(_table(due, partly)), ["rule", "version"]).groupBy("sha").agg(F.collect_set("rule").alias("due"))
        scans.append(_spans(_matching(rows.join(wanted, "sha"), partly), partly))
    none = F.array().cast(_SPANS)
    new = due.withColumn("spans", none)
    for i, found in enumerate(scans):
        got = found.withColumnRenamed("spans", f"got{i}")
        new = new.join(got, _PAIR, "left").withColumn("spans", F.coalesce(f"got{i}", "spans")).drop(f"got{i}")
    findings = None
    current = [] if ledger is None else [ledger.join(F.broadcast(_table(ledger, rules)), ["rule", "version"]).select(*_PAIR, "spans")]
    for part in (*scans, *current):
        findings = part if findings is None else findings.unionByName(part)
    rank = F.array_position(F.array(*[F.lit(r.name) for r in rules]), F.col("rule")).cast("int")
    hits = findings.filter(F.size("spans") > 0).select("sha", F.explode("spans").alias("s"), rank.alias("rank"), "rule")
    each = hits.groupBy("sha").agg(F.array_sort(F.collect_list(F.struct(F.col("s.start").alias("start"), "rank", F.col("rule").alias("kind"), F.col("s.end").alias("end")))).alias("spans"))
    each = each.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    empty = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    salted = versions.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int"))
    return salted.join(each, ["sha", "salt"], "left").select("doc_id", "sha", F.coalesce("spans", empty).alias("spans")), new


def extend_ledger(ledger: DataFrame | None, new: DataFrame) -> DataFrame:
    """The ledger with new rows, which are written to the shared folder first."""
    stored = materialise(new.select(*_PAIR, "spans"), "ledger")
    return stored if ledger is None else ledger.select(*_PAIR, "spans").unionByName(stored)
