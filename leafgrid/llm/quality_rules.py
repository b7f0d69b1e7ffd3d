"""Quality rules by distribution divergence, in DataFrame functions only.

Each document's histogram of character classes and of common words is compared with the reference of
its language by Jensen-Shannon distance.  References are sums over all documents of a language that
pass the base rules.  A document without a language is compared with all references, and the one
with the least sum of both distances counts.  Documents below a least length have too few
observations for a stable histogram and are judged by the base rules alone.

Scale: one pass over the texts makes a narrow table of counts, in which each document stays in its
own row (no shuffle); references are sums with map-side combine, one row a language, joined to the
counts by language: the plan has one size, however many languages there are.  References are
broadcast up to BROADCAST of them, and beyond that joined by a shuffle whose hot languages adaptive
execution splits, since each language has one reference.  Rows without a language meet the references in blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialise

WORD = r"[^\x20\x09-\x0D]+"
# Frequent words of four languages.
COMMON = ("the", "of", "and", "to", "in", "is", "that", "for", "der", "die", "und", "das", "von", "den", "mit", "le", "la", "les", "des", "et", "que", "de", "el", "en", "y", "los", "un", "las")
LEAST_WORDS = 50
DIVERGENCE_WORDS = 100
CHAR_LIMIT = 0.28
WORD_LIMIT = 0.28
BROADCAST, BLOCK = 20_000, 256


def _count(text: Column, pattern: str) -> tuple[Column, Column]:
    """The text without the pattern's matches, and how many characters went."""
    rest = F.regexp_replace(text, pattern, "")
    return rest, F.length(text) - F.length(rest)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Base counts and the two histograms of every document; a null text counts as empty."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("*", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"), F.regexp_replace("text", r"\p{Ll}+", "").alias("t1"))
    rows = rows.select("*", F.regexp_replace("t1", r"[\x20\x09-\x0D]+", "").alias("t2"))
    rows = rows.select("*", F.regexp_replace("t2", r"\p{Lu}+", "").alias("t3"))
    rows = rows.select("*", F.regexp_replace("t3", r"\p{Nd}+", "").alias("t4"))
    rows = rows.select("*", F.regexp_replace("t4", r"[\p{P}\p{S}]+", "").alias("t5"))
    n = {k: F.length(k).cast("long") for k in ("text", "t1", "t2", "t3", "t4", "t5")}
    chars = F.array(n["text"] - n["t1"], n["t1"] - n["t2"], n["t2"] - n["t3"], n["t3"] - n["t4"], n["t4"] - n["t5"], n["t5"])
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # Hash and position of each 3-word window in one number: sorted as primitives, they give the
    # few windows that can be repeated; those are then compared as strings.
    window = lambda i: F.concat(F.get("words", i), F.lit(" "), F.get("words", i + 1), F.lit(" "), F.get("words", i + 2))
    packed = F.sort_array(F.transform(F.slice("words", F.lit(1), F.greatest(F.size("words") - 2, F.lit(0))), lambda w, i: F.shiftleft(F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)), 31).bitwiseOR(i.cast("long"))))
    rows = rows.select(
        "doc_id", "lang", F.size("words").cast("long").alias("n_words"), (n["text"] - (n["t1"] - n["t2"])).alias("word_chars"),
        F.length(F.regexp_replace("t4", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"), chars.alias("char_hist"), lines.alias("lines"), packed.alias("packed"), "words",
        F.lower(F.array_join(F.filter("words", lambda w: w.isin(*COMMON, *[c.capitalize() for c in COMMON])), "  ")).alias("common"),
    )
    twin = lambda j, p: F.coalesce(F.shiftright(F.get("packed", j), 31) == F.shiftright(p, 31), F.lit(False))
    rows = rows.select("*", F.transform(F.filter("packed", lambda p, j: twin(j - 1, p) | twin(j + 1, p)), lambda p: p.bitwiseAND((1 << 31) - 1).cast("int")).alias("near")).drop("packed")
    rows = rows.select("*", F.sort_array(F.transform("near", lambda i: F.struct(window(i).alias("g"), i.alias("i")))).alias("grams"))
    same = lambda j, e: F.coalesce(F.get("grams", j)["g"] == e["g"], F.lit(False))
    rows = rows.select("*", F.transform(F.filter("grams", lambda e, j: same(j - 1, e) | same(j + 1, e)), lambda e: e["i"]).alias("at"), F.concat(F.lit(" "), "common", F.lit(" ")).alias("low"))
    covered = F.size(F.array_distinct(F.concat("at", F.transform("at", lambda i: i + 1), F.transform("at", lambda i: i + 2))))
    counts = [((F.length("low") - F.length(F.replace("low", F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)).cast("long") for w in COMMON]
    rows = rows.withColumn("counts", F.array(*counts))
    other = F.col("n_words") - F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        "char_hist", F.concat("counts", F.array(other)).alias("word_hist"),
    )


def divergence(hist: Column, reference: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) between a column of counts and one of shares."""
    total = F.aggregate(hist, F.lit(0).cast("long"), lambda a, x: a + x)
    term = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)
    pair = F.zip_with(F.transform(hist, lambda x: x / F.greatest(total, F.lit(1))), reference, lambda p, q: (term(p, (p + q) / 2) + term(q, (p + q) / 2)) / 2)
    return F.when(reference.isNotNull(), F.sqrt(F.greatest(F.aggregate(pair, F.lit(0.0), lambda a, x: a + x), F.lit(0.0))))


def references(good: DataFrame) -> DataFrame:
    """ref_lang, chars, words: the shares of each language's histograms over counts with a language."""
    share = lambda hist, n: F.array(*[F.sum(F.get(hist, F.lit(i))) for i in range(n)])
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    sums = good.filter("lang IS NOT NULL").groupBy(F.col("lang").alias("ref_lang")).agg(share("char_hist", 6).alias("c"), share("word_hist", len(COMMON) + 1).alias("w"))
    return sums.select("ref_lang", F.transform("c", lambda x: x / F.greatest(total(F.col("c")), F.lit(1))).alias("chars"), F.transform("w", lambda x: x / F.greatest(total(F.col("w")), F.lit(1))).alias("words"))


def _nearest(rows: DataFrame, refs: DataFrame, n: int) -> DataFrame:
    """rows without a language, with chars and words of the nearest of n references."""
    blocks = -(-n // BLOCK)
    packed = refs.withColumn("block", F.pmod(F.xxhash64("ref_lang"), F.lit(blocks))).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("ref_lang", "chars", "words"))).alias("refs"))
    asked = rows.select("row", "char_hist", "word_hist", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    far = F.transform("refs", lambda r: F.struct((divergence(F.col("char_hist"), r["chars"]) + divergence(F.col("word_hist"), r["words"])).alias("far"), r["ref_lang"].alias("ref_lang"), r["chars"].alias("chars"), r["words"].alias("words")))
    least = asked.join(packed, "block").select("row", F.array_min(far).alias("x")).groupBy("row").agg(F.min("x").alias("x"))
    return rows.join(least.select("row", "x.chars", "x.words"), "row", "left")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Base counts, base_failed, kept, char_distance and word_distance for every row.

    Null and empty texts have no words and fail the base rules; null languages give no reference
    and are judged by the nearest one; repeated rows are judged alike; without any reference the base
    rules decide alone and the distances are null, as they are for a language of which no document
    passes.  Other columns are ignored.
    """
    rows = materialise(features(docs, id_col, text_col, lang_col).withColumn("row", F.monotonically_increasing_id()), "quality")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    refs = materialise(references(rows.filter(~failed)), "references")
    n = refs.count()
    near = F.broadcast(refs) if n <= BROADCAST else refs
    known = rows.filter("lang IS NOT NULL").join(near, F.col("lang") == F.col("ref_lang"), "left").drop("ref_lang")
    unknown = rows.filter("lang IS NULL")
    unknown = _nearest(unknown, refs, n) if n else unknown.select("*", *[F.lit(None).cast("array<double>").alias(c) for c in ("chars", "words")])
    both = known.unionByName(unknown).select("*", failed.alias("base_failed"), divergence(F.col("char_hist"), F.col("chars")).alias("char_distance"), divergence(F.col("word_hist"), F.col("words")).alias("word_distance"))
    far = (F.col("n_words") >= DIVERGENCE_WORDS) & F.coalesce((F.col("char_distance") > CHAR_LIMIT) | (F.col("word_distance") > WORD_LIMIT), F.lit(False))
    return both.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~far).alias("kept"), F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance"))
