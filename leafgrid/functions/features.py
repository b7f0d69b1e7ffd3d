"""Layout and text features of boxes."""

from __future__ import annotations

import string
from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType
from pyspark.sql.window import Window

from .transliterate import LATIN, ascii_fold, latin_spelled, single

# Quotation marks that count as punctuation beside the punctuation and symbol classes.
QUOTES = "\"'ˊ＂〃ײ᳓″״‶˶ʺ“”˝"
_PUNCT = r"\p{P}\p{S}" + QUOTES
#: A number, a punctuation mark, one line or tab character, other blanks, or a word with its apostrophe.
WORD = rf"(?U)(?:\d+(?:[.,]\d+)?|[{_PUNCT}]|[\n\r\t]|[^\S\r\n\t]+|[^\d{_PUNCT}'\n\[\s]+(?:['ˊ](?=\p{{Alpha}}|$))?)[^\S\r\n\t]?"
_OTHER, _APOSTROPHE, _BLANK = rf"[^\d{_PUNCT}'\n\[\s]", r"(?:['ˊ](?=\p{Alpha}|$))?", r"[^\S\r\n\t]?"
#: The same words for Java's patterns, in half the time: no two alternatives begin alike, so Latin letters, which most words are made of, are looked for first.
WORD_LATIN = rf"(?U)(?:[A-Za-zÀ-ÖØ-öø-ſ]++(?:\x20|{_OTHER}*+{_APOSTROPHE}{_BLANK})|(?:\d+(?:[.,]\d+)?|[{_PUNCT}]|[\n\r\t]|[^\S\r\n\t]+|{_OTHER}++{_APOSTROPHE}){_BLANK})"
#: Stands between the words of a text; no pattern or table has it, it is no letter, and it is ASCII.
END = "\x01"
LATIN_CLASS = "".join(lo if lo == hi else f"{lo}-{hi}" for lo, hi in LATIN)


def layout_features(boxes: DataFrame, compat: bool = False) -> DataFrame:
    """xmin, ymin, xmax, ymax, width, height, first_page and last_page of each box.

    The last page is the greatest page number of the document; compat gives the fixed false that a
    page count of zero leads to.
    """
    last = F.lit(False) if compat else F.col("page_num") == F.max("page_num").over(Window.partitionBy("doc_id"))
    return boxes.withColumns({"xmin": F.col("x0"), "ymin": F.col("y0"), "xmax": F.col("x1"), "ymax": F.col("y1"), "width": F.col("x1") - F.col("x0"), "height": F.col("y1") - F.col("y0"), "first_page": F.col("page_num") == 0, "last_page": last})


def layout_buckets(featured: DataFrame, n: int = 64) -> DataFrame:
    """Table positions of the six layout measures: truncated, at most n - 1; heights count five times."""
    at = lambda c, k=1: F.least(F.col(c) * k * n, F.lit(float(n - 1))).cast("int")
    return featured.withColumns({"x0_at": at("xmin"), "y0_at": at("ymin"), "x1_at": at("xmax"), "y1_at": at("ymax"), "w_at": at("width"), "h_at": at("height", 5)})


def sinusoidal(index: Column, n: int, dim: int, temperature: float = 10000.0) -> Column:
    """The sinusoidal embedding of an index clamped to [0, n): sines on even channels, cosines on odd."""
    at = F.greatest(F.lit(0), F.least(index, F.lit(n - 1)))
    channel = F.sequence(F.lit(0), F.lit(dim - 1))
    angle = lambda i: at * F.exp((i - i % 2) * F.lit(-1.0 / dim) * F.log(F.lit(temperature)))
    return F.transform(channel, lambda i: F.when(i % 2 == 0, F.sin(angle(i))).otherwise(F.cos(angle(i))))


def layout_embedding(featured: DataFrame, n: int = 64, size: int = 48) -> DataFrame:
    """Six embeddings of size // 6 side by side; size is a multiple of 12."""
    if size % 12:
        raise ValueError("size must be a multiple of 12")
    rows = layout_buckets(featured, n)
    parts = [sinusoidal(F.col(c), n, size // 6) for c in ("x0_at", "y0_at", "x1_at", "y1_at", "w_at", "h_at")]
    return rows.withColumn("embedding", F.concat(*parts))


def tokens(rows: DataFrame, text_col: str = "text", keys: tuple[str, ...] = ("doc_id", "box_idx")) -> DataFrame:
    """keys, word_idx, token: the words of each text, each with the blank that follows it."""
    found = F.regexp_extract_all(text_col, F.lit(WORD), F.lit(0))
    return rows.select(*keys, F.posexplode(found).alias("word_idx", "token"))


def _letters(word: Column) -> Column:
    plain = F.translate(word, string.ascii_letters + string.digits, "x" * 26 + "X" * 26 + "d" * 10)
    every = F.regexp_replace(F.regexp_replace(F.regexp_replace(word, r"\p{Lu}", "X"), r"(?!X)\p{L}", "x"), r"\p{Nd}", "d")
    return F.when(F.octet_length(word) == F.length(word), plain).otherwise(every)


def word_shape(word: Column) -> Column:
    """Upper-case letters as X, other letters as x, digits as d, runs cut at four; LONG from 100 on.

    Words of ASCII alone, most of them, are translated character by character; patterns see the rest.
    """
    shape = _letters(word)
    cut = F.when(F.length(word) < 5, shape).otherwise(F.regexp_replace(shape, r"(?s)(.)\1{4,}", "$1$1$1$1"))
    return F.when(F.length(word) >= 100, F.lit("LONG")).otherwise(cut)


def word_marks(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds shapes and lows: the shapes and the lower case of the ASCII forms of each text's words; none for null.

    Functions are called once for all words of a text, with END between them, which costs far less
    than a call a word.  Texts with characters beyond LATIN, or with END, are taken word by word.
    """
    text, words, all_of, in_one = F.col(text_col), F.col("__words"), F.col("__all"), F.col("__latin")
    found = F.regexp_extract_all(text, F.lit(WORD_LATIN), F.lit(0))
    rows = rows.withColumns({"__words": F.coalesce(found, F.array().cast("array<string>")), "__latin": F.coalesce(text.rlike(rf"^[{LATIN_CLASS}]*+\z"), F.lit(False))})
    rows = rows.withColumn("__all", F.when(in_one & (F.size(words) > 0), F.array_join(words, END)))
    rows = rows.withColumn("__all", F.when(F.octet_length(all_of) == F.length(all_of), all_of).otherwise(latin_spelled(all_of)))
    rows = rows.withColumn("__all", F.replace(F.translate(all_of, *single()), F.lit(" " + END), F.lit(END)))
    blanks = F.contains(all_of, F.lit(" " + END)) | F.contains(all_of, F.lit(END + " "))
    rows = rows.withColumn("__all", F.trim(F.when(blanks, F.regexp_replace(all_of, f" *{END} *", END)).otherwise(all_of)))
    rows = rows.withColumn("__words", F.when(in_one, F.array().cast("array<string>")).otherwise(F.transform(words, lambda w: ascii_fold(w))))
    long = F.regexp_replace(_letters(all_of), f"[^{END}]{{100,}}+", "LONG")
    one = lambda every, each: F.when(all_of.isNotNull(), F.split(every, END, -1)).otherwise(F.transform(words, each))
    marks = {"shapes": one(F.regexp_replace(long, rf"([^{END}])\1{{4,}}", "$1$1$1$1"), word_shape), "lows": one(F.lower(all_of), lambda w: F.lower(w))}
    return rows.withColumns(marks).drop("__words", "__all", "__latin")


def affixes(words: DataFrame, col: str = "token") -> DataFrame:
    """Adds prefix, suffix (three characters) and norm, all lower case."""
    low = F.lower(F.trim(F.col(col)))
    return words.withColumns({"prefix": F.left(low, F.lit(3)), "suffix": F.right(low, F.lit(3)), "norm": low})


def numbered(rows: DataFrame, order: tuple[str, ...], out_col: str) -> DataFrame:
    """Adds out_col: places of rows from 0 in the given order.

    Ranges of the first column of the order, bounded by a sample of at most 32 keys for each shuffle
    partition, are numbered side by side; their sizes, one number a range, go through the driver.  The
    bounds are literals, so a task that runs again deals alike.  Rows with one value of that column
    share a task.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.col(order[0])
    sample = sorted(r[0] for r in rows.filter(key.isNotNull()).select(key).orderBy(F.xxhash64(key)).limit(32 * parts).collect())
    bounds = sorted({sample[i] for i in range(32, len(sample), 32)})
    kind = rows.schema[order[0]].dataType
    limits = F.array(*map(F.lit, bounds)).cast(ArrayType(kind))
    dealt = rows.withColumn("__range", F.coalesce(F.size(F.filter(limits, lambda x: x <= key)), F.lit(0)) if bounds else F.lit(0))
    sizes = {r["__range"]: r["count"] for r in dealt.groupBy("__range").count().collect()}
    offsets = list(accumulate((sizes.get(i, 0) for i in range(len(bounds) + 1)), initial=0))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    return dealt.withColumn(out_col, place + F.get(F.array(*[F.lit(x).cast("long") for x in offsets]), F.col("__range"))).drop("__range")


def build_vocabulary(values: DataFrame, value_col: str, order_cols: tuple[str, ...]) -> DataFrame:
    """value, idx: distinct values numbered from 1 in order of first appearance; 0 is the unknown."""
    spots = [f"__at{i}" for i in range(len(order_cols))]
    first = values.groupBy(F.col(value_col).alias("value")).agg(F.min(F.struct(*[F.col(c).alias(s) for c, s in zip(order_cols, spots, strict=True)])).alias("__at"))
    return numbered(first.select("value", "__at.*"), (*spots, "value"), "idx").select("value", (F.col("idx") + 1).alias("idx"))


def encode(values: DataFrame, vocabulary: DataFrame, value_col: str, out_col: str = "idx", default: int = 0) -> DataFrame:
    """Numbers of values; values that the vocabulary lacks get the default."""
    found = vocabulary.select(F.col("value").alias(value_col), F.col("idx").alias(out_col))
    return values.join(found, value_col, "left").withColumn(out_col, F.coalesce(out_col, F.lit(default)))


def decode(codes: DataFrame, vocabulary: DataFrame, code_col: str, out_col: str = "value") -> DataFrame:
    """Values of numbers; null for negative and unknown numbers."""
    found = vocabulary.select(F.col("idx").alias(code_col), F.col("value").alias(out_col))
    return codes.join(found, code_col, "left")


def box_rescale(boxes: DataFrame, pages: DataFrame) -> DataFrame:
    """Integer coordinates on a page scaled to at most 1000 on either side."""
    ratio = "width / height"
    sized = pages.selectExpr("doc_id", "page_num", f"CASE WHEN width > 1000 THEN 1000D ELSE width END AS w", f"CASE WHEN width > 1000 THEN 1000D / ({ratio}) ELSE height END AS h", f"{ratio} AS r")
    sized = sized.selectExpr("doc_id", "page_num", "CASE WHEN h > 1000 THEN 1000D * r ELSE w END AS w", "CASE WHEN h > 1000 THEN 1000D ELSE h END AS h")
    out = boxes.join(sized, ["doc_id", "page_num"])
    return out.withColumns({f"{c}_px": (F.col(c) * F.col("w" if c[0] == "x" else "h")).cast("int") for c in ("x0", "y0", "x1", "y1")}).drop("w", "h")


def strided_windows(sequences: DataFrame, length_col: str = "n_tokens", window: int = 510, stride: int = 255, key: str = "doc_id") -> DataFrame:
    """key, window_idx, begin, end: windows over a sequence with its two special tokens left out.

    begin and end count the tokens between the special ones, which each window carries as well.
    """
    inner = F.greatest(F.col(length_col) - 2, F.lit(0))
    last = F.greatest(F.lit(0), F.ceil((inner - window) / stride)).cast("int")
    rows = sequences.select(key, inner.alias("__n"), F.explode(F.sequence(F.lit(0), last)).alias("window_idx"))
    return rows.select(key, "window_idx", (F.col("window_idx") * stride).cast("int").alias("begin"), F.least(F.col("window_idx") * stride + window, F.col("__n")).cast("int").alias("end"))


def best_context(sequences: DataFrame, length_col: str = "n_tokens", window: int = 510, stride: int = 255, key: str = "doc_id") -> DataFrame:
    """key, token, window_idx: for each token the window in which it stands farthest from the edges.

    Windows are those of ``strided_windows``; the edges are the special tokens around a window; of
    equals the later window wins.  The few windows that hold a token follow from its place, so every
    token is decided in its own row.
    """
    inner = F.greatest(F.col(length_col) - 2, F.lit(0))
    last = F.greatest(F.lit(0), F.ceil((inner - window) / stride)).cast("int")
    rows = sequences.select(key, inner.alias("__n"), last.alias("__last"), F.explode(F.when(inner > 0, F.sequence(F.lit(0), inner - 1)).otherwise(F.array().cast("array<int>"))).alias("token"))
    first = F.greatest(F.lit(0), (F.floor((F.col("token") - window) / stride) + 1).cast("int"))
    score = lambda w: F.greatest(F.least(F.col("token") - w * stride + 1, F.least(w * stride + window, F.col("__n")) - F.col("token")), F.lit(0))
    held = F.sequence(first, F.least(F.col("__last"), F.floor(F.col("token") / stride).cast("int")))
    return rows.select(key, "token", F.array_max(F.transform(held, lambda w: F.struct(score(w).alias("score"), w.alias("window_idx"))))["window_idx"].alias("window_idx"))


def line_pooling(vectors: DataFrame, keys: tuple[str, ...], vector_col: str = "embedding", mode: str = "mean") -> DataFrame:
    """keys, dim, value: mean, max or sum of the vectors of each line, channel by channel."""
    how = {"mean": F.avg, "max": F.max, "sum": F.sum}[mode]
    each = vectors.select(*keys, F.posexplode(vector_col).alias("dim", "__v"))
    return each.groupBy(*keys, "dim").agg(how(F.col("__v").cast("double")).alias("value"))


def combine_embeddings(rows: DataFrame, cols: list[str], mode: str = "sum", out_col: str = "embedding") -> DataFrame:
    """The element-wise sum of several vectors, or the vectors side by side."""
    if mode == "cat":
        return rows.withColumn(out_col, F.concat(*cols))
    if mode != "sum":
        raise ValueError("mode is sum or cat")
    out = F.col(cols[0])
    for c in cols[1:]:
        out = F.zip_with(out, F.col(c), lambda a, b: a + b)
    return rows.withColumn(out_col, out)


def linear_schedule(step: Column, total: int, peak: float, start: float = 0.0, warmup_rate: float = 0.1) -> Column:
    """A learning rate that rises to its peak over the warm-up and then falls to zero."""
    warm = total * warmup_rate
    up = F.lit(start) + (peak - start) * (step / (warm or 1.0))
    return F.when(step < warm, up).otherwise(peak - peak * ((step - warm) / (total - warm)))


def batch_docs(docs: DataFrame, size: int, key: str = "doc_id") -> DataFrame:
    """Adds batch: consecutive documents, size in each."""
    return numbered(docs, (key,), "batch").withColumn("batch", F.floor(F.col("batch") / size))


def batches(items: list, size: int) -> Iterator[list]:
    """Consecutive lists of at most size items."""
    for i in range(0, len(items), size):
        yield items[i : i + size]
