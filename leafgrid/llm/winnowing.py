"""Benchmark decontamination by winnowing, in DataFrame functions only.

A window is ``span`` consecutive words of an item, or a shorter item as a whole.  A window's grams are
its runs of ``grain`` words, and its fingerprint is the least hash among them.  Equal windows have equal
fingerprints, so every shared run of ``span`` words is found; the converse is decided by the words.

Documents: every gram is hashed; those in a bitmap of the items' fingerprints are looked at, and kept
where they are the least of a window around them.  Each such window is joined with the items' windows by
fingerprint and words; windows that overlap extend each other to the whole shared passage.

Scale: texts are read once and never shuffled; only windows that carry an item's fingerprint leave
their row.  The bitmap has at most BITS bits, whatever the items: a fuller one lets more windows
through to the exact join.  The items' windows are broadcast up to BROADCAST bytes, which are counted
first; beyond that they are joined by a shuffle, whose hot keys adaptive execution splits, since the
items' side has each window once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import forget, materialise

SPAN, GRAIN = 10, 5
BITS = 1 << 22
BROADCAST = 64 << 20
#: Everything but ASCII that is no letter or digit.  Single characters, since the regex engine looks those up in a table.
WORD = "[^" + "".join(f"\\x{i:02X}" for i in range(128) if not chr(i).isalnum()) + "]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PLACE = 31


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _gram(words: Column, i: Column, grain: int) -> Column:
    """Hash of grain words from i on above the place, so that grams compare by hash first."""
    return F.shiftleft(F.xxhash64(*[F.get(words, i + j) for j in range(grain)]), _PLACE).bitwiseOR(i.cast("long"))


def _hash(gram: Column) -> Column:
    return F.shiftright(gram, _PLACE)


def _exact(words: Column, start: Column, size: Column | int) -> Column:
    """The words of a window in lower case, joined by blanks; only A to Z have another case here."""
    return F.translate(F.array_join(F.slice(words, start + 1, size), " "), _UPPER, _LOWER)


def item_windows(items: DataFrame, span: int = SPAN, grain: int = GRAIN, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """f, size, window, items for each distinct window: its fingerprint, words and the sorted ids of its items.

    Ids are strings, null ones empty; repeated items count once; items without words have no window.
    Case is folded beyond ASCII for fingerprints alone, which keeps equal windows equal.
    """
    rows = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("item", _words(F.col("text")).alias("raw"), _words(F.lower("text")).alias("words")).filter(F.size("raw") > 0)
    rows = rows.withColumn("size", F.least(F.size("raw"), F.lit(span)))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.size("raw") - F.col("size"))).alias("start"))
    rows = rows.select("item", "size", _exact(F.col("raw"), F.col("start"), F.col("size")).alias("window"), F.slice("words", F.col("start") + 1, F.col("size")).alias("words"))
    least = lambda g: _hash(F.array_min(F.transform(F.sequence(F.lit(0), F.col("size") - g), lambda i: _gram(F.col("words"), i, g))))
    found = F.coalesce(*[F.when(F.least(F.col("size"), F.lit(grain)) == g, least(g)) for g in range(grain, 0, -1)])
    return rows.select(found.alias("f"), "size", "window", "item").groupBy("f", "size", "window").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _bitmap(windows: DataFrame) -> tuple[Column, int]:
    """The fingerprints as bits, by their last digits, in a literal of bounded size."""
    n = windows.select("f").distinct().count()
    bits = min(BITS, max(1 << 12, 1 << (512 * n).bit_length()))
    at = F.col("f").bitwiseAND(bits - 1)
    found = windows.groupBy(F.shiftright(at, 6).alias("i")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast((f & {bits - 1}) & 63 AS int))")).alias("b")).collect()
    longs = [0] * (bits >> 6)
    for r in found:
        longs[r["i"]] = r["b"]
    return F.from_json(F.lit(str(longs)), "array<bigint>"), bits


def _grams(g: int) -> Column:
    """Every gram of g words."""
    starts = F.slice("words", F.lit(1), F.greatest(F.size("words") - (g - 1), F.lit(0)))
    return F.transform(starts, lambda _, i: _gram(F.col("words"), i, g))


def _near(g: int, m: int) -> Column:
    """The windows of m words in which one of the grams in hits is the least."""

    def around(p: Column) -> Column:
        i = p.bitwiseAND((1 << _PLACE) - 1).cast("int")
        starts = F.filter(F.sequence(F.greatest(i - (m - g), F.lit(0)), i), lambda s: (s + m <= F.col("n_words")) & (_hash(F.array_min(F.slice(f"grams{g}", s + 1, m - g + 1))) == _hash(p)))
        return F.transform(starts, lambda s: F.struct(_hash(p).alias("f"), s.alias("start"), F.lit(m).alias("size")))

    return F.flatten(F.transform(f"hits{g}", around))


def _candidates(rows: DataFrame, lengths: dict[int, list[int]], bitmap: Column, bits: int) -> DataFrame:
    """rows with found: (f, start, size, window) of every window that has a fingerprint of the items' bitmap."""
    at = lambda p: _hash(p).bitwiseAND(bits - 1)
    known = lambda p: F.getbit(F.get(bitmap, F.shiftright(at(p), 6).cast("int")), at(p).bitwiseAND(63).cast("int")) == 1
    rows = rows.select("*", *[_grams(g).alias(f"grams{g}") for g in lengths])
    rows = rows.select("*", *[F.filter(f"grams{g}", known).alias(f"hits{g}") for g in lengths])
    near = [_near(g, m) for g, sizes in lengths.items() for m in sizes]
    rows = rows.select("row", "doc_id", "n_words", "text", (F.concat(*near) if len(near) > 1 else near[0]).alias("near"))
    # Texts are split once more only where windows are left; used twice, so that it stays a step of its own.
    rows = rows.withColumn("raw", F.when(F.size("near") > 0, _words(F.col("text"))))
    window = lambda x: F.struct(x["f"].alias("f"), x["start"].alias("start"), x["size"].alias("size"), _exact(F.col("raw"), x["start"], x["size"]).alias("window"))
    return rows.select("row", "doc_id", "n_words", F.when(F.size("raw") > 0, F.transform("near", window)).alias("found"))


def contamination(docs: DataFrame, items: DataFrame, span: int = SPAN, grain: int = GRAIN, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, items, hits for every row of docs.

    hits: the distinct windows (start, size) in words that the row shares with an item, by start;
    n_hit: the words that they cover; items: the sorted distinct ids of those items as strings.
    Null and empty texts have no words and no hits; repeated rows each get their result; without
    items nothing is hit; null item ids are empty strings; other columns are ignored.
    """
    if not 1 <= grain <= span:
        raise ValueError("a gram is a part of the span")
    windows = materialise(item_windows(items, span, grain, item_col, item_text_col), "windows")
    size = windows.groupBy("size").agg(F.sum(F.octet_length("window") + 64 + F.octet_length(F.array_join("items", " "))).alias("bytes")).collect()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("words", _words(F.lower("text"))).withColumn("n_words", F.size("words").cast("long"))
    if not size:
        forget(windows)
        none = F.array()
        return rows.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), none.cast("array<string>").alias("items"), none.cast("array<struct<start:int,size:int>>").alias("hits"))
    lengths: dict[int, list[int]] = {}
    for m in sorted(r["size"] for r in size):
        lengths.setdefault(min(m, grain), []).append(m)
    found = _candidates(rows, lengths, *_bitmap(windows))
    # A row without candidates keeps a key of its own, so that such rows don't meet in one task.
    each = found.select("row", "doc_id", "n_words", F.explode_outer("found").alias("x")).select("row", "doc_id", "n_words", F.coalesce("x.f", "row").alias("f"), "x.start", F.coalesce("x.size", F.lit(0)).alias("size"), "x.window")
    if sum(r["bytes"] for r in size) <= BROADCAST:
        windows = F.broadcast(windows)
    met = each.join(windows, ["f", "size", "window"], "left")
    hit = F.when(F.col("items").isNotNull(), F.struct("start", "size"))
    both = met.groupBy("row", "doc_id", "n_words").agg(F.array_sort(F.collect_set(hit)).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    zero = F.lit(0).cast("long")
    covered = F.aggregate("hits", F.struct(zero.alias("n"), zero.alias("upto")), lambda a, x: F.struct(
        (a["n"] + F.greatest(x["start"] + x["size"] - F.greatest(a["upto"], x["start"].cast("long")), zero)).alias("n"), F.greatest(a["upto"], (x["start"] + x["size"]).cast("long")).alias("upto")))
    return both.select("doc_id", "n_words", covered["n"].alias("n_hit"), "items", "hits")
