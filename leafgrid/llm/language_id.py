"""Language identification by rank-order profiles of character n-grams.

A language's profile is its TOP most frequent 1- to 3-grams over all its training documents.  A
document's own TOP n-grams are compared with each profile by out-of-place distance: the sum over
the document's n-grams of how far their ranks differ, TOP for those that the profile lacks.

Characters are code points: letters and the marks that go with them, in lower case by a table over
all of Unicode; runs of others are one boundary.  An n-gram is a 40-bit hash of its code points.

Scale: training is one pass that leaves one count per language, n-gram and task (a task passes its
counts on whenever it holds HELD of them), summed with map-side combine; profiles hold TOP entries
for each language, which is all that reaches the driver and every worker.  Prediction is one pass
over whole texts without a shuffle.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

from .kernel import Chunk, chunks, mix
from .storage import free_name

TOP = 300
HELD = 1 << 20
_BITS = 40


@lru_cache(1)
def folds() -> np.ndarray:
    """For each code point its lower case if it is a letter or a mark, else 0."""
    out = np.zeros(0x110000, np.int32)
    for i in range(0x33480):
        c = chr(i)
        if unicodedata.category(c)[0] in "LM":
            low = c.casefold()
            out[i] = ord(low if len(low) == 1 else c.lower()[0])
    return out


def code_points(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts and the text of each."""
    b = np.concatenate([chunk.data, np.zeros(3, np.uint8)]).astype(np.int32)
    at = np.flatnonzero((chunk.data & 0xC0) != 0x80)
    lead, x, y, z = (b[at + k] if k == 0 else b[at + k] & 0x3F for k in range(4))
    cp = np.select(
        [lead < 0x80, lead < 0xE0, lead < 0xF0],
        [lead, (lead & 0x1F) << 6 | x, (lead & 0x0F) << 12 | x << 6 | y],
        (lead & 0x07) << 18 | x << 12 | y << 6 | z,
    )
    return np.minimum(cp, 0x10FFFF), np.searchsorted(chunk.at, at, "right") - 1


def _symbols(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Folded letters of all texts, runs of other characters folded to one boundary, and each one's text."""
    cp, text = code_points(chunk)
    symbol = folds()[cp]
    again = np.zeros(len(symbol), bool)
    again[1:] = (symbol[1:] == 0) & (symbol[:-1] == 0) & (text[1:] == text[:-1])
    return symbol[~again], text[~again]


def gram_keys(*symbols: np.ndarray) -> np.ndarray:
    """A number of _BITS bits for each n-gram."""
    out = np.zeros(len(symbols[0]), np.uint64)
    for s in symbols:
        out = out * np.uint64(0x110001) + s.astype(np.uint64) + np.uint64(1)
    return (mix(out) >> np.uint64(64 - _BITS)).astype(np.int64)


def _grams(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, n-gram, count), sorted by text and n-gram; a lone boundary is no n-gram."""
    s, t = _symbols(chunk)
    found = []
    for lo in range(0, max(1, len(chunk)), 1 << 23):  # texts that fit beside a hash in one number
        base = (t - lo).astype(np.int64) << _BITS
        ok = (t >= lo) & (t < lo + (1 << 23))
        for n in (1, 2, 3):
            if len(s) < n:
                continue
            last = len(s) - n + 1
            key = base[:last] + gram_keys(*[s[k : last + k] for k in range(n)])
            found.append((lo, key[ok[:last] & ((s > 0) if n == 1 else t[:last] == t[n - 1 :])]))
    out = []
    for lo in dict.fromkeys(x for x, _ in found):
        keys = np.sort(np.concatenate([k for x, k in found if x == lo]))
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        out.append(((keys[at] >> _BITS) + lo, keys[at] & ((1 << _BITS) - 1), np.diff(np.append(at, len(keys)))))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def _top(text: np.ndarray, gram: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, n-gram, rank) of each text's TOP n-grams: by count downwards, then n-gram."""
    order = np.lexsort((gram, -count, text))
    text, gram = text[order], gram[order]
    begin = np.searchsorted(text, text)
    rank = np.arange(len(text)) - begin
    keep = rank < TOP
    return text[keep], gram[keep], rank[keep]


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    gram, count = (np.concatenate(x) for x in zip(*held, strict=True))
    gram, place = np.unique(gram, return_inverse=True)
    return gram, np.bincount(place, count, len(gram)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, held in sums.items():
            gram, n = _summed(held)
            for i in range(0, len(gram), 10000):
                part = gram[i : i + 10000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(part), pa.array(n[i : i + 10000])], ["lang", "gram", "n"])

    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        for c in chunks(batch.column(1)):
            text, gram, count = _grams(c)
            names, place = np.unique(langs[c.lo : c.hi].astype(str), return_inverse=True)
            own = place[text]
            for k, lang in enumerate(names.tolist()):
                hit = own == k
                sums.setdefault(lang, []).append(_summed([(gram[hit], count[hit])]))
            if sum(len(g) for held in sums.values() for g, _ in held) > HELD:
                sums = {lang: [_summed(held)] for lang, held in sums.items()}
            if sum(len(g) for held in sums.values() for g, _ in held) > HELD:
                yield from out()
                sums = {}
    yield from out()


def train_profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, list[int]]:
    """The TOP n-grams of each language, most frequent first; rows with a null language are left out."""
    rows = docs.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sums = rows.mapInArrow(_count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    found = sums.select("lang", "gram", rank.alias("rank")).filter(F.col("rank") <= TOP).orderBy("lang", "rank").collect()
    profiles: dict[str, list[int]] = {}
    for r in found:
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


def _ranks(profile: list[int], gram: np.ndarray) -> np.ndarray:
    """Each n-gram's rank in a profile, -1 for those that it lacks."""
    if not profile:
        return np.full(len(gram), -1)
    order = np.argsort(profile)
    known = np.array(profile, np.int64)[order]
    at = np.minimum(np.searchsorted(known, gram), len(known) - 1)
    return np.where(known[at] == gram, order[at], -1)


def identify(docs: DataFrame, profiles: dict[str, list[int]], text_col: str = "text") -> DataFrame:
    """All columns of docs, lang_pred and score.

    score is one minus the distance as a share of the greatest possible, 0 for a text without an
    n-gram.  A null text or one without a letter is ``und`` with score 0, as is every text if there are
    no profiles; equal distances go to the first language by name.  Columns of docs with the names of
    the results are replaced.
    """
    names = sorted(profiles)
    docs = docs.drop("lang_pred", "score")
    letter = free_name(docs, "letter")
    docs = docs.withColumn(letter, F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lettered = batch.column(batch.schema.get_field_index(letter)).to_numpy(zero_copy_only=False)
            for c in chunks(batch.column(batch.schema.get_field_index(text_col))):
                text, gram, rank = _top(*_grams(c))
                gram, place = np.unique(gram, return_inverse=True)
                apart = [np.bincount(text, np.where(r[place] < 0, TOP, np.abs(r[place] - rank)), len(c)) for r in (_ranks(profiles[n], gram) for n in names)]
                far = np.stack(apart) if names else np.zeros((1, len(c)))
                best = far.argmin(0)
                ok = lettered[c.lo : c.hi] & bool(names)
                grams = np.bincount(text, minlength=len(c))
                score = np.where(ok & (grams > 0), 1 - far[best, np.arange(len(c))] / np.maximum(1, TOP * grams), 0.0)
                said = [names[b] if o else "und" for b, o in zip(best, ok, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.slice(c.lo, len(c)).columns, pa.array(said, pa.string()), pa.array(score)], [*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema).drop(letter)


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2
