"""Substring deduplication by difference-cover anchors.

A window of 35 words is repeated if its word sequence also starts anywhere else.  Anchors are
shorter windows of 15 words hashed only at positions whose residue modulo 21 lies in a difference
cover: for any two positions some shift below 21 moves both onto the cover, so any two equal windows
contain an equal pair of anchors at the same offset.  Only windows around a repeated anchor are then
hashed whole and counted: that extends the anchors exactly, with no pair of places ever listed.

Scale: the corpus is hashed at 5 of 21 positions; entries move in packed rows, dealt by hash into
parts whose number follows the input, and a very frequent passage sends two entries per task.
Texts move once to meet their repeated anchors; only documents that have some move again.  Windows
are told apart by 95 bits of two independent hashes of their words, and what is told about a row by
the 64 bits of its hash and the 31 bits of a window's second one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .kernel import Chunk, Words, chunks, ragged, span_hashes, windows
from .packets import Answers, Packer, partitions, repeated
from .storage import materialise

WINDOW = 35
# A perfect difference cover; every difference modulo 21 is one of two members.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
ANCHOR = WINDOW - PERIOD + 1
#: Bytes in another order, for a second hash.
_OTHER = np.random.Generator(np.random.PCG64(5)).permutation(256).astype(np.uint8)


def _positions(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, position in the text) of every word of a chunk."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return text, np.arange(len(text)) - first[text]


def _anchors(parts: int, window: int):
    period = PERIOD if window >= WINDOW else 1
    cover = np.isin(np.arange(period), COVER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(parts)
        for batch in batches:
            rid = batch.column(0).to_numpy()
            for c in chunks(batch.column(1)):
                words = c.words()
                key, ok = windows(words.hashes(), words.first, window - period + 1)
                text, at = _positions(words.first)
                hit = np.flatnonzero(ok & cover[at % period])
                yield from packer.add(key[hit], rid[c.lo : c.hi][text[hit]], at[hit])
        yield from packer.flush()

    return run


def _checks(words: Words, window: int) -> np.ndarray:
    """31 bits for the window at each word, from other hashes of its words than its key has."""
    other = span_hashes(_OTHER[words.data], words.start, words.end)
    return (windows(other, words.first, window)[0] >> np.uint64(33)).astype(np.int64)


def _candidates(parts: int, window: int):
    """Hashes of the whole windows that hold a repeated anchor, and checks beside their positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(parts)
        for batch in batches:
            rid = batch.column(0).to_numpy()
            for c in chunks(batch.column(1)):
                words = c.words()
                key, ok = windows(words.hashes(), words.first, window)
                runs = [np.frombuffer(batch.column(2)[i].as_py(), np.int64).reshape(2, -1) for i in range(c.lo, c.hi)]
                number = np.array([r.shape[1] for r in runs], np.int64)
                lo, n = np.concatenate(runs, axis=1)
                at = ragged(lo, n)
                text = np.repeat(np.repeat(np.arange(len(c)), number), n)
                hit = words.first[text] + at
                keep = ok[hit]
                at, check = at[keep], _checks(words, window)[hit[keep]]
                yield from packer.add(key[hit[keep]], rid[c.lo : c.hi][text[keep]], check << 32 | at)
        yield from packer.flush()

    return run


def _kept(c: Chunk, words, removed: np.ndarray) -> tuple[list[str], np.ndarray]:
    """SHA-256 of each text's kept words joined by one space, and how many words were removed."""
    keep = np.flatnonzero(~removed)
    size = words.end[keep] - words.start[keep] + 1
    edge = np.concatenate([[0], np.cumsum(size)])
    out = np.append(c.data, 32)[np.minimum(ragged(words.start[keep], size), len(c.data))].astype(np.uint8)
    out[edge[1:] - 1] = 32
    bound = edge[np.searchsorted(keep, words.first)]
    raw = out.tobytes()
    sha = [hashlib.sha256(raw[a : b - 1] if b > a else b"").hexdigest() for a, b in zip(bound[:-1], bound[1:], strict=True)]
    gone = np.concatenate([[0], np.cumsum(removed)])
    return sha, gone[words.first[1:]] - gone[words.first[:-1]]


def _meet(texts: DataFrame, answers: DataFrame, parts: int, extra: list[str]) -> DataFrame:
    """Each part's answers followed by its texts: (kind, payload, rid, text, ...)."""
    payload = F.lit(None).cast("binary").alias("payload")
    a = answers.select("part", F.lit(0).alias("kind"), "payload", F.lit(None).cast("long").alias("rid"), F.lit(None).cast("string").alias("text"), *[F.lit(None).cast(texts.schema[x].dataType).alias(x) for x in extra])
    t = texts.select(F.pmod("rid", F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("kind"), payload, "rid", "text", *extra)
    return a.unionByName(t).repartitionById(parts, F.col("part")).sortWithinPartitions("kind").drop("part")


def _texts(batch: pa.RecordBatch, answers: Answers) -> pa.RecordBatch:
    """Take a batch's answers; give back its texts."""
    kind = batch.column(0).to_numpy()
    n = int((kind == 0).sum())
    for x in batch.column(1).slice(0, n):
        answers.add(x.as_py())
    return batch.slice(n)


def repeated_windows(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row.

    Words covered by a repeated window are removed, all at once.  Null and empty texts have no words;
    texts shorter than a window keep all; equal rows (same id and text) repeat each other; an empty
    table gives an empty result.  Windows below 35 words are anchored at every position.
    """
    parts = partitions(docs)
    rows = docs.select(F.coalesce(F.xxhash64(id_col, text_col), F.lit(0)).alias("rid"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).alias("doc_id"))
    kind = rows.schema["doc_id"]
    found = repeated(rows.select("rid", "text").mapInArrow(_anchors(parts, window), "part int, kind int, payload binary"), parts)
    period = PERIOD if window >= WINDOW else 1

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers = Answers()
        for batch in batches:
            batch = _texts(batch, answers)
            rid = batch.column(2).to_numpy()
            for c in chunks(batch.column(3)):
                words = c.words()
                text, at = answers.of(rid[c.lo : c.hi])
                size = np.diff(words.first)
                mark = np.zeros(len(words) + 1, np.int64)
                lo = np.maximum(at - period + 1, 0)
                hi = np.minimum(at, size[text] - window)
                ok = hi >= lo
                np.add.at(mark, words.first[text[ok]] + lo[ok], 1)
                np.add.at(mark, words.first[text[ok]] + hi[ok] + 1, -1)
                on = np.cumsum(mark)[:-1] > 0
                which, place = _positions(words.first)
                begin = on & np.concatenate([[True], ~on[:-1]]) | on & (place == 0)
                stop = on & np.concatenate([~on[1:], [True]])
                stop[words.first[1:][size > 0] - 1] |= on[words.first[1:][size > 0] - 1]
                b, e = np.flatnonzero(begin), np.flatnonzero(stop)
                bound = np.searchsorted(b, words.first)
                payload = [np.stack([place[b[x:y]], e[x:y] - b[x:y] + 1]).astype(np.int64).tobytes() if y > x else None for x, y in zip(bound[:-1], bound[1:], strict=True)]
                sha, _ = _kept(c, words, np.zeros(len(words), bool))
                part = batch.slice(c.lo, len(c))
                rest = pa.RecordBatch.from_arrays([part.column(4), part.column(2), part.column(3), pa.array(size), pa.array(sha), pa.array(payload, pa.binary())], ["doc_id", "rid", "text", "n_words", "sha", "runs"])
                open_ = rest.column(5).is_valid()
                done = rest.filter(pa.compute.invert(open_))
                yield rest.filter(open_)
                yield done.set_column(2, "text", pa.nulls(len(done), part.column(3).type))

    schema = StructType([kind, *StructType.fromDDL("rid bigint, text string, n_words bigint, sha string, runs binary").fields])
    state = materialise(_meet(rows, found, parts, ["doc_id"]).mapInArrow(runs, schema), "runs")
    done = state.filter("runs is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"))
    rest = state.filter("runs is not null").select("rid", "text", "runs", "doc_id")
    found = repeated(rest.select("rid", "text", "runs").mapInArrow(_candidates(parts, window), "part int, kind int, payload binary"), parts)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers = Answers()
        for batch in batches:
            batch = _texts(batch, answers)
            rid = batch.column(2).to_numpy()
            for c in chunks(batch.column(3)):
                words = c.words()
                text, number = answers.of(rid[c.lo : c.hi])
                at = number & 0xFFFFFFFF
                # A window that another row of the same hash was asked about has another check.
                own = at + window <= np.diff(words.first)[text]
                own[own] = _checks(words, window)[words.first[text[own]] + at[own]] == number[own] >> 32
                text, at = text[own], at[own]
                mark = np.zeros(len(words) + 1, np.int64)
                np.add.at(mark, words.first[text] + at, 1)
                np.add.at(mark, words.first[text] + at + window, -1)
                sha, gone = _kept(c, words, np.cumsum(mark)[:-1] > 0)
                yield pa.RecordBatch.from_arrays([batch.column(4).slice(c.lo, len(c)), pa.array(np.diff(words.first)), pa.array(gone), pa.array(sha)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    schema = StructType([kind, *StructType.fromDDL("n_words bigint, n_removed bigint, kept_sha256 string").fields])
    return done.unionByName(_meet(rest, found, parts, ["doc_id"]).mapInArrow(remove, schema))
