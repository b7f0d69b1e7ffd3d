"""Packed shuffles: many small numbers about many documents in few binary rows.

A task packs entries (key, document, number) by the part that their key belongs to, so a shuffle
moves one row per task and part instead of one per entry.  ``repeated`` sorts a part's entries and
tells every document which of its entries share their key with another entry.

A key that occurs twice within one task is known to be repeated there: its entries skip the count
(they pass through) and only two stand-ins go on, so a key in a third of all documents
sends at most two entries per task.

A number may carry a check in its upper 32 bits, which then counts as part of its key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS, SURE = 0, 1
FLUSH = 1 << 19
ROW = "part int, kind int, payload binary"


def partitions(docs: DataFrame) -> int:
    """Parts to deal entries into: as many as the input has splits, so a part's size is bounded."""
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())


def dump(doc: np.ndarray, number: np.ndarray, key: np.ndarray | None = None) -> bytes:
    """Entries as bytes: documents run-length coded, numbers in as few bytes as they need."""
    begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
    most = int(number.max()) if len(number) else 0
    wide = np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64
    head = np.array([len(begin), len(doc), np.dtype(wide).itemsize], np.uint32)
    parts = [head, doc[begin].astype(np.int64), np.diff(np.append(begin, len(doc))).astype(np.uint32), number.astype(wide)]
    return b"".join(p.tobytes() for p in parts) + (key.tobytes() if key is not None else b"")


def load(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, number, key) of each entry; no keys if none were dumped."""
    docs, n, wide = np.frombuffer(raw, np.uint32, 3)
    at = 12
    doc = np.frombuffer(raw, np.int64, docs, at)
    at += 8 * int(docs)
    count = np.frombuffer(raw, np.uint32, docs, at)
    at += 4 * int(docs)
    number = np.frombuffer(raw, f"<u{int(wide)}", n, at)
    at += int(wide) * int(n)
    key = np.frombuffer(raw, np.uint64, -1, at) if at < len(raw) else np.zeros(0, np.uint64)
    return np.repeat(doc, count), number.astype(np.int64), key


def pack_planes(*columns: np.ndarray) -> bytes:
    """Equally long columns of 32-bit numbers, byte by byte of equal weight and compressed."""
    n = len(columns[0])
    raw = np.ascontiguousarray(np.stack(columns).astype("<u4").view(np.uint8).reshape(len(columns), n, 4).transpose(0, 2, 1)).tobytes()
    small = pa.compress(raw, codec="zstd", asbytes=True) if len(raw) > 64 else raw
    return np.uint32(n * 2 + (small is not raw)).tobytes() + small


def unpack_planes(raw: bytes, columns: int) -> np.ndarray:
    """The columns that pack_planes packed, one row each."""
    head = int(np.frombuffer(raw, "<u4", 1)[0])
    n, body = head >> 1, raw[4:]
    if head & 1:
        body = pa.decompress(body, decompressed_size=4 * columns * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(columns, 4, n).transpose(0, 2, 1)).view("<u4").reshape(columns, n)


def by_part(part: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The columns' entries of each part, in their order."""
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    part = part[order]
    edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    for lo, hi in zip(edge, np.append(edge[1:], len(part)), strict=True):
        yield int(part[lo]), [c[order[lo:hi]] for c in columns]


def rows(found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    part, kind, payload = zip(*found, strict=True) if found else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(payload, pa.binary())], ["part", "kind", "payload"])


def _alike(key: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by key and check, and whether each entry has those of the one before it."""
    check = number.astype(np.uint64) >> np.uint64(32)
    order = np.lexsort((check, key)) if check.any() else np.argsort(key, kind="stable")
    s, c = key[order], check[order]
    return order, (s[1:] == s[:-1]) & (c[1:] == c[:-1])


class Packer:
    """Collects entries (key, document, number) of one task and gives them out as rows."""

    def __init__(self, parts: int):
        self.parts, self.held, self.size = parts, [], 0

    def add(self, key: np.ndarray, doc: np.ndarray, number: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((key, doc, number))
        self.size += len(key)
        if self.size >= FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        key, doc, number = (np.concatenate(c) for c in zip(*self.held, strict=True))
        self.held, self.size = [], 0
        order, same = _alike(key, number)
        again, twice = np.concatenate([[False], same]), np.concatenate([same, [False]])
        third = np.concatenate([[False], again[1:] & again[:-1]])
        sure, go = np.zeros(len(key), bool), np.ones(len(key), bool)
        sure[order] = again | twice
        go[order] = ~third
        found = [(p, KEYS, dump(d, n, k)) for p, (k, d, n) in by_part((key[go] % np.uint64(self.parts)).astype(np.int64), key[go], doc[go], number[go])]
        found += [(p, SURE, dump(d, n)) for p, (d, n) in by_part(doc[sure] % self.parts, doc[sure], number[sure])]
        yield rows(found)


def repeated(packed: DataFrame, parts: int) -> DataFrame:
    """Rows (part of the document, payload of document and number) of all entries whose key is repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            kinds = batch.column(1).to_numpy()
            sure = [i for i in range(len(kinds)) if kinds[i] == SURE]
            if sure:
                yield batch.take(pa.array(sure))
            held += [load(batch.column(2)[i].as_py()) for i in range(len(kinds)) if kinds[i] == KEYS]
        if held:
            doc, number, key = (np.concatenate(c) for c in zip(*held, strict=True))
            order, same = _alike(key, number)
            hit = np.sort(order[np.concatenate([[False], same]) | np.concatenate([same, [False]])])
            if len(hit):
                yield rows([(p, SURE, dump(d, n)) for p, (d, n) in by_part(doc[hit] % parts, doc[hit], number[hit])])

    return packed.repartitionById(parts, F.col("part")).mapInArrow(run, ROW)


class Answers:
    """Numbers by document, gathered from payloads that reach one task."""

    def __init__(self):
        self.held, self.doc, self.number = [], None, None

    def add(self, raw: bytes) -> None:
        self.held.append(load(raw)[:2])

    def of(self, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into doc, number) of every entry of these documents."""
        from .kernel import ragged

        if self.doc is None:
            d, n = (np.concatenate(c) for c in zip(*self.held, strict=True)) if self.held else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            order = np.argsort(d, kind="stable")
            self.doc, self.number, self.held = d[order], n[order], []
        lo, hi = np.searchsorted(self.doc, doc, "left"), np.searchsorted(self.doc, doc, "right")
        return np.repeat(np.arange(len(doc)), hi - lo), self.number[ragged(lo, hi - lo)]
