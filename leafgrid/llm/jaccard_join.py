"""Similarity join of documents by Jaccard similarity of their word shingles, with its components.

Documents with equal shingle sets form one class, and classes are joined.  A token is a shingle's
hash.  Tokens are counted over the whole corpus and fall into classes: unique ones, rare ones
(in at most RARE documents) and frequent ones, which have tiers by the digits of their count.  Sets
are ordered by class and tier, and a set's prefix is as long as the number of tokens that a linked
set may lack, plus one: linked sets share a token within both prefixes.  A set whose prefix is all
unique is linked with nothing and leaves.  Rare and cool tokens (in fewer than 2**COOL documents) of
a prefix are indexed alone.  A prefix that reaches tokens beyond is extended, and combinations of k
consecutive frequent tokens are indexed: two linked sets without a common rare token have e differing frequent tokens at most, so
of their first (k-1)(e+1)+1 common ones some k follow each other in both.  Texts that share a common
passage or template have it at the end of their order and seldom reach it.  Candidates within the
bounds of unique tokens and bitmaps are verified on the whole sets.

Scale: the count moves about 4 bytes for each token, packed and dealt by hash into parts whose number
follows the input; a token in very many documents sends RARE + 1 entries per task.  Equal sets of a
task count once.  Only sets that may be linked go on.  A combination that more than BLOCK classes of
a task share pairs them with one head there, the one with the fewest tokens of its own, and sends the
head on; heads meet the same way, so a group of near copies gives a star of candidates and no task
holds it whole.  What the stars leave in different components is compared afterwards in slots of
about LATE, so no link is lost: first by bounds that need no text (tokens of its own, and bitmaps of
the others).  Each class left outside is linked to its closest one, and then the pairs within the
bounds that are still in different components are listed.

Tokens are 64-bit hashes and classes 128-bit ones.  Class ids are 64 bits of those; should two
classes have one id, all ids are drawn again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .components import forest_roots, joined_roots
from .kernel import Chunk, chunks, mix, windows
from .packets import by_part, pack_planes, partitions, unpack_planes
from .storage import forget, materialise, only_rows, row_key

SHINGLE, PERCENT = 4, 85
RARE, BLOCK, FLUSH, LATE, BITS = 4, 16, 1 << 20, 1024, 1024
#: Frequent tokens by the binary digits of how many documents have them: those in fewer than 64 are cool.
COOL, _TIER, _UNKNOWN = 6, 6, 63
_ROW = "part int, kind int, block bigint, payload binary"
_LIST, _HEAD, _ANSWER = 0, 1, 2
_KEYS, _PAIRS = 0, 1
_SET = "cid bigint, n bigint, rest bigint, rare binary, many binary, alone bigint, bits binary, cool binary"
_HALF = np.uint64(32)
_LOW = np.uint64(0xFFFFFFFF)


def shingle_sets(c: Chunk, k: int = SHINGLE) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes: of k words, or of all if there are fewer."""
    words = c.words(lower=True)
    h = words.hashes()
    size = np.diff(words.first)
    key, ok = windows(h, words.first, k)
    for short in range(1, k):
        at = words.first[:-1][size == short]
        if len(at):
            key[at] = mix(windows(h, words.first, short)[0][at] + np.uint64(short))
            ok[at] = True
    bound = np.concatenate([[0], np.cumsum(ok)])[words.first]
    key = key[ok]
    return [np.unique(key[a:b]) for a, b in zip(bound[:-1], bound[1:], strict=True)]


def _set_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _class_ids(keys: list[bytes], seed: int) -> np.ndarray:
    """Ids of classes: 64 bits of their keys, other ones for each seed."""
    both = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)
    return mix(both[:, 0] + mix(both[:, 1] + np.uint64(seed))).view(np.int64)


def _describe(k: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(2)):
                sets = shingle_sets(c, k)
                keys = [_set_key(s) for s in sets]
                part = batch.slice(c.lo, len(c))
                n = np.array([len(s) for s in sets], np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), pa.array(keys, pa.binary()), pa.array(_class_ids(keys, seed))], ["doc_id", "row_key", "n", "set_key", "cid"])

    return run


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted keys: each entry's place in its run and the run's length."""
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    length = np.diff(np.append(begin, len(key)))
    return np.arange(len(key)) - np.repeat(begin, length), np.repeat(length, length)


def _rows(found: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    part, kind, block, payload = zip(*found, strict=True) if found else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(block, pa.int64()), pa.array(payload, pa.binary())], ["part", "kind", "block", "payload"])


def _tokens(parts: int, k: int, percent: int, seed: int):
    """Lists of (token, document) for each part, and a head that names each block's documents.

    A block is what a task holds at a time: FLUSH tokens or a few thousand for each part.  A document's
    token has its part in the upper half and 32 bits of its hash below.
    """
    flush_at = max(FLUSH, min(64 * parts, 8 * FLUSH))
    least = -(-percent // max(1, 100 - percent))

    def flush(cids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        cid, n = np.array(cids, np.int64), np.array([len(s) for s in sets], np.int64)
        block = int.from_bytes(hashlib.blake2b(cid.tobytes(), digest_size=8).digest(), "big", signed=True)
        token = np.concatenate(sets)
        token = (((token >> _HALF) % np.uint64(parts)) << _HALF) | (token & _LOW)
        order = np.argsort(token, kind="stable")
        token, doc = token[order], np.repeat(np.arange(len(sets), dtype=np.uint32), n)[order]
        place, length = _runs(token)
        home = block % parts
        found = [(home, _HEAD, block, cid.tobytes() + n.tobytes())]
        known = np.flatnonzero((length > RARE) & (place > RARE))
        if len(known):
            found.append((home, _ANSWER, block, _answer(token[known], doc[known], np.full(len(known), _UNKNOWN))))
        go = place <= RARE
        stands = np.where(place == RARE, length - RARE, 1).astype(np.uint32)[go]
        token, doc = token[go], doc[go]
        part = (token >> _HALF).astype(np.int64)
        edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        low = (token & _LOW).astype(np.uint32)
        for lo, hi in zip(edge, np.append(edge[1:], len(part)), strict=True):
            found.append((int(part[lo]), _LIST, block, pack_planes(np.diff(low[lo:hi], prepend=np.uint32(0)), doc[lo:hi], stands[lo:hi])))
        return _rows(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cids, sets, size = {}, [], 0
        for batch in batches:
            for c in chunks(batch.column(0)):
                own = [s for s in shingle_sets(c, k) if len(s) >= least]
                for cid, s in zip(_class_ids([_set_key(s) for s in own], seed).tolist() if own else [], own, strict=True):
                    if cid in cids:
                        continue
                    cids[cid] = None
                    sets.append(s)
                    size += len(s)
                    if size >= flush_at:
                        yield flush(list(cids), sets)
                        cids, sets, size = {}, [], 0
        if size:
            yield flush(list(cids), sets)

    return run


def _answer(token: np.ndarray, doc: np.ndarray, tier: np.ndarray) -> bytes:
    return pack_planes((token >> _HALF).astype(np.uint32), (token & _LOW).astype(np.uint32), (doc << np.uint32(_TIER)) | tier.astype(np.uint32))


def _digits(n: np.ndarray) -> np.ndarray:
    return np.frexp(n.astype(np.float64))[1]


def _count(parts: int):
    """Tell each block its documents' tokens that others have too: tier 0 if rare, else the digits of their count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, blocks, lows, docs, stands = None, [], [], [], []
        for batch in batches:
            kind = batch.column(1).to_numpy()
            rest = np.flatnonzero(kind != _LIST)
            if len(rest):
                yield batch.take(pa.array(rest))
            for i in np.flatnonzero(kind == _LIST):
                delta, doc, stand = unpack_planes(batch.column(3)[i].as_py(), 3)
                part = batch.column(0)[i].as_py()
                blocks.append(batch.column(2)[i].as_py())
                lows.append(np.cumsum(delta, dtype=np.uint32))
                docs.append(doc)
                stands.append(stand)
        if not blocks:
            return
        source = np.repeat(np.arange(len(blocks), dtype=np.uint32), [len(x) for x in lows])
        order = (np.concatenate(lows).astype(np.uint64) << _HALF) | np.arange(len(source), dtype=np.uint64)
        order.sort()
        low, at = order >> _HALF, (order & _LOW).astype(np.int64)
        _, length = _runs(low)
        begin = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        count = np.repeat(np.add.reduceat(np.concatenate(stands)[at].astype(np.int64), begin), length[begin])
        hit = count > 1
        low, at, count = low[hit], at[hit], count[hit]
        doc, source = np.concatenate(docs)[at], source[at]
        token = (np.uint64(part) << _HALF) | low
        for b, (t, d, f) in by_part(source.astype(np.int64), token, doc, np.where(count > RARE, _digits(count), 0)):
            yield _rows([(blocks[b] % parts, _ANSWER, blocks[b], _answer(t, d, f))])

    return run


def _told(token: np.ndarray, tier: np.ndarray) -> np.ndarray:
    """Tiers with those that a block didn't know taken from its own entries of the same token."""
    if not len(token):
        return tier
    order = np.argsort(token, kind="stable")
    begin = np.flatnonzero(np.concatenate([[True], token[order][1:] != token[order][:-1]]))
    known = np.maximum.reduceat(np.where(tier == _UNKNOWN, 0, tier)[order], begin)
    out = np.empty_like(tier)
    out[order] = np.repeat(known, np.diff(np.append(begin, len(token))))
    return out


def _prefixes(percent: int):
    """The sets that may be linked: class, size, unique and rare tokens, prefix of rare and of frequent ones,
    unique tokens, a bitmap in which every other token turns a bit, and the cool tokens of the prefix.

    Frequent tokens go by their tier, so a prefix has the least frequent ones.  A prefix without a
    token beyond the cool ones needs no combinations: what it shares with a linked set's is rare or cool.
    """

    def settle(head: bytes, answers: list[bytes]) -> pa.RecordBatch:
        cid, n = np.frombuffer(head, np.int64).reshape(2, -1)
        high, low, mark = (np.concatenate(x) for x in zip(*(unpack_planes(a, 3) for a in answers), strict=True)) if answers else (np.zeros(0, np.uint32),) * 3
        token = (high.astype(np.uint64) << _HALF) | low
        tier = _told(token, (mark & np.uint32(_UNKNOWN)).astype(np.int64))
        doc = (mark >> np.uint32(_TIER)).astype(np.int64)
        order = np.lexsort((token, tier, doc))
        token, doc, tier = token[order], doc[order], tier[order]
        frequent = tier > 0
        rare, many = np.bincount(doc[~frequent], minlength=len(n)), np.bincount(doc[frequent], minlength=len(n))
        need = -(-percent * n // 100)
        at = np.concatenate([[0], np.cumsum(rare + many)])
        out: list[tuple] = []
        for i in np.flatnonzero(rare + many >= need):
            unique = int(n[i] - rare[i] - many[i])
            reach = max(0, int(n[i] - need[i]) + 1 - unique)
            mine, late = token[at[i] : at[i + 1]], tier[at[i] + rare[i] : at[i] + max(rare[i], reach)]
            own, rest = mine[: min(reach, rare[i])], unique + int(rare[i])
            differ = (100 - percent) * int(n[i]) // percent - rest
            far = max(combination_sizes(int(n[i]), percent), default=0) * (differ + 1) if (late > COOL).any() else 0
            bits = np.packbits(np.bincount(mix(mine) % np.uint64(BITS), minlength=BITS) % 2 == 1)
            cool = mine[rare[i] : rare[i] + len(late)][late <= COOL]
            out.append((int(cid[i]), int(n[i]), rest, own.tobytes(), mine[rare[i] : rare[i] + far].tobytes(), unique, bits.tobytes(), cool.tobytes()))
        columns = zip(*out, strict=True) if out else [()] * 8
        long, raw = pa.int64(), pa.binary()
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (long, long, long, raw, raw, long, raw, raw), strict=True)], ["cid", "n", "rest", "rare", "many", "alone", "bits", "cool"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, head, answers = None, None, []
        for batch in batches:
            for kind, b, payload in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if b != block:
                    if head is not None:
                        yield settle(head, answers)
                    block, head, answers = b, None, []
                if kind == _HEAD:
                    head = payload.as_py()
                else:
                    answers.append(payload.as_py())
        if head is not None:
            yield settle(head, answers)

    return run


@lru_cache(1 << 16)
def combination_sizes(n: int, percent: int = PERCENT) -> tuple[int, ...]:
    """How many tokens a combination of a set of n has: two linked sets always have a size in common.

    Linked sets with u tokens in all differ in d = (100 - percent) * u // 100 at most, and their u - d
    common tokens suffice for k if u >= k * (d + 1).  Both sets use the k of every u they can have.
    """
    u = np.arange(n, 100 * n // percent + 1)
    d = (100 - percent) * u // 100
    k = np.minimum(u // (d + 1), 3)
    return tuple(np.unique(k[d > 0]).tolist())


Entries = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _rare_tokens(batch: pa.RecordBatch) -> Iterator[Entries]:
    """(key, class, size, tokens of its own) of every rare token."""
    sets = [np.frombuffer(x.as_py(), np.uint64) for x in batch.column(3)]
    size = np.array([len(s) for s in sets], np.int64)
    if size.sum():
        yield np.concatenate(sets), *(np.repeat(batch.column(i).to_numpy(), size) for i in (0, 1, 2))


def _combinations(percent: int):
    """(key, class, size, tokens of its own) of every cool token and every combination."""

    def tokens(batch: pa.RecordBatch) -> Iterator[Entries]:
        for cid, n, rest, raw, cool in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4, 7)), strict=True):
            if cool:
                key = mix(np.frombuffer(cool, np.uint64) + np.uint64(BITS))
                yield key, np.full(len(key), cid), np.full(len(key), n), np.full(len(key), rest)
            many = np.frombuffer(raw, np.uint64)
            differ = (100 - percent) * n // percent - rest
            for size in combination_sizes(n, percent):
                reach = many[: size * (differ + 1)]
                key, ok = windows(reach, np.array([0, len(reach)]), size)
                key = mix(key[ok] + np.uint64(size))
                yield key, np.full(len(key), cid), np.full(len(key), n), np.full(len(key), rest)

    return tokens


def _sorted(held: list[Entries]) -> Entries:
    """All entries by key, then fewest own tokens."""
    columns = [np.concatenate(c) for c in zip(*held, strict=True)]
    order = np.lexsort((columns[1], columns[3], columns[0]))
    return tuple(c[order] for c in columns)


def _held(batches: Iterator[pa.RecordBatch], tokens: Callable) -> Iterator[Entries]:
    """The entries of a task in sorted runs of about FLUSH."""
    held, size = [], 0
    for batch in batches:
        for entry in tokens(batch):
            held.append(entry)
            size += len(entry[0])
            if size >= FLUSH:
                yield _sorted(held)
                held, size = [], 0
    if size:
        yield _sorted(held)


def _pack(parts: int, tokens: Callable, percent: int, stars: bool):
    """Pack entries by key; with stars, classes of a hot key meet its head here and only that goes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, cid, n, rest in _held(batches, tokens):
            found, hot, go = [], np.zeros(len(key), bool), np.ones(len(key), bool)
            if stars:
                place, length = _runs(key)
                hot = length > BLOCK
                pairs = _stars(key[hot], cid[hot], n[hot], rest[hot], percent)
                if len(pairs):
                    found.append((int(pairs[0, 0]) % parts, _PAIRS, 0, pairs.tobytes()))
                go = ~hot | (place == 0)
            for p, (x, c, m, r, h) in by_part((key[go] % np.uint64(parts)).astype(np.int64), key[go], cid[go], n[go], rest[go], hot[go]):
                halves = [y for v in (x, c.view(np.uint64)) for y in (v >> _HALF, v & _LOW)]
                found.append((p, _KEYS, 0, pack_planes(*halves, m, r * 2 + h)))
            yield _rows(found)

    return run


def _unpack(raw: bytes) -> tuple[np.ndarray, ...]:
    a, b, c, d, n, mark = unpack_planes(raw, 6).astype(np.uint64)
    return (a << _HALF) | b, ((c << _HALF) | d).view(np.int64), n.astype(np.int64), mark.astype(np.int64)


def _allowed(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """In how many tokens linked sets of these sizes may differ."""
    return (100 - percent) * (n + m) // (100 + percent)


def _fitting(cid: np.ndarray, n: np.ndarray, rest: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Pairs (smaller, larger) whose sizes and own tokens let them be linked.

    Pairs that share a rare token are candidates by that; others differ in all their own tokens.
    """
    fit = (np.maximum(np.abs(n[i] - n[j]), rest[i] + rest[j]) <= _allowed(n[i], n[j], percent)) & (cid[i] != cid[j])
    a, b = cid[i[fit]], cid[j[fit]]
    return np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)


def _pairs(key: np.ndarray, cid: np.ndarray, n: np.ndarray, rest: np.ndarray, percent: int, most: int, ok: np.ndarray) -> np.ndarray:
    """Distinct fitting pairs of entries in runs of at most most."""
    out = [np.zeros((0, 2), np.int64)]
    for o in range(1, most):
        i = np.flatnonzero(ok[:-o] & (key[:-o] == key[o:])) if len(key) > o else np.zeros(0, np.int64)
        out.append(_fitting(cid, n, rest, i, i + o, percent))
    return np.unique(np.concatenate(out), axis=0)


def _stars(key: np.ndarray, cid: np.ndarray, n: np.ndarray, rest: np.ndarray, percent: int) -> np.ndarray:
    """Distinct fitting pairs of each run's first entry with its others."""
    place, _ = _runs(key)
    i = np.flatnonzero(place > 0)
    return np.unique(_fitting(cid, n, rest, i - place[i], i, percent), axis=0)


def _batch(pairs: np.ndarray, hot: np.ndarray) -> pa.RecordBatch:
    n, m = len(pairs), len(hot)
    none = np.concatenate([np.zeros(n, bool), np.ones(m, bool)])
    return pa.RecordBatch.from_arrays([
        pa.array(np.concatenate([np.zeros(n, np.int64), hot.view(np.int64)])),
        pa.array(np.concatenate([pairs[:, 0], np.zeros(m, np.int64)]), mask=none),
        pa.array(np.concatenate([pairs[:, 1], np.zeros(m, np.int64)]), mask=none),
    ], ["key", "a", "b"])


def _gather(percent: int, stars: bool):
    """Candidates of a part: (0, a, b), and (key, null, null) for each hot key."""
    most = BLOCK if stars else RARE + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, none = [], np.zeros(0, np.uint64)
        for batch in batches:
            for kind, payload in zip(batch.column(1).to_pylist(), batch.column(3), strict=True):
                if kind == _PAIRS:
                    yield _batch(np.frombuffer(payload.as_py(), np.int64).reshape(-1, 2), none)
                else:
                    held.append(_unpack(payload.as_py()))
        if not held:
            return
        key, cid, n, mark = _sorted(held)
        if not stars:
            yield _batch(_pairs(key, cid, n, np.zeros(len(key), np.int64), percent, most, np.ones(len(key), bool)), none)
            return
        _, length = _runs(key)
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        hot = np.repeat(np.maximum.reduceat(mark & 1, begin) > 0, length[begin]) | (length > most)
        rest = mark >> 1
        pairs = np.concatenate([_pairs(key, cid, n, rest, percent, most, ~hot), _stars(key[hot], cid[hot], n[hot], rest[hot], percent)])
        yield _batch(np.unique(pairs, axis=0), np.unique(key[hot]))

    return run


def _candidates(sets: DataFrame, parts: int, tokens: Callable, percent: int, stars: bool) -> DataFrame:
    packed = sets.mapInArrow(_pack(parts, tokens, percent, stars), _ROW)
    return packed.repartitionById(parts, F.col("part")).mapInArrow(_gather(percent, stars), "key bigint, a bigint, b bigint")


def _verify(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b of the pairs whose sets are as similar as asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [(s for c in chunks(batch.column(i)) for s in shingle_sets(c, k)) for i in (2, 3)]
            ok = []
            for x, y in zip(*sides, strict=True):
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                ok.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    a = texts.select(F.col("cid").alias("a"), F.col("text").alias("ta"))
    b = texts.select(F.col("cid").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").select("a", "b", "ta", "tb")
    return both.mapInArrow(run, "a bigint, b bigint")


def _bounded(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, votes) that may be linked as far as unique tokens and bitmaps tell, without their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m, own, other = (batch.column(i).to_numpy() for i in (3, 4, 5, 6))
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(len(n), -1) for i in (7, 8))
            differ = own + other + np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            yield batch.select([0, 1, 2]).filter(pa.array(differ <= _allowed(n, m, percent)))

    side = lambda c, s: sets.select(F.col("cid").alias(c), F.col("n").alias(f"n{s}"), F.col("alone").alias(f"alone{s}"), F.col("bits").alias(f"bits{s}"))
    both = pairs.join(side("a", 1), "a").join(side("b", 2), "b")
    return both.select("a", "b", "votes", "n1", "n2", "alone1", "alone2", "bits1", "bits2").mapInArrow(run, "a bigint, b bigint, votes bigint")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose members are not yet in one component."""
    ra, rb = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    same = F.coalesce("ra", "a") == F.coalesce("rb", "b")
    return pairs.join(ra, "a", "left").join(rb, "b", "left").filter(~same).select("a", "b")


def _within(percent: int, closest: bool):
    """Pairs within the bounds: the members of a slot come first and are held, strays are compared as they come.

    With closest, each stray is paired only with the member of the slot that differs least.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members = None, []
        for batch in batches:
            key, slot, stray, cid, root, n, rest, alone = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(8))
            bits = np.frombuffer(b"".join(batch.column(8).to_pylist()), np.uint64).reshape(len(key), -1)
            edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (slot[1:] != slot[:-1]) | (stray[1:] != stray[:-1])]))
            for lo, hi in zip(edge, np.append(edge[1:], len(key)), strict=True):
                rows = tuple(x[lo:hi] for x in (cid, root, n, rest, alone, bits))
                if (key[lo], slot[lo]) != now:
                    now, members = (key[lo], slot[lo]), []
                if not stray[lo]:
                    members.append(rows)
                    continue
                members = [tuple(np.concatenate(x) for x in zip(*members, strict=True))]
                c, r, m, own, lone, b = members[0]
                for at in range(0, hi - lo, 256):
                    x = [v[at : at + 256] for v in rows]
                    fit = np.maximum(np.abs(x[2][:, None] - m), x[3][:, None] + own) <= _allowed(x[2][:, None], m, percent)
                    i, j = np.nonzero(fit & (x[1][:, None] != r))
                    differ = x[4][i] + lone[j] + np.bitwise_count(x[5][i] ^ b[j]).sum(axis=1, dtype=np.int64)
                    ok = np.flatnonzero(differ <= _allowed(x[2][i], m[j], percent))
                    if closest:
                        ok = ok[np.lexsort((c[j[ok]], differ[ok], i[ok]))]
                        ok = ok[_runs(i[ok])[0] == 0]
                    one, two = x[0][i[ok]], c[j[ok]]
                    if len(one):
                        pairs = np.unique(np.stack([np.minimum(one, two), np.maximum(one, two)], axis=1), axis=0)
                        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def _late(many: DataFrame, hot: DataFrame, roots: DataFrame, percent: int, closest: bool) -> tuple[DataFrame, list[DataFrame]]:
    """(pairs, tables that they read): pairs of classes that share a hot key, are still in different components and within the bounds.

    First each task tells which components its keys reach, once for each; only members of keys that
    reach several are listed.  Those outside a key's largest component are compared with its members
    in slots of about LATE, so no task holds a key whole.
    """
    tokens = _combinations(percent)

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def by_root(batch: pa.RecordBatch) -> Iterator[Entries]:
            root = dict(zip(batch.column(0).to_pylist(), batch.column(8).to_pylist(), strict=True))
            for key, cid, n, _ in tokens(batch):
                yield key, n, n, np.full(len(key), root[cid[0]] if len(key) else 0, np.int64)

        for key, _, _, root in _held(batches, by_root):
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (root[1:] != root[:-1])])
            yield pa.RecordBatch.from_arrays([pa.array(key[new].view(np.int64)), pa.array(root[new])], ["key", "root"])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, cid, _, _ in tokens(batch):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(key).view(np.int64)), pa.array(cid[: len(np.unique(key))])], ["key", "cid"])

    rooted = many.join(roots, F.col("cid") == F.col("node"), "left").select(*many.columns, F.coalesce("root", "cid").alias("root"))
    rooted = materialise(rooted, "rooted")
    spread = rooted.mapInArrow(reached, "key bigint, root bigint").join(hot, "key", "left_semi").groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    split = materialise(spread.filter("lo < hi").select("key"), "split")
    members = rooted.mapInArrow(listed, "key bigint, cid bigint").join(split, "key", "left_semi").join(rooted.drop("rare", "many", "cool"), "cid")
    members = materialise(members.select("key", "cid", "root", "n", "rest", "alone", "bits"), "members")
    per = members.groupBy("key", "root").count().groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("largest"), F.ceil(F.sum("count") / LATE).cast("int").alias("slots"))
    sized = members.join(per, "key")
    slots = F.when(F.col("stray"), F.sequence(F.lit(0), F.col("slots") - 1)).otherwise(F.array(F.pmod(F.xxhash64("cid"), F.col("slots")).cast("int")))
    both = sized.withColumn("stray", F.explode(F.when(F.col("root") == F.col("largest"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))))
    both = both.withColumn("slot", F.explode(slots)).select("key", "slot", F.col("stray").cast("int").alias("stray"), "cid", "root", "n", "rest", "alone", "bits")
    met = both.repartition("key", "slot").sortWithinPartitions("key", "slot", "stray")
    return met.mapInArrow(_within(percent, closest), "a bigint, b bigint").distinct(), [rooted, split, members]


def _classes(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame, int]:
    """(every row's class, one row for each class, the seed with which all classes have their own id)."""
    schema = StructType([rows.schema["doc_id"], *StructType.fromDDL("row_key string, n bigint, set_key binary, cid bigint").fields])
    for seed in range(8):
        described = materialise(rows.mapInArrow(_describe(k, seed), schema), "sets")
        classes = materialise(described.filter("n > 0").groupBy("set_key", "cid").agg(F.min("doc_id").alias("low"), F.min("row_key").alias("pick")), "classes")
        if not classes.groupBy("cid").count().filter("count > 1").limit(1).count():
            return described, classes, seed
        forget(described, classes)
    raise RuntimeError("classes share ids with every seed")


def jaccard_join(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, row_key, root for every row.

    root tells components apart, also those whose component_id is equal or null; without shingles it
    is null.
    Documents are linked if 100 * common >= percent * all shingles.  Null texts and texts without
    words have no shingles, no links and are their own component.  Rows with equal ids are separate
    documents; null ids never name a component that has another; other columns are ignored.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent is from 1 to 100")
    parts = partitions(docs)
    rows = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("row_key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    described, classes, seed = _classes(rows, k)
    lists = rows.select("text").mapInArrow(_tokens(parts, k, percent, seed), _ROW).repartitionById(parts, F.col("part"))
    told = lists.mapInArrow(_count(parts), _ROW).repartitionById(parts, F.col("part")).sortWithinPartitions("block", "kind")
    sets = told.mapInArrow(_prefixes(percent), _SET)
    sets = materialise(sets.dropDuplicates(["cid"]), "prefixes")
    many = sets.filter(F.octet_length("many") + F.octet_length("cool") > 0)
    single = materialise(_candidates(sets, parts, _rare_tokens, percent, False), "singles")
    combined = materialise(_candidates(many, parts, _combinations(percent), percent, True), "combinations")
    pairs = single.unionByName(combined).filter("a is not null").groupBy("a", "b").agg(F.count(F.lit(1)).alias("votes"))
    pairs = materialise(_bounded(pairs, sets, percent), "pairs")
    wanted = sets.select("cid").join(classes.select("cid", F.col("pick").alias("row_key")), "cid")
    texts = materialise(rows.select("row_key", "text").join(wanted, "row_key").dropDuplicates(["cid"]).select("cid", "text"), "texts")
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("votes", -F.col("a"))).alias("a")).select("a", "b")
    links = materialise(_verify(best, texts, k, percent), "links")
    roots = forest_roots(links)
    hot = materialise(combined.filter("a is null").select("key").distinct(), "hot")
    seen, rests = pairs.select("a", "b"), []
    more = _apart(seen.join(best, ["a", "b"], "left_anti"), roots)
    # A large group first joins by each stray's closest member, so that few pairs remain to be listed in full.
    for closest in (True, False):
        late, read = (None, []) if hot.isEmpty() else _late(many, hot, roots, percent, closest)
        if late is not None:
            late = late.join(seen, ["a", "b"], "left_anti")
        more = materialise(late if more is None else more if late is None else more.unionByName(late), "rest")
        rests.append(more)
        forget(*read)
        if not more.isEmpty():
            found = materialise(_verify(more, texts, k, percent), "links")
            if not found.isEmpty():
                before, roots = roots, joined_roots(roots, found)
                forget(before)
            forget(found)
        if late is None:
            break
        seen, more = seen.unionByName(more), None
    named = classes.join(roots, F.col("cid") == F.col("node"), "left").select("cid", "low", F.coalesce("root", "cid").alias("root"))
    low = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = materialise(named.join(low, "root").select("cid", "component_id", "root"), "named")
    forget(sets, single, combined, pairs, texts, links, roots, hot, classes, *rests)
    out = described.select("doc_id", "row_key", "n", "cid").join(named, "cid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "row_key", "root")


def drop_near_copies(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without near copies: of each component the row with the smallest id stays.

    Rows without shingles are linked with nothing and all stay.
    """
    found = jaccard_join(docs, k, percent, id_col, text_col)
    first = found.filter("n_shingles > 0").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "row_key"))["row_key"].alias("__key"))
    has_words = F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return only_rows(docs.filter(has_words), first.select("__key"), id_col, text_col).unionByName(docs.filter(~has_words))
