"""SentencePiece (BPE with byte fallback) encoding with seeded merge-dropout, and decoding.

Encoding merges the adjacent pair with the best score, leftmost first, until no pair is left.  With
dropout each candidate merge is decided by a keyed hash of the seed, the document, the word, its place
in the document and the candidate's place in the word; a candidate that loses is skipped when the
agenda comes to it.
Pieces are only ever split differently, so every segmentation decodes to the same bytes.

Words of a chunk are encoded at the same time, BLOCK characters at once: each round merges the head of
every word's agenda with array operations.  Each distinct word is first encoded without dropout, and the
merges made are noted and kept for later chunks: an occurrence that loses none of these has the same
pieces, whatever becomes of the candidates that were not reached.  Only the other occurrences go through an agenda of their own.
Words beyond LONG characters go through a heap.

Scale: one pass over whole texts, no shuffle; the vocabulary (a few hundred kB) travels with the
task, so executors need no model file.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .kernel import chunks, mix, ragged, span_hashes
from .storage import free_name

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT, SEED, LONG, PART, BLOCK, KNOWN = 0.1, 11, 64, 1 << 20, 1 << 20, 1 << 19
MARK = "▁"
_NONE = np.int64(1) << 62


def _place(a: np.ndarray, m: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for the candidate [a, m), [m, b) of a word."""
    return mix(((a.astype(np.uint64) << np.uint64(42)) | (m.astype(np.uint64) << np.uint64(21)) | b.astype(np.uint64)) + np.uint64(1))


class _Known:
    """Words encoded without dropout: pieces, their first characters, and the places of the merges made.

    Words are found by 64-bit hashes.  At most KNOWN words are kept; beyond, it starts again.
    """

    def __init__(self):
        self.key = np.zeros(0, np.uint64)
        self.ids, self.at, self.place = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint64)
        self.first, self.made = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def missing(self, words: np.ndarray) -> np.ndarray:
        if not len(self.key):
            return np.ones(len(words), bool)
        return self.key[np.minimum(np.searchsorted(self.key, words), len(self.key) - 1)] != words

    def add(self, words: np.ndarray, ids: np.ndarray, own: np.ndarray, at: np.ndarray, made: list) -> None:
        made_own, place = (np.concatenate([m[k] for m in made] or [np.zeros(0, t)]) for k, t in ((0, np.int64), (1, np.uint64)))
        place = place[np.argsort(made_own, kind="stable")]
        key = np.concatenate([self.key, words])
        order = np.argsort(key, kind="stable")
        pieces = np.concatenate([np.diff(self.first), np.bincount(own, minlength=len(words))])
        merges = np.concatenate([np.diff(self.made), np.bincount(made_own, minlength=len(words))])
        of_piece = ragged((np.cumsum(pieces) - pieces)[order], pieces[order])
        of_merge = ragged((np.cumsum(merges) - merges)[order], merges[order])
        self.key = key[order]
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])[of_piece]
        self.at = np.concatenate([self.at, at.astype(np.int32)])[of_piece]
        self.place = np.concatenate([self.place, place])[of_merge]
        self.first = np.concatenate([[0], np.cumsum(pieces[order])])
        self.made = np.concatenate([[0], np.cumsum(merges[order])])


class Codec:
    """A vocabulary, ready to encode and decode chunks of texts."""

    def __init__(self, model: str = MODEL, dropout: float = DROPOUT, seed: int = SEED):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        self.limit, self.seed, self.size, self.known = int(dropout * 2**32), seed, n, _Known()
        ids = {p: i for i, p in enumerate(names) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        if any(MARK in p.lstrip(MARK) for p in ids):
            raise ValueError("pieces that go on after a word's end are not supported")
        self.byte = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        raw = [p.replace(MARK, " ").encode() if p in ids else b"" for p in names]
        for b, i in enumerate(self.byte):
            raw[i] = bytes([b])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_at = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        self.chars = {p.replace(MARK, " ").encode(): i for p, i in ids.items() if len(p) == 1}
        self.ascii = np.array([self.chars.get(bytes([b]), -1) if b < 128 else -1 for b in range(256)], np.int64)
        scores = sorted({-sp.get_score(i) for i in ids.values()})
        place = {s: k for k, s in enumerate(scores)}
        pairs = sorted((ids[p[:k]] * n + ids[p[k:]], place[-sp.get_score(i)], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids)
        self.pair, self.rank, self.joined = (np.array(x, np.int64) for x in zip(*pairs, strict=True))

    def _lost(self, word: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether the candidate at a place of a word is skipped."""
        return (mix(word ^ place) >> np.uint64(32)) < np.uint64(self.limit)

    def _look(self, left: np.ndarray, right: np.ndarray, word: np.ndarray | None, a: np.ndarray, m: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of merging left [a, m) and right [m, b); no rank if impossible or dropped (with words to draw by)."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        ok = (self.pair[at] == key) & (left >= 0) & (right >= 0)
        if word is not None:
            ok &= ~self._lost(word, _place(a, m, b))
        return np.where(ok, self.rank[at], _NONE >> 24), self.joined[at]

    def _agenda(self, sym: np.ndarray, word: np.uint64 | None) -> np.ndarray:
        """One word by a heap of candidates: (rank, start) of the left piece."""
        n = len(sym)
        ids, end, before, after = sym.tolist(), list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive, heap = [True] * n, []

        def offer(starts: list[int]) -> None:
            starts = [i for i in starts if i >= 0 and after[i] < n]
            if not starts:
                return
            i, j = np.array(starts), np.array([after[s] for s in starts])
            rank, got = self._look(np.array([ids[s] for s in starts]), np.array([ids[s] for s in j]), None if word is None else np.full(len(i), word, np.uint64), i, j, np.array([end[s] for s in j]))
            for s, t, r, g in zip(starts, j.tolist(), rank.tolist(), got.tolist(), strict=True):
                if r < _NONE >> 24:
                    heapq.heappush(heap, (r, s, end[t], t, g))

        offer(list(range(n - 1)))
        while heap:
            _, i, hi, j, got = heapq.heappop(heap)
            if not (alive[i] and alive[j]) or after[i] != j or end[j] != hi:
                continue
            ids[i], end[i], after[i], alive[j] = got, hi, after[j], False
            if after[i] < n:
                before[after[i]] = i
            offer([before[i], i])
        return np.array([v for v, a in zip(ids, alive, strict=True) if a], np.int64), np.array([i for i in range(n) if alive[i]])

    def _merge(self, sym: np.ndarray, first: np.ndarray, word: np.ndarray | None, made: list | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of all words at once: (piece or -1, word, first character), by word.

        sym: characters' pieces, -1 if unknown; first: where each word begins; word: what each one's
        merges are drawn by, none without dropout; made: takes the merges (word, place) of all but long words.
        """
        length = np.diff(first)
        own = np.repeat(np.arange(len(length)), length)
        a = np.arange(len(sym)) - np.repeat(first[:-1], length)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for w in np.flatnonzero(length > LONG):
            ids, at = self._agenda(sym[first[w] : first[w + 1]], None if word is None else word[w])
            done.append((ids, np.full(len(ids), w), at))
        live = length[own] <= LONG
        sym, own, a = sym[live].astype(np.int64), own[live], a[live]
        b = a + 1
        rank, got = np.full(len(sym), _NONE >> 24), np.zeros(len(sym), np.int64)

        def renew(i: np.ndarray) -> None:
            rank[i] = _NONE >> 24
            i = i[i + 1 < len(sym)]
            i = i[own[i] == own[i + 1]]
            rank[i], got[i] = self._look(sym[i], sym[i + 1], None if word is None else word[own[i]], a[i], a[i + 1], b[i + 1])

        renew(np.arange(len(sym)))
        while len(sym):
            begin = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            size = np.diff(np.append(begin, len(sym)))
            value = (rank << 20) | a
            least = np.minimum.reduceat(value, begin)
            idle = least >= (_NONE >> 24) << 20
            over = np.repeat(idle, size)
            if idle.any():
                done.append((sym[over], own[over], a[over]))
            hit = np.flatnonzero((value == np.repeat(least, size)) & ~over)
            if made is not None:
                made.append((own[hit], _place(a[hit], a[hit + 1], b[hit + 1])))
            sym[hit], b[hit] = got[hit], b[hit + 1]
            keep = ~over
            keep[hit + 1] = False
            moved = np.cumsum(keep) - 1
            sym, own, a, b, rank, got = sym[keep], own[keep], a[keep], b[keep], rank[keep], got[keep]
            at = moved[hit]
            stale = np.zeros(len(sym), bool)
            stale[at] = True
            stale[at[at > 0] - 1] = True
            renew(np.flatnonzero(stale))
        ids, words, at = (np.concatenate([d[k] for d in done] or [np.zeros(0, np.int64)]) for k in range(3))
        order = np.lexsort((at, words))
        return ids[order], words[order], at[order]

    def _merge_blocks(self, sym: np.ndarray, first: np.ndarray, word: np.ndarray | None, made: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """_merge, about BLOCK characters at once."""
        cuts = np.unique(np.append(np.searchsorted(first[:-1], np.arange(0, len(sym), BLOCK)), len(first) - 1))
        done = [(np.zeros(0, np.int64),) * 3]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            own_made = None if made is None else []
            ids, own, at = self._merge(sym[first[lo] : first[hi]], first[lo : hi + 1] - first[lo], None if word is None else word[lo:hi], own_made)
            done.append((ids, own + lo, at))
            if made is not None:
                made += [(w + lo, place) for w, place in own_made]
        return tuple(np.concatenate(d) for d in zip(*done, strict=True))

    def _deviating(self, word: np.ndarray, long: np.ndarray, draws: np.ndarray) -> np.ndarray:
        """Occurrences (of known words) that lose a merge of their word, or whose word is long."""
        out = long.copy()
        for lo in range(0, len(word), BLOCK):
            w = word[lo : lo + BLOCK]
            begin = self.known.made[w]
            n = self.known.made[w + 1] - begin
            lost = self._lost(np.repeat(draws[lo : lo + BLOCK], n), self.known.place[ragged(begin, n)])
            out[lo + np.repeat(np.arange(len(w)), n)[lost]] = True
        return np.flatnonzero(out)

    def encode(self, data: np.ndarray, at: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all texts, and where each text's begin; an empty text has none.

        draw: a number for each text, with which its merges are drawn.
        """
        n = np.diff(at)
        full = n > 0
        grown = np.concatenate([[0], np.cumsum(n + full)])
        text = np.full(grown[-1], 32, np.uint8)
        text[ragged(grown[:-1] + full, n)] = data[at[0] : at[-1]]
        if not len(text):
            return np.zeros(0, np.int32), np.zeros(len(n) + 1, np.int64)
        blank = text == 32
        start = blank.copy()
        start[1:] &= ~blank[:-1]
        start[grown[:-1][full]] = True
        start = np.flatnonzero(start)
        end = np.append(start[1:], len(text))
        doc = np.searchsorted(grown, start, "right") - 1
        key = span_hashes(text, start, end)
        words, sample, which = np.unique(key, return_index=True, return_inverse=True)
        # characters of the words to encode
        length = end[sample] - start[sample]
        raw = text[ragged(start[sample], length)]
        head = np.flatnonzero((raw & 0xC0) != 0x80)
        width = np.diff(np.append(head, len(raw)))
        symbol = self.ascii[raw[head]]
        wide = np.flatnonzero(width > 1)
        code = np.zeros(len(wide), np.int64)
        for k in range(4):
            has = width[wide] > k
            code[has] = (code[has] << 8) | raw[head[wide[has]] + k]
        kinds, back = np.unique(code | (width[wide] << 32), return_inverse=True)
        known = np.array([self.chars.get(int(c & 0xFFFFFFFF).to_bytes(int(c >> 32), "big"), -1) if c >> 32 <= 4 else -1 for c in kinds], np.int64)
        symbol[wide] = known[back]
        edges = np.concatenate([[0], np.cumsum(length)])
        first = np.searchsorted(head, edges)
        chars = np.diff(first)
        if len(self.known.key) + len(words) > KNOWN:
            self.known = _Known()
        new = np.flatnonzero(self.known.missing(words))
        made: list = []
        self.known.add(words[new], *self._merge_blocks(symbol[ragged(first[:-1][new], chars[new])], np.concatenate([[0], np.cumsum(chars[new])]), None, made), made)
        place = np.searchsorted(self.known.key, words)
        size = self.known.first[place + 1] - self.known.first[place]
        held = ragged(self.known.first[place], size)
        ids, own, at_char = self.known.ids[held].astype(np.int64), np.repeat(np.arange(len(words)), size), self.known.at[held].astype(np.int64)
        source = np.arange(len(words))
        if self.limit:
            turn = np.arange(len(start)) - np.searchsorted(doc, doc)
            draws = mix(key ^ mix(mix(draw[doc].astype(np.uint64) ^ np.uint64(self.seed + 1)) + turn.astype(np.uint64)))
            other = self._deviating(place[which], (chars > LONG)[which], draws)
            size = chars[which[other]]
            more = self._merge_blocks(symbol[ragged(first[:-1][which[other]], size)], np.concatenate([[0], np.cumsum(size)]), draws[other])
            ids, own, at_char = np.concatenate([ids, more[0]]), np.concatenate([own, more[1] + len(words)]), np.concatenate([at_char, more[2]])
            source = np.concatenate([source, which[other]])
            which = which.copy()
            which[other] = len(words) + np.arange(len(other))
        # unknown characters become byte pieces
        unknown, char = ids < 0, first[source[own]] + at_char
        count = np.where(unknown, width[char], 1)
        out = np.repeat(ids, count)
        out[np.repeat(unknown, count)] = self.byte[raw[ragged(head[char[unknown]], count[unknown])]]
        per = np.bincount(own, count, len(source)).astype(np.int64)
        begin = np.concatenate([[0], np.cumsum(per)])
        tokens = out[ragged(begin[which], per[which])].astype(np.int32)
        return tokens, np.concatenate([[0], np.cumsum(np.bincount(doc, per[which], len(n)))]).astype(np.int64)

    def decode(self, tokens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts, and where each text's begin."""
        size = np.diff(self.raw_at)[tokens]
        data = self.raw[ragged(self.raw_at[tokens], size)]
        edge = np.concatenate([[0], np.cumsum(size)])[at]
        full = np.diff(at) > 0
        keep = np.ones(len(data), bool)
        keep[edge[:-1][full]] = False
        return data[keep], edge - np.concatenate([[0], np.cumsum(full)])


def _draw(id_col: str, text_col: str, seed: int):
    return F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))


def encode(docs: DataFrame, model: str = MODEL, dropout: float = DROPOUT, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", out_col: str = "tokens") -> DataFrame:
    """All columns of docs and the pieces of each text.

    Every occurrence of a word is segmented in its own way.  Null and empty texts have no pieces;
    repeated rows get the same pieces.
    """
    codec = Codec(model, dropout, seed)
    docs = docs.drop(out_col)
    schema = StructType([*docs.schema.fields, StructField(out_col, ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names[:-1]
            draw = batch.column(len(names)).to_numpy(zero_copy_only=False)
            for c in chunks(batch.column(names.index(text_col)), PART):
                tokens, at = codec.encode(c.data, c.at, draw[c.lo : c.hi])
                yield pa.RecordBatch.from_arrays([*batch.slice(c.lo, len(c)).columns[:-1], pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(tokens))], [*names, out_col])

    return docs.select("*", _draw(id_col, text_col, seed).alias(free_name(docs, "draw"))).mapInArrow(run, schema)


def decode(docs: DataFrame, model: str = MODEL, tokens_col: str = "tokens", out_col: str = "text") -> DataFrame:
    """All columns of docs and the text of each list of pieces; null lists give empty texts."""
    codec = Codec(model)
    docs = docs.drop(out_col)
    schema = StructType([*docs.schema.fields, StructField(out_col, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(tokens_col))
            n = np.array([0 if x is None else x for x in pa.compute.list_value_length(column).to_pylist()], np.int64)
            data, at = codec.decode(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(n)]))
            texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, out_col])

    return docs.mapInArrow(run, schema)


def round_trip(docs: DataFrame, model: str = MODEL, dropout: float = DROPOUT, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, tokens_sha256 (of little-endian 32-bit ids), lossless: encoded and decoded again."""
    codec = Codec(model, dropout, seed)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), _draw(id_col, text_col, seed).alias("draw"))
    schema = StructType([rows.schema["doc_id"], *StructType.fromDDL("n_tokens bigint, tokens_sha256 string, lossless boolean").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            draw = batch.column(2).to_numpy(zero_copy_only=False)
            for c in chunks(batch.column(1), PART):
                tokens, at = codec.encode(c.data, c.at, draw[c.lo : c.hi])
                data, back = codec.decode(tokens, at)
                if np.array_equal(back, c.at) and np.array_equal(data, c.data):
                    same = [True] * len(c)
                else:
                    same = [data[back[i] : back[i + 1]].tobytes() == c.text(i) for i in range(len(c))]
                raw = memoryview(tokens.astype("<i4").tobytes())
                sha = [hashlib.sha256(raw[4 * at[i] : 4 * at[i + 1]]).hexdigest() for i in range(len(c))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.lo, len(c)), pa.array(np.diff(at)), pa.array(sha), pa.array(same)], schema.names)

    return rows.mapInArrow(run, schema)
