"""Fill-in-middle transformation: texts are cut at unit boundaries and put together anew around sentinels.

One table-driven automaton over bytes tells where code points begin (bytes that don't continue UTF-8),
where units begin (a blank after a word) and where a sentinel ends.  Its table gives for each state
and byte the next state and what to emit.  After two bytes the state no longer depends on where the
automaton began, which is checked when the table is built; so the states of all bytes of a batch come
from two look-ups in the table instead of a loop.  Emissions are counted, and a second pass finds the
cuts, which are counts of units, among the places of the emitted unit starts.

Scale: each text is worked on where it lies, in chunks bounded by bytes; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .kernel import SPACES, Chunk, chunks

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED, RATE, SPM = 42, 50, 80
POINT, UNIT, SENTINEL = 1, 2, 4
_BLANK, _WORD, _OPEN, _NAMED = range(4)


def build_table(sentinels: Sequence[bytes] = (PREFIX, SUFFIX, MIDDLE)) -> tuple[np.ndarray, np.ndarray]:
    """(next state, emission) for each state and byte.

    States: after a blank (and at the start), in a word, after a sentinel's first byte, after its
    first two.  Sentinels are three bytes of a word: one first, one last, and a name between them.
    """
    first, last = {s[:1] for s in sentinels}, {s[2:] for s in sentinels}
    if any(len(s) != 3 for s in sentinels) or len(first) != 1 or len(last) != 1 or first & last:
        raise ValueError("sentinels are three bytes, with a first and a last one in common")
    follow, emit = np.zeros((4, 256), np.uint8), np.zeros((4, 256), np.uint8)
    for state in range(4):
        for b in range(256):
            byte = bytes([b])
            blank = byte in {SPACES[i : i + 1] for i in range(len(SPACES))}
            follow[state, b] = _BLANK if blank else _OPEN if byte in first else _NAMED if state == _OPEN and byte in {s[1:2] for s in sentinels} else _WORD
            emit[state, b] = POINT * ((b & 0xC0) != 0x80) | UNIT * (blank and state != _BLANK) | SENTINEL * (state == _NAMED and byte in last)
    twice = follow[follow[:, :, None], np.arange(256)[None, None, :]]
    if (twice != twice[:1]).any():
        raise ValueError("the state must follow from two bytes")
    return follow, emit


_TABLE = build_table()


def scan(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """What the automaton emits at each byte of texts that begin at the offsets at."""
    follow, emit = _TABLE
    begin = at[:-1][np.diff(at) > 0]

    def before(after: np.ndarray) -> np.ndarray:
        out = np.full(len(data), _BLANK, np.uint8)
        out[1:] = after[:-1]
        out[begin] = _BLANK
        return out

    state = before(follow[before(follow[_BLANK, data]), data])
    out = emit[state, data]
    out[begin] |= UNIT  # the first unit begins with the text
    return out


def _draws(doc_id: object, seed: int) -> list[int]:
    name = f"{seed}:{'' if doc_id is None else doc_id}".encode()
    h = hashlib.sha256(name).digest()
    return [int.from_bytes(h[4 * i : 4 * i + 4], "big") for i in range(4)]


def restore(output: bytes, form: str) -> bytes:
    """The text from which an output of this form was made."""
    if form == "plain":
        return output
    data = np.frombuffer(output, np.uint8)
    a, b, c = (np.flatnonzero(scan(data, np.array([0, len(data)])) & SENTINEL) + 1).tolist()
    one, two, three = output[a : b - 3], output[b : c - 3], output[c:]
    return two + three + one if form == "spm" else one + three + two


def _transformed(c: Chunk, ids: list, seed: int, rate: int, spm: int) -> Iterator[tuple]:
    emitted = scan(c.data, c.at)
    units = np.flatnonzero(emitted & UNIT)
    first = np.searchsorted(units, c.at)
    points = np.concatenate([[0], np.cumsum(emitted & POINT, dtype=np.int64)])
    marked = np.concatenate([[0], np.cumsum((emitted & SENTINEL) > 0, dtype=np.int64)])
    for i, doc_id in enumerate(ids):
        lo, hi = int(c.at[i]), int(c.at[i + 1])
        text, n = c.text(i), int(first[i + 1] - first[i])
        h1, h2, h3, h4 = _draws(doc_id, seed)
        if not n or marked[hi] > marked[lo] or h3 % 100 >= rate:
            yield n, "plain", None, None, text
            continue
        place = lambda k: hi if k == n else int(units[first[i] + k])  # noqa: B023, E731
        x, y = (place(k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
        prefix, middle, suffix = text[: x - lo], text[x - lo : y - lo], text[y - lo :]
        form = "spm" if h4 % 100 < spm else "psm"
        out = SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle if form == "spm" else PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle
        yield n, form, int(points[x] - points[lo]), int(points[y] - points[x]), out


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM, id_col: str = "doc_id", text_col: str = "text", check: bool = False) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output for every row; with check also output_sha256 and restored_sha256 in place of output.

    A unit is the blanks before a word and the word, or the blanks at the end.  Of 100 documents rate
    are cut, and of these spm have the suffix first; cuts and forms are drawn by seed and id, so rows
    with one id are cut alike.  Null and empty texts, and texts that hold a sentinel, stay as they
    are (plain); a null id draws as an empty one; repeated rows each give a row; other columns are
    ignored.  restored_sha256 is of the text rebuilt from the output and the form alone.
    """
    columns = ["n", "form", "prefix_chars", "middle_chars"] + (["output_sha256", "restored_sha256"] if check else ["output"])
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64()] + [pa.string()] * (len(columns) - 4)
    schema = StructType([StructField("doc_id", docs.schema[id_col].dataType), *StructType.fromDDL("n bigint, form string, prefix_chars bigint, middle_chars bigint, " + ", ".join(f"{c} string" for c in columns[4:])).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1)):
                ids = batch.column(0).slice(c.lo, len(c))
                rows = list(_transformed(c, ids.to_pylist(), seed, rate, spm))
                if check:
                    rows = [(*r[:4], hashlib.sha256(r[4]).hexdigest(), hashlib.sha256(restore(r[4], r[1])).hexdigest()) for r in rows]
                values = [pa.array(x, t) if t != pa.string() else pa.array([v if v is None or isinstance(v, str) else v.decode("utf-8", "replace") for v in x], t) for x, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([ids, *values], ["doc_id", *columns])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
