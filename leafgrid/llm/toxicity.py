"""Toxicity by a classifier chain of linear models.

Categories are predicted in order.  The model of each category is a ridge logistic regression over
word presence and a few shape ratios, plus the probabilities of the earlier categories.  For
training these are out-of-fold predictions, so a later model sees earlier probabilities as honest
as it will see them in use.

Training reads at most MAX_TRAIN labelled rows, those with the smallest keyed hashes of their ids
(a documented bound; their features are what reaches the driver).  Prediction is one pass over
whole texts without a shuffle; the model is a few hundred numbers per category.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .kernel import LOWER, Chunk, Words, chunks

MAX_TRAIN, FOLDS, MAX_WORDS, LEAST_Z, LEAST_DOCS, RIDGE = 6000, 5, 300, 5.0, 4, 1.0
SLOTS = 1 << 20
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_SHAPE = np.stack([(np.arange(256) >= 65) & (np.arange(256) <= 90), np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>!@=+^~"]), _LETTER]).astype(np.int64)


def _shapes(chunk: Chunk, words: Words) -> np.ndarray:
    """Per text: log of the number of words, share of capitals among letters, share of symbols."""
    sums = np.concatenate([np.zeros((3, 1), np.int64), np.cumsum(_SHAPE[:, chunk.data], axis=1)], axis=1)
    upper, symbol, letter = sums[:, chunk.at[1:]] - sums[:, chunk.at[:-1]]
    size = np.maximum(1, np.diff(chunk.at))
    return np.stack([np.log1p(np.diff(words.first)) / 5, upper / np.maximum(1, letter), symbol / size], axis=1)


def _slots(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashed slot of every lower-cased run of letters, the text of each, and the shapes."""
    words = Words(LOWER[chunk.data], chunk.at, _LETTER)
    slot = (words.hashes() >> np.uint64(44)).astype(np.int64)
    return slot, np.repeat(np.arange(len(chunk)), np.diff(words.first)), _shapes(chunk, words)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c in chunks(batch.column(batch.schema.get_field_index("text"))):
            slot, text, shape = _slots(c)
            found = [np.unique(s).astype(np.int32).tobytes() for s in np.split(slot, np.searchsorted(text, np.arange(1, len(c))))]
            part = batch.slice(c.lo, len(c))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.binary()), pa.array(shape.tolist(), pa.list_(pa.float64()))], ["doc_id", "marks", "slots", "shape"])


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last column of x is the constant."""
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], RIDGE)
    penalty[-1] = 1e-3
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Chain:
    """One (slots, weights) pair for each category, in order."""

    def __init__(self, names: list[str]):
        self.names, self.models = names, []

    def train(self, slots: list[np.ndarray], shape: np.ndarray, y: np.ndarray, fold: np.ndarray) -> Chain:
        earlier = np.zeros((len(slots), 0))
        for k in range(len(self.names)):
            dense = np.concatenate([shape, earlier], axis=1)
            out = np.zeros(len(slots))
            for f in range(FOLDS):
                rest, own = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
                if len(rest) and len(own):
                    chosen, w = self._one([slots[i] for i in rest], dense[rest], y[rest, k])
                    out[own] = self._probability(_presence([slots[i] for i in own], chosen), dense[own], w)
            self.models.append(self._one(slots, dense, y[:, k]))
            earlier = np.concatenate([earlier, out[:, None]], axis=1)
        return self

    @staticmethod
    def _one(slots: list[np.ndarray], dense: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words whose presence departs from independence of the category, and the weights."""
        docs = np.bincount(np.concatenate([*slots, np.zeros(0, np.int32)]), minlength=SLOTS)
        hits = np.bincount(np.concatenate([*(s for s, v in zip(slots, y, strict=True) if v), np.zeros(0, np.int32)]), minlength=SLOTS)
        expected = docs * (y.mean() if len(y) else 0)
        z = np.abs(hits - expected) / np.sqrt(expected * max(1e-9, 1 - (y.mean() if len(y) else 0)) + 1e-9)
        z[docs < LEAST_DOCS] = 0
        chosen = np.argsort(-z, kind="stable")[:MAX_WORDS]
        chosen = np.sort(chosen[z[chosen] >= LEAST_Z])
        return chosen, _fit(np.concatenate([_presence(slots, chosen), dense, np.ones((len(y), 1))], axis=1), y.astype(float))

    @staticmethod
    def _probability(presence: np.ndarray, dense: np.ndarray, w: np.ndarray) -> np.ndarray:
        z = presence @ w[: presence.shape[1]] + dense @ w[presence.shape[1] : -1] + w[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def predict(self, slot: np.ndarray, text: np.ndarray, shape: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        """Probabilities (texts by categories) from the words' slots and the texts they stand in."""
        out = np.zeros((len(shape), 0))
        for (chosen, w), table in zip(self.models, tables, strict=True):
            column = table[slot]
            hit = column >= 0
            pairs = np.unique(text[hit] * (len(chosen) + 1) + column[hit])
            z = np.bincount(pairs // (len(chosen) + 1), w[pairs % (len(chosen) + 1)], minlength=len(shape))
            z = z + np.concatenate([shape, out], axis=1) @ w[len(chosen) : -1] + w[-1]
            out = np.concatenate([out, 1 / (1 + np.exp(-np.clip(z, -30, 30)))[:, None]], axis=1)
        return out

    def tables(self) -> list[np.ndarray]:
        found = []
        for chosen, _ in self.models:
            t = np.full(SLOTS, -1, np.int64)
            t[chosen] = np.arange(len(chosen))
            found.append(t)
        return found


def _presence(slots: list[np.ndarray], chosen: np.ndarray) -> np.ndarray:
    x = np.zeros((len(slots), len(chosen)))
    for i, s in enumerate(slots):
        x[i] = np.isin(chosen, s, assume_unique=True)
    return x


def train_chain(docs: DataFrame, labels: DataFrame, categories: list[str], max_train: int = MAX_TRAIN, seed: int = 5, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """Fit the chain on at most max_train labelled documents; rows with a null label are left out.

    A document labelled more than once has a category if any label says so; of several texts with one
    id the first by code point counts, so no more than max_train rows reach the driver.  Without labelled
    documents every probability is one half.
    """
    marks = labels.filter(F.col(id_col).isNotNull()).dropna(subset=categories).groupBy(F.col(id_col).alias("doc_id")).agg(F.array(*[F.max(F.col(c).cast("int")) for c in categories]).alias("marks"))
    chosen = marks.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(max_train)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.to_json(F.first("marks")).alias("marks"), F.min("text").alias("text"))
    schema = StructType([rows.schema["doc_id"], *StructType.fromDDL("marks string, slots binary, shape array<double>").fields])
    found = rows.mapInArrow(_extract, schema).toPandas()
    found = found.drop_duplicates(subset=["slots"]).sort_values("doc_id").head(max_train)
    slots = [np.frombuffer(s, np.int32) for s in found["slots"]]
    y = np.array([[int(v) for v in m.strip("[]").split(",")] for m in found["marks"]]).reshape(-1, len(categories))
    shape = np.array(found["shape"].tolist()).reshape(-1, 3)
    return Chain(categories).train(slots, shape, y, np.arange(len(slots)) % FOLDS)


def score(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """All rows and columns of docs, and p_<category> for each category of the chain.

    Null and empty texts are scored as texts without words; a column of docs that already has one
    of these names is replaced.
    """
    names = [f"p_{c}" for c in chain.names]
    docs = docs.drop(*names)
    schema = StructType([*docs.schema.fields, *[StructField(n, DoubleType()) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = chain.tables()
        for batch in batches:
            for c in chunks(batch.column(batch.schema.get_field_index(text_col))):
                slot, text, shape = _slots(c)
                p = chain.predict(slot, text, shape, tables)
                yield pa.RecordBatch.from_arrays([*batch.slice(c.lo, len(c)).columns, *[pa.array(p[:, k]) for k in range(len(names))]], [*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)
