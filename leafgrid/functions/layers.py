"""Forward passes of the box encoder in numpy, for use inside tasks."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType


def relu(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0)


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + np.vectorize(math.erf)(x / math.sqrt(2)))


def glu(x: np.ndarray) -> np.ndarray:
    a, b = np.split(x, 2, axis=-1)
    return a / (1 + np.exp(-b))


ACTIVATIONS = {"relu": relu, "gelu": gelu, "glu": glu}


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def layer_norm(x: np.ndarray, scale: np.ndarray | float = 1.0, shift: np.ndarray | float = 0.0, eps: float = 1e-5) -> np.ndarray:
    return (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + eps) * scale + shift


def grouped_linear(x: np.ndarray, weight: np.ndarray, bias: np.ndarray | None = None) -> np.ndarray:
    """x (..., groups * in) through weight (groups, in, out): every group has its own matrix."""
    g, n, m = weight.shape
    out = np.einsum("...gi,gio->...go", x.reshape(*x.shape[:-1], g, n), weight)
    return (out if bias is None else out + bias).reshape(*x.shape[:-1], g * m)


def make_heads(x: np.ndarray, n: int) -> np.ndarray:
    """(..., length, heads * size) as (..., heads, length, size)."""
    return x.reshape(*x.shape[:-1], n, -1).swapaxes(-3, -2)


def gather(table: np.ndarray, index: np.ndarray) -> np.ndarray:
    """table (..., heads, rows, places), index (..., rows, columns) -> (..., heads, rows, columns)."""
    return np.take_along_axis(table, np.broadcast_to(index[..., None, :, :], (*table.shape[:-1], index.shape[-1])), axis=-1)


@dataclass(frozen=True)
class Linear:
    """x through weight (in, out) plus bias (out)."""

    weight: np.ndarray
    bias: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weight + self.bias


@dataclass(frozen=True)
class RelativeAttention:
    """Attention whose scores join contents with contents (c2c) and with places, both ways (c2p, p2c).

    places (n_places, size) embeds distances and is shared by both axes.  pos_query and pos_key are
    (weight, bias) of grouped linear maps, one group for each coordinate: coordinate c meets the c-th
    share of every head.  Terms are scaled by the root of the head's size, their sum by the root of
    their number.
    """

    query: Linear
    key: Linear
    value: Linear
    heads: int
    places: np.ndarray | None = None
    pos_query: tuple[np.ndarray, np.ndarray] | None = None
    pos_key: tuple[np.ndarray, np.ndarray] | None = None
    modes: tuple[str, ...] = ("c2c", "c2p", "p2c")

    def scores(self, x: np.ndarray, positions: np.ndarray | None = None, placed: np.ndarray | None = None) -> np.ndarray:
        """(..., heads, n, n) for x (..., n, size) and positions (..., n, n, coordinates) of keys as queries see them.

        Pairs that aren't placed (n, n) get no terms of position.
        """
        q, k = make_heads(self.query(x), self.heads), make_heads(self.key(x), self.heads)
        size, terms = q.shape[-1], []
        if "c2c" in self.modes:
            terms.append(q @ k.swapaxes(-1, -2))
        if positions is not None and self.places is not None:
            at = np.clip(len(self.places) // 2 + positions, 0, len(self.places) - 1)
            if "c2p" in self.modes:
                terms.append(self._placed(q, self.pos_key, at, placed))
            if "p2c" in self.modes:
                terms.append(self._placed(k, self.pos_query, at.swapaxes(-3, -2), None if placed is None else placed.T).swapaxes(-1, -2))
        if not terms:
            raise ValueError("no term is left: positions are missing")
        return sum(terms) / math.sqrt(size * len(terms))

    def _placed(self, contents: np.ndarray, projection: tuple[np.ndarray, np.ndarray], at: np.ndarray, placed: np.ndarray | None) -> np.ndarray:
        coordinates = at.shape[-1]
        table = grouped_linear(self.places, *projection).reshape(len(self.places), coordinates, self.heads, -1)
        shares = np.split(contents, coordinates, axis=-1)
        out = sum(gather(shares[c] @ table[:, c].transpose(1, 2, 0), at[..., c]) for c in range(coordinates))
        return out if placed is None else np.where(placed, out, 0.0)

    def __call__(self, x: np.ndarray, positions: np.ndarray | None = None, mask: np.ndarray | None = None, placed: np.ndarray | None = None) -> np.ndarray:
        """(..., n, heads * head); keys whose mask (n) is false take no part."""
        scores = self.scores(x, positions, placed)
        if mask is not None:
            scores = np.where(mask, scores, -10000.0)
        return (softmax(scores) @ make_heads(self.value(x), self.heads)).swapaxes(-3, -2).reshape(*x.shape[:-1], -1)


@dataclass(frozen=True)
class TransformerLayer:
    """Attention, then a two-layer step; each is added through a gate and normalised.

    Gates of 0 leave only the norms at work, gates of 1 give the usual layer.  norms are (scale, shift).
    """

    attention: RelativeAttention
    up: Linear
    down: Linear
    norms: tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    gates: tuple[float, float] = (0.0, 0.0)
    activation: str = "gelu"

    def __call__(self, x: np.ndarray, positions: np.ndarray | None = None, mask: np.ndarray | None = None, placed: np.ndarray | None = None) -> np.ndarray:
        x = layer_norm(x + self.attention(x, positions, mask, placed) * self.gates[0], *self.norms[0])
        return layer_norm(x + self.down(ACTIVATIONS[self.activation](self.up(x))) * self.gates[1], *self.norms[1])


@dataclass(frozen=True)
class BoxTransformer:
    """Layers over the boxes of a page, or of pages with as many boxes, ahead of which an empty token without a place stands."""

    layers: tuple[TransformerLayer, ...]
    empty: np.ndarray

    @staticmethod
    def seeded(size: int, heads: int = 2, layers: int = 2, places: int | None = 64, seed: int = 0, gate: float = 1.0, activation: str = "gelu", modes: tuple[str, ...] = ("c2c", "c2p", "p2c")) -> BoxTransformer:
        """Weights drawn from a seed, for tests and as a starting point; the layers share one table of places."""
        if size % (2 * heads):
            raise ValueError("size must be a multiple of twice the heads")
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / math.sqrt(shape[-2]), shape)
        linear = lambda n, m: Linear(draw(n, m), draw(1, m)[0])
        grouped = lambda: (draw(2, size // 2, size // 2), draw(2, size // 2))
        table = None if places is None else rng.normal(0, 1, (places, size))
        inner = size if activation == "glu" else 2 * size
        made = []
        for _ in range(layers):
            attention = RelativeAttention(linear(size, size), linear(size, size), linear(size, size), heads, table, *((None, None) if table is None else (grouped(), grouped())), modes)
            norms = ((np.ones(size), np.zeros(size)), (np.ones(size), np.zeros(size)))
            made.append(TransformerLayer(attention, linear(size, 2 * size), linear(inner, size), norms, (gate, gate), activation))
        return BoxTransformer(tuple(made), rng.normal(0, 1, size))

    def __call__(self, x: np.ndarray, positions: np.ndarray | None = None, mask: np.ndarray | None = None) -> np.ndarray:
        n, size = x.shape[-2:]
        x = np.concatenate([np.broadcast_to(self.empty, (*x.shape[:-2], 1, size)), x], axis=-2)
        at = placed = None
        if positions is not None:
            at = np.zeros((*positions.shape[:-3], n + 1, n + 1, positions.shape[-1]), int)
            at[..., 1:, 1:, :] = positions
            placed = np.zeros((n + 1, n + 1), bool)
            placed[1:, 1:] = True
        if mask is not None:
            mask = np.concatenate([[True], mask])
        for layer in self.layers:
            x = layer(x, at, mask, placed)
        return x[..., 1:, :]


def page_positions(x0: np.ndarray, y0: np.ndarray, y1: np.ndarray, n: int = 64) -> np.ndarray:
    """(..., boxes, boxes, 2): grid steps and lines from each box to every other, as in ``relative_positions``."""
    query, key = (lambda v: v[..., :, None]), (lambda v: v[..., None, :])
    dx = np.trunc((key(x0) - query(x0)) * n)
    height = y1 - y0
    ref = np.where(key(y0) >= query(y0), query(height), key(height))
    far, near = key(y1) - query(y0), key(y0) - query(y1)
    below, above = (far > -0.5) & (near > -0.5), (far < 0.5) & (near < 0.5)
    reach = np.where(below, np.minimum(far, near), np.maximum(far, near))
    lines = reach / np.where(ref == 0, 1.0, ref)
    dy = np.where(below, np.ceil(lines + 0.5), np.floor(lines - 0.5))
    dy = np.where(ref == 0, np.sign(reach) * n, dy)
    return np.stack([dx, np.where(below | above, dy, 0)], -1).astype(int)


def cnn_pool(words: np.ndarray, kernels: dict[int, np.ndarray], out: np.ndarray, activation: str = "relu") -> np.ndarray:
    """words (n, size): convolve along the words with each kernel (width, size, channels), take maxima."""
    pooled = []
    for width, w in sorted(kernels.items()):
        padded = np.concatenate([np.zeros((width // 2, words.shape[1])), words, np.zeros(((width - 1) // 2, words.shape[1]))])
        seen = np.stack([sum(padded[i + j] @ w[j] for j in range(width)) for i in range(len(words))]) if len(words) else np.zeros((1, w.shape[-1]))
        pooled.append(ACTIVATIONS[activation](seen).max(0))
    return np.concatenate(pooled) @ out


def text_embedding(codes: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """codes (words, features) -> the sum of each feature's row; unknown codes are row 0."""
    return sum(t[np.where((codes[:, i] >= 0) & (codes[:, i] < len(t)), codes[:, i], 0)] for i, t in enumerate(tables))


def contextualise(boxes: DataFrame, model: BoxTransformer, embedding_col: str = "embedding", out_col: str = "context", n: int = 64) -> DataFrame:
    """Adds the transformer's output for each box of a page; a page's boxes bound a task's work.

    A page is a row; the pages of a batch that have as many boxes go through the layers together.
    """
    page = ("doc_id", "page_num")
    held = boxes.select(*page, *[c for c in boxes.columns if c not in page])
    line = StructType(held.schema.fields[2:])
    places = [line.fieldNames().index(c) for c in ("x0", "y0", "y1", embedding_col)]
    schema = StructType([*held.schema.fields[:2], StructField("rows", ArrayType(StructType([*line.fields, StructField(out_col, ArrayType(DoubleType()))])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bound = batch.column(2).offsets.to_numpy().astype(np.int64)
            bound = bound - bound[0]
            fields = batch.column(2).flatten().flatten()
            x0, y0, y1 = (fields[k].cast(pa.float64()).to_numpy(zero_copy_only=False) for k in places[:3])
            size = len(model.empty)
            given = fields[places[3]].flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, size)
            out, count = np.empty_like(given), np.diff(bound)
            for m in np.unique(count[count > 0]):
                pages = bound[:-1][count == m]
                step = max(1, (1 << 16) // int(m) ** 2)
                for lo in range(0, len(pages), step):
                    at = pages[lo : lo + step, None] + np.arange(m)
                    out[at] = model(given[at], page_positions(x0[at], y0[at], y1[at], n))
            context = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * size, pa.int32()), pa.array(out.reshape(-1)))
            rows = pa.StructArray.from_arrays([*fields, context], [*line.fieldNames(), out_col])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(bound, pa.int32()), rows)], schema.fieldNames())

    order = F.struct("box_idx", F.struct(*line.fieldNames()).alias("r"))
    pages = held.groupBy(*page).agg(F.array_sort(F.collect_list(order)).alias("o")).select(*page, F.col("o.r").alias("rows"))
    return pages.mapInArrow(run, schema).select(*page, F.inline("rows")).select(*boxes.columns, out_col)
