"""A trainable classifier of boxes over their text and layout, fitted by distributed gradients.

A box is a sparse vector: hashed shapes, prefixes and suffixes of its words as shares of its words,
its layout measures, and one.  The classifier is a linear layer with softmax.  Every step sums the
gradients of all rows, or of one of several fixed parts of the rows, in the tasks that hold them;
sums of many tasks meet in a second round before the driver takes the step (AdamW with a linear
schedule).  The driver holds the weights, their two moments and one gradient for each of SUMS tasks:
labels times dims numbers each, whatever the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.features import word_marks
from .classify import LAYOUT

DIMS, SUMS = 4096, 16
IGNORED = -100


def box_vectors(featured: DataFrame, dims: int = DIMS, layout: Sequence[str] = LAYOUT, label_col: str = "label", keys: Sequence[str] = ("doc_id", "box_idx"), packed: bool = False) -> DataFrame:
    """keys, text, label, at, value: each box's sparse vector; the columns of layout have places from dims on, then comes the constant.

    Boxes without words have layout alone; null measures count as zero.  A box's words are counted in
    its row: nothing is shuffled.  packed gives at and value as bytes of 32-bit integers and doubles,
    which are stored and read several times faster than arrays.
    """
    measures = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in layout]).cast("array<double>")
    held = featured.select(*keys, "text", F.col(label_col).alias("label"), measures.alias("layout"))
    rows = word_marks(held)
    slot = lambda kind, value: F.pmod(F.xxhash64(F.lit(kind), value), F.lit(dims)).cast("int")
    shape = F.transform("shapes", lambda w: slot("shape", w))
    prefix, suffix = F.transform("lows", lambda w: slot("prefix", F.left(w, F.lit(3)))), F.transform("lows", lambda w: slot("suffix", F.right(w, F.lit(3))))
    counted = rows.select(*keys, "text", "label", F.concat(shape, prefix, suffix).alias("slots"), "layout")
    types = ("binary", "binary") if packed else ("array<int>", "array<double>")
    schema = StructType([*(counted.schema[c] for c in (*keys, "text", "label")), *StructType.fromDDL(f"at {types[0]}, value {types[1]}").fields])
    return counted.mapInArrow(_counted(dims, len(layout), packed), schema)


def _counted(dims: int, layout: int, packed: bool):
    """Boxes with their places and shares, from boxes with the place of each of their words' features; a text's words stay in its row."""

    def arrays(bound: np.ndarray, data: np.ndarray) -> pa.Array:
        if packed:
            return pa.Array.from_buffers(pa.binary(), len(bound) - 1, [None, pa.py_buffer((bound * data.itemsize).astype(np.int32)), pa.py_buffer(data)])
        return pa.ListArray.from_arrays(pa.array(bound, pa.int32()), pa.array(data))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = batch.column(batch.num_columns - 2).offsets.to_numpy().astype(np.int64)
            lo = 0
            while lo < len(batch):
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + (1 << 20), "right")) - 1)
                hi = min(hi, lo + 4096)
                part = batch.slice(lo, hi - lo)
                lo = hi
                bound, slots = _flat(part.column(part.num_columns - 2))
                rows = len(part)
                key = np.sort(np.repeat(np.arange(rows, dtype=np.int64) * dims, np.diff(bound)) + slots)
                first = np.flatnonzero(np.diff(key, prepend=-1))
                box, n = key[first] // dims, np.diff(first, append=len(key))
                each = np.bincount(box, minlength=rows) + layout + 1
                out = np.concatenate([[0], np.cumsum(each)])
                at, value = np.empty(out[-1], np.int32), np.empty(out[-1])
                to = np.arange(len(box)) + box * (layout + 1)
                at[to], value[to] = key[first] % dims, n / np.diff(bound)[box]
                last = out[1:, None] - np.arange(layout + 1, 0, -1)
                at[last] = dims + np.arange(layout + 1)
                value[last[:, :layout]] = _flat(part.column(part.num_columns - 1))[1].reshape(rows, layout)
                value[last[:, layout]] = 1.0
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], arrays(out, at), arrays(out, value)], [*part.schema.names[:-2], "at", "value"])

    return run


def _flat(column: pa.Array, kind: type = np.float64) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, numbers) of arrays, or of bytes that hold numbers of a kind."""
    bound = (column.offsets if pa.types.is_list(column.type) else np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1])
    if pa.types.is_list(column.type):
        bound = bound.to_numpy().astype(np.int64)
        return bound - bound[0], column.flatten().to_numpy()
    size, data = np.dtype(kind).itemsize, column.buffers()[2]
    bound = bound.astype(np.int64)
    numbers = np.frombuffer(data, np.uint8)[bound[0] : bound[-1]] if data is not None else np.empty(0, np.uint8)
    return (bound - bound[0]) // size, numbers.view(kind)


@dataclass(frozen=True)
class Model:
    """Labels, weights (one row a label), and the state of the optimiser after so many steps."""

    labels: tuple[str, ...]
    weights: np.ndarray
    first: np.ndarray = field(default=None)
    second: np.ndarray = field(default=None)
    step: int = 0

    @staticmethod
    def start(labels: Sequence[str], width: int) -> Model:
        zero = np.zeros((len(labels), width))
        return Model(tuple(labels), zero, zero, zero)

    def grown(self, labels: Sequence[str]) -> Model:
        """The model with labels that it lacks, which start at zero; the others keep their weights and their places."""
        new = [x for x in dict.fromkeys(labels) if x not in self.labels]
        grow = lambda a: np.vstack([a, np.zeros((len(new), a.shape[1]))])
        return replace(self, labels=(*self.labels, *new), weights=grow(self.weights), first=grow(self.first), second=grow(self.second))

    def save(self, spark: SparkSession, path: str) -> None:
        """A folder for each step, committed as one Spark write; on any file system that Spark writes."""
        rows = [(i, x, *(a[i].tolist() for a in (self.weights, self.first, self.second))) for i, x in enumerate(self.labels)]
        table = spark.createDataFrame(rows, "place int, label string, weights array<double>, first array<double>, second array<double>")
        table.coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/step={self.step}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Model | None:
        """The model of the last step that was saved whole; none if the folder has none."""
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(at):
            return None
        names = [x.getPath().getName() for x in files.listStatus(at)]
        whole = [int(n[5:]) for n in names if n.startswith("step=") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{n}/_SUCCESS"))]
        if not whole:
            return None
        rows = spark.read.parquet(f"{path.rstrip('/')}/step={max(whole)}").orderBy("place").collect()
        return Model(tuple(r["label"] for r in rows), *(np.array([r[c] for r in rows]) for c in ("weights", "first", "second")), max(whole))


def _logits(weights: np.ndarray, at: np.ndarray, value: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Rows by labels; every row has a constant, so none is empty."""
    return np.stack([np.add.reduceat(w[at] * value, bound[:-1]) for w in weights], axis=1)


def _sparse(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bound, at = _flat(batch.column(i), np.int32)
    return at.astype(np.intp), _flat(batch.column(i + 1))[1], bound


def _partial(model: Model, gradient: bool):
    """A task's summed cross-entropy, rows, hits and gradient; rows with a label of IGNORED don't count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        loss, n, hits, total = 0.0, 0, 0, np.zeros_like(model.weights)
        others = model.weights[:-1] - model.weights[-1]  # scores count from the last label's, so its own are zero
        for batch in batches:
            for lo in range(0, len(batch), 1024):  # what a slice takes stays in the processor's cache
                part = batch.slice(lo, 1024)
                gold = part.column(0).to_numpy()
                at, value, bound = _sparse(part, 1)
                z = np.zeros((len(part), len(model.labels)))
                if len(others):
                    z[:, :-1] = _logits(others, at, value, bound)
                ok = gold != IGNORED
                z -= z.max(axis=1, keepdims=True)
                p = np.exp(z)
                p /= p.sum(axis=1, keepdims=True)
                rows = np.flatnonzero(ok)
                loss -= float(np.log(p[rows, gold[rows]]).sum())
                hits += int((p[rows].argmax(axis=1) == gold[rows]).sum())
                n += len(rows)
                if gradient:
                    p[rows, gold[rows]] -= 1
                    p[~ok] = 0
                    long = np.diff(bound)
                    for k in range(len(others)):
                        total[k] += np.bincount(at, np.repeat(p[:, k], long) * value, minlength=total.shape[1])
        total[-1] = -total[:-1].sum(axis=0)  # a row's shares and its gold label both sum to one
        yield _sums(TaskContext.get().partitionId(), loss, n, hits, total if gradient else None)

    return run


def _sums(part: int, loss: float, n: int, hits: int, gradient: np.ndarray | None) -> pa.RecordBatch:
    raw = b"" if gradient is None else gradient.tobytes()
    return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "loss": [loss], "n": pa.array([n], pa.int64()), "hits": pa.array([hits], pa.int64()), "gradient": pa.array([raw], pa.binary())})


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted((r for batch in batches for r in batch.to_pylist()), key=lambda r: r["part"])
    if rows:
        gradient = sum(np.frombuffer(r["gradient"]) for r in rows) if rows[0]["gradient"] else None
        yield _sums(rows[0]["part"], sum(r["loss"] for r in rows), sum(r["n"] for r in rows), sum(r["hits"] for r in rows), gradient)


_SUM = "part int, loss double, n bigint, hits bigint, gradient binary"


def totals(encoded: DataFrame, model: Model, gradient: bool = True) -> tuple[float, int, int, np.ndarray | None]:
    """(summed loss, rows, hits, summed gradient) over encoded(gold, at, value)."""
    found = encoded.select("gold", "at", "value").mapInArrow(_partial(model, gradient), _SUM)
    parts = encoded.rdd.getNumPartitions()
    while parts > SUMS:
        parts = ceil(sqrt(parts)) if sqrt(parts) > SUMS else SUMS
        found = found.repartition(parts, "part").mapInArrow(_added, _SUM)
    rows = sorted(found.collect(), key=lambda r: r["part"])
    add = sum((np.frombuffer(r["gradient"]).reshape(model.weights.shape) for r in rows), np.zeros_like(model.weights)) if gradient else None
    return sum(r["loss"] for r in rows), sum(r["n"] for r in rows), sum(r["hits"] for r in rows), add


def _last(vectors: DataFrame) -> int | None:
    """The greatest place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _flat(batch.column(0), np.int32)[1]
            if len(at):
                yield pa.RecordBatch.from_pydict({"at": pa.array([int(at.max())], pa.int32())})

    return vectors.select("at").mapInArrow(run, "at int").agg(F.max("at")).first()[0]


def supervised(vectors: DataFrame, labels: Sequence[str]) -> DataFrame:
    """vectors with gold: the label's place; IGNORED for null and unknown ones."""
    place = F.array_position(F.array(*map(F.lit, labels)).cast("array<string>"), F.col("label")).cast("int") - 1
    return vectors.withColumn("gold", F.when(place >= 0, place).otherwise(IGNORED))


def rate(step: int, steps: int, lr: float, start: float, warmup: float) -> float:
    """From start to lr over the warm-up, then down to zero."""
    warm = steps * warmup
    return start + (lr - start) * step / warm if step < warm else lr * (steps - step) / max(steps - warm, 1e-12)


def adamw(model: Model, gradient: np.ndarray, lr: float, decay: float = 0.01, betas: tuple[float, float] = (0.9, 0.999), eps: float = 1e-8) -> Model:
    t = model.step + 1
    first = betas[0] * model.first + (1 - betas[0]) * gradient
    second = betas[1] * model.second + (1 - betas[1]) * gradient**2
    weights = model.weights * (1 - lr * decay) - lr * (first / (1 - betas[0] ** t)) / (np.sqrt(second / (1 - betas[1] ** t)) + eps)
    return replace(model, weights=weights, first=first, second=second, step=t)


def train(vectors: DataFrame, validation: DataFrame | None = None, labels: Sequence[str] = (), steps: int = 40, lr: float = 0.2, start: float | None = None, warmup: float = 0.1, batches: int = 1, interval: int = 10, patience: int = 3, model: Model | None = None, path: str | None = None, keys: Sequence[str] = ("doc_id", "box_idx")) -> tuple[Model, list[dict]]:
    """(model, metrics of each validation) fitted to vectors(keys, label, at, value).

    Labels that the rows have beyond the given ones, or a given model's, are added in their order;
    weights of known labels are kept.  Rows with a null label don't count.  A step takes all rows, or
    with batches the rows whose keys hash to its turn.  Every interval steps the validation rows (or
    else the training rows) are scored, and with a path the model is saved; training stops when the
    loss has not fallen for patience scores in a row, and the best scored model is returned.  A call with the path
    of a run that was cut off goes on from its last saved step.  Vectors are best a stored table:
    every step reads them, and packed.
    """
    spark = vectors.sparkSession
    saved = Model.load(spark, path) if path else None
    width = _last(vectors)
    found = [r["label"] for r in vectors.filter("label IS NOT NULL").select("label").distinct().orderBy("label").collect()]
    now = saved or model or Model.start((), (width if width is not None else -1) + 1)
    now = now.grown([*labels, *found])
    if not now.labels or now.step >= steps and saved:
        return now, []
    rows = supervised(vectors, now.labels)
    turn = F.pmod(F.xxhash64(*keys), F.lit(batches))
    held = rows if validation is None else supervised(validation, now.labels)
    metrics, best, wait = [], (float("inf"), now), 0
    for step in range(now.step, steps + 1):
        scored, alike, gradient = step % interval == 0 or step == steps, held is rows and batches == 1 and step < steps, None
        if scored:
            # where training rows are scored, the step's gradient comes from the same pass
            loss, n, hits, gradient = totals(held, now, alike)
            loss = loss / max(n, 1)
            metrics.append({"step": step, "loss": loss, "accuracy": hits / max(n, 1), "lr": rate(step, steps, lr, lr if start is None else start, warmup)})
            if path and not (saved and saved.step == step):
                now.save(spark, path)
            best, wait = ((loss, now), 0) if loss < best[0] else (best, wait + 1)
            if wait >= patience:
                break
        if step < steps:
            if gradient is None:
                _, n, _, gradient = totals(rows if batches == 1 else rows.filter(turn == step % batches), now)
            now = adamw(now, gradient / max(n, 1), rate(step, steps, lr, lr if start is None else start, warmup))
    return best[1], metrics


def classify(vectors: DataFrame, model: Model, keys: Sequence[str] = ("doc_id", "box_idx")) -> DataFrame:
    """keys, label, score: the most likely label and its probability; boxes without text get none."""
    names, weights = list(model.labels), model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = _logits(weights, *_sparse(batch, len(keys) + 1)) if len(batch) else np.zeros((0, len(names)))
            p = np.exp(z - z.max(axis=1, keepdims=True))
            score = p.max(axis=1) / p.sum(axis=1)
            none = ~batch.column(len(keys)).to_numpy(zero_copy_only=False).astype(bool)
            label = pa.array([names[k] for k in p.argmax(axis=1)], pa.string(), mask=none)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keys))), label, pa.array(score, mask=none)], [*keys, "label", "score"])

    schema = StructType([*(vectors.schema[k] for k in keys), StructField("label", StringType()), *StructType.fromDDL("score double").fields])
    return vectors.select(*keys, (F.coalesce(F.length("text"), F.lit(0)) > 0).alias("has_text"), "at", "value").mapInArrow(run, schema)


def label_boxes(featured: DataFrame, model: Model, dims: int = DIMS, layout: Sequence[str] = LAYOUT, keys: Sequence[str] = ("doc_id", "box_idx")) -> DataFrame:
    """featured with the model's label for each box; the box's own label, if there is one, is not looked at."""
    rows = featured.drop("label")
    found = classify(box_vectors(rows.withColumn("label", F.lit(None).cast("string")), dims, layout, keys=keys), model, keys)
    return rows.join(found.drop("score"), list(keys), "left")
