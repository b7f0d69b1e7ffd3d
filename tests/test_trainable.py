import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafgrid.functions import embedding
from leafgrid.functions.features import WORD, layout_features, tokens, word_marks, word_shape
from leafgrid.functions.transliterate import ascii_fold
from leafgrid.operators import trainable
from leafgrid.plans import catalog

ROWS = "doc_id long, box_idx int, page_num int, x0 double, x1 double, y0 double, y1 double, text string, label string"


@pytest.fixture(scope="module")
def boxes(spark):
    """Headers lie on top, totals hold numbers, bodies the rest; some have no text, some no label."""
    rng = random.Random(6)
    rows = []
    for d in range(30):
        for b in range(12):
            top, number = rng.random() < 0.3, rng.random() < 0.3
            y = rng.uniform(0, 0.1) if top else rng.uniform(0.3, 0.9)
            text = " ".join(str(rng.randint(10, 99)) if number else rng.choice(["der", "Befund", "ist", "gut"]) for _ in range(rng.randint(1, 4)))
            label = "header" if top else "total" if number else "body"
            rows.append((d, b, b // 6, 0.1, 0.5, y, y + 0.02, "" if b == 3 else text, None if b == 5 else label))
    return layout_features(spark.createDataFrame(rows, ROWS)).persist()


@pytest.fixture(scope="module")
def vectors(boxes):
    return trainable.box_vectors(boxes, dims=64).persist()


def local(rows, labels, steps, lr, width):
    """The same training, dense and in one process."""
    x = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        np.add.at(x[i], r["at"], r["value"])
    gold = np.array([labels.index(r["label"]) if r["label"] is not None else -1 for r in rows])
    x, gold = x[gold >= 0], gold[gold >= 0]
    w, m, v = (np.zeros((len(labels), width)) for _ in range(3))
    for t in range(1, steps + 1):
        z = x @ w.T
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(gold)), gold] -= 1
        g = p.T @ x / len(gold)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        warm = 0.1 * steps
        rate = lr if t - 1 < warm else lr * (steps - t + 1) / (steps - warm)
        w = w * (1 - rate * 0.01) - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def test_training_equals_a_local_run(vectors):
    model, metrics = trainable.train(vectors.repartition(40), steps=8, interval=4)
    rows = vectors.collect()
    assert model.labels == ("body", "header", "total") and model.step == 8
    assert np.allclose(model.weights, local(rows, list(model.labels), 8, 0.2, model.weights.shape[1]), atol=1e-9)
    assert [m["step"] for m in metrics] == [0, 4, 8] and metrics[-1]["loss"] < metrics[0]["loss"]


def test_training_reaches_the_floor_held_out(vectors, boxes):
    held = vectors.filter("doc_id % 3 = 0")
    model, _ = trainable.train(vectors.filter("doc_id % 3 > 0"), held)
    found = {(r.doc_id, r.box_idx): r.label for r in trainable.classify(held, model).collect()}
    rows = boxes.filter("doc_id % 3 = 0").collect()
    assert all(found[r.doc_id, r.box_idx] is None for r in rows if r.text == "")
    judged = [found[r.doc_id, r.box_idx] == r.label for r in rows if r.text and r.label]
    assert sum(judged) > 0.9 * len(judged)


def test_labels_grow_and_keep_their_weights(vectors):
    model, _ = trainable.train(vectors.filter("label = 'body' OR label IS NULL"), steps=2, labels=["z", "body"])
    assert model.labels == ("z", "body")
    grown = model.grown(["total", "body"])
    assert grown.labels == ("z", "body", "total") and np.array_equal(grown.weights[:2], model.weights) and not grown.weights[2].any()
    again, _ = trainable.train(vectors, steps=3, model=model)
    assert again.labels[:2] == ("z", "body") and set(again.labels) == {"z", "body", "header", "total"}


def test_a_cut_off_run_goes_on(spark, vectors, tmp_path):
    path, whole = f"file://{tmp_path}/run", trainable.train(vectors, steps=6, interval=2)[0]
    calls = []
    plain = trainable.adamw

    def dies(*args):
        calls.append(1)
        if len(calls) == 4:
            raise KeyboardInterrupt
        return plain(*args)

    trainable.adamw = dies
    try:
        with pytest.raises(KeyboardInterrupt):
            trainable.train(vectors, steps=6, interval=2, path=path)
    finally:
        trainable.adamw = plain
    assert trainable.Model.load(spark, path).step == 2
    again, metrics = trainable.train(vectors, steps=6, interval=2, path=path)
    assert [m["step"] for m in metrics] == [2, 4, 6] and np.allclose(again.weights, whole.weights)
    assert trainable.Model.load(spark, path + "-none") is None


def test_early_stop_and_batches(vectors):
    _, metrics = trainable.train(vectors, steps=30, interval=1, patience=2, lr=50.0)
    assert metrics[-1]["step"] < 30
    model, _ = trainable.train(vectors, steps=9, batches=3)
    assert model.weights.any()


def test_empty_tables(vectors):
    none = vectors.limit(0)
    model, metrics = trainable.train(none)
    assert model.labels == () and metrics == []
    assert trainable.train(none, labels=["a"], steps=1)[0].labels == ("a",)
    assert trainable.classify(none, trainable.train(vectors, steps=1)[0]).collect() == []


def test_text_embedding_against_sums(spark, boxes):
    words = tokens(boxes).withColumnRenamed("token", "word")
    named = embedding.word_features(words).collect()
    rng = np.random.default_rng(1)
    tables, vector = {}, {}
    for kind in embedding.KINDS:
        values = sorted({r.value for r in named if r.kind == kind})[1:]
        for v in [*values, *([None] if kind != "suffix" else [])]:
            vector[kind, v] = rng.normal(size=5)
        tables[kind] = spark.createDataFrame([(v, x.tolist()) for (k, v), x in vector.items() if k == kind], "value string, vector array<double>")
    want = {}
    for r in named:
        v = vector.get((r.kind, r.value), vector.get((r.kind, None), np.zeros(5)))
        want[r.doc_id, r.box_idx] = want.get((r.doc_id, r.box_idx), 0) + r.n * v
    for bound in (embedding.BROADCAST, -1):
        plain, embedding.BROADCAST = embedding.BROADCAST, bound
        found = {(r.doc_id, r.box_idx): r.embedding for r in embedding.text_embedding(words, tables, 5).collect()}
        embedding.BROADCAST = plain
        assert found.keys() == want.keys() and all(np.allclose(found[k], want[k]) for k in want)
    assert words.filter(F.col("word") == "").count() == 0


def test_vectors_count_words_without_a_shuffle(spark):
    rows = [(1, 0, 0, 0.0, 0.5, 0.0, 0.1, "Straße straße 12 Ab ab ab", "x"), (1, 1, 0, 0.0, 0.5, 0.0, 0.1, "", "x"), (2, 0, 0, 0.0, 0.5, 0.0, 0.1, None, None)]
    boxes = layout_features(spark.createDataFrame(rows, ROWS))
    plain = boxes.drop("first_page", "last_page").withColumns({"first_page": F.lit(1.0), "last_page": F.lit(0.0)})
    assert "Exchange" not in trainable.box_vectors(spark.createDataFrame(plain.collect(), plain.schema), 64)._jdf.queryExecution().executedPlan().toString()
    hashed = embedding.word_features(tokens(plain).withColumnRenamed("token", "word")).select("doc_id", "box_idx", F.pmod(F.xxhash64("kind", "value"), F.lit(64)).cast("int").alias("slot"), "n")
    want, total = {}, {}
    for r in hashed.collect():
        key = r.doc_id, r.box_idx
        want.setdefault(key, {})[r.slot] = want.get(key, {}).get(r.slot, 0) + r.n
        total[key] = total.get(key, 0) + r.n
    for r in trainable.box_vectors(plain, 64).collect():
        key = r.doc_id, r.box_idx
        found = [(s, v) for s, v in zip(r.at, r.value, strict=True) if s < 64]
        assert found == [(s, n / total[key]) for s, n in sorted(want.get(key, {}).items())]
        assert r.at[len(found) :] == list(range(64, 64 + len(r.at) - len(found))) and r.value[-1] == 1.0


def test_marks_of_all_words_at_once_are_those_of_each(spark):
    rng = random.Random(3)
    texts = [None, "", "   ", "a  b   c  d'e f' g'", "word\x01 Ab\x01\x01  x", "ΣΑΣ ß Привет ΟΥ", "½ ŉ º Œuvre… 12.5 3,4,5 « oui » l'été\t\r x'\r", "İ I ı ſ Ŀ é", "x" * 100 + " " + "É" * 99 + " aaaaaaa 1111111  b", "…  ‥ ‑   a․b \x1c\x00 \x85 z"]
    texts += ["".join(rng.choice("aB1  '.éßç«\t\x0bŒXx9,İ…[Σ" if i % 3 else "aB1  '.éßç«ŒX,…") for _ in range(rng.randint(0, 60))) for i in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).persist()
    words = rows.select("doc_id", F.coalesce(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.array().cast("array<string>")).alias("w")).select("doc_id", F.transform("w", lambda w: ascii_fold(w)).alias("w"))
    want = words.select("doc_id", F.transform("w", word_shape), F.transform("w", lambda w: F.lower(w)))
    assert sorted(word_marks(rows).select("doc_id", "shapes", "lows").collect()) == sorted(want.collect())


def test_packed_vectors_are_the_same(boxes, vectors):
    packed = trainable.box_vectors(boxes, dims=64, packed=True).persist()
    plain = {(r.doc_id, r.box_idx): (r.at, r.value) for r in vectors.collect()}
    assert {(r.doc_id, r.box_idx): (np.frombuffer(r.at, np.int32).tolist(), np.frombuffer(r.value).tolist()) for r in packed.collect()} == plain
    want, found = (trainable.train(v, steps=6, interval=3) for v in (vectors, packed))
    assert np.allclose(found[0].weights, want[0].weights, atol=1e-9) and found[0].weights.shape == want[0].weights.shape
    assert sorted(trainable.classify(packed, found[0]).select("doc_id", "box_idx", "label").collect(), key=str) == sorted(trainable.classify(vectors, want[0]).select("doc_id", "box_idx", "label").collect(), key=str)
    assert trainable.train(packed.limit(0))[0].labels == ()


def test_a_scored_step_reads_the_rows_once(vectors, monkeypatch):
    passes, totals = [], trainable.totals
    monkeypatch.setattr(trainable, "totals", lambda *args: passes.append(1) or totals(*args))
    _, metrics = trainable.train(vectors, steps=4, interval=2)
    assert [m["step"] for m in metrics] == [0, 2, 4] and len(passes) == 5


def test_train_boxes_stores_learnt_documents_alone(spark, monkeypatch):
    kept, settle = [], catalog.settle
    monkeypatch.setattr(catalog, "settle", lambda df: kept.append(settle(df)) or kept[-1])
    found = catalog.train_boxes(spark, "/root/testdata/sf0.001")
    assert [(t.filter("doc_id % 2 <> 0").count(), dict(t.dtypes)["at"]) for t in kept] == [(0, "binary")]
    boxes = catalog._boxes(spark, "/root/testdata/sf0.001").filter("doc_id % 2 = 1")
    assert sorted(found.select("doc_id", "box_idx").collect()) == sorted(boxes.select("doc_id", "box_idx").collect())


def test_train_boxes_scores_stores_learnt_documents_alone(spark, monkeypatch):
    kept, settle = [], catalog.settle
    monkeypatch.setattr(catalog, "settle", lambda df: kept.append(settle(df)) or kept[-1])
    found = catalog.train_boxes_scores(spark, "/root/testdata/sf0.001")
    assert [(t.filter("doc_id % 2 <> 0").count(), dict(t.dtypes)["at"]) for t in kept] == [(0, "binary")]
    boxes = catalog._boxes(spark, "/root/testdata/sf0.001").filter("doc_id % 2 = 1")
    assert sum(r.support for r in found.collect()) == boxes.count()
