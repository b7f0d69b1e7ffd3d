"""The box transformer against sums written out term by term, and its positions against the query's."""

import math

import numpy as np
import pytest

from leafgrid.functions import layers
from leafgrid.operators import geometry

SIZE, HEADS, PLACES = 8, 2, 6


def by_hand(a, x, positions, placed):
    """Scores of a RelativeAttention, one number at a time."""
    n, head = len(x), SIZE // HEADS
    half = head // 2
    q, k = x @ a.query.weight + a.query.bias, x @ a.key.weight + a.key.bias

    def place(projection, z, c, h):
        weight, bias = projection
        share = a.places[z][c * SIZE // 2 : (c + 1) * SIZE // 2] @ weight[c] + bias[c]
        return share[h * half : (h + 1) * half]

    out = np.zeros((HEADS, n, n))
    for h in range(HEADS):
        for i in range(n):
            for j in range(n):
                qi, kj = q[i, h * head : (h + 1) * head], k[j, h * head : (h + 1) * head]
                total = qi @ kj
                if placed[i, j]:
                    for c in range(2):
                        z = min(max(PLACES // 2 + positions[i, j, c], 0), PLACES - 1)
                        total += qi[c * half : (c + 1) * half] @ place(a.pos_key, z, c, h)
                        total += kj[c * half : (c + 1) * half] @ place(a.pos_query, z, c, h)
                out[h, i, j] = total / math.sqrt(head) / math.sqrt(3)
    return out


def page(n=5, seed=3):
    rng = np.random.default_rng(seed)
    positions = rng.integers(-5, 6, (n, n, 2))
    placed = rng.random((n, n)) < 0.7
    return rng.normal(size=(n, SIZE)), positions, placed


def test_scores():
    a = layers.BoxTransformer.seeded(SIZE, HEADS, 1, PLACES).layers[0].attention
    x, positions, placed = page()
    np.testing.assert_allclose(a.scores(x, positions, placed), by_hand(a, x, positions, placed))


def test_masked_keys_have_no_weight():
    model = layers.BoxTransformer.seeded(SIZE, HEADS, 2, PLACES)
    x, positions, _ = page()
    mask = np.array([True, True, True, False, False])
    np.testing.assert_allclose(model(x, positions, mask)[:3], model(x[:3], positions[:3, :3]), atol=1e-9)


def test_closed_gates_leave_the_norms():
    model = layers.BoxTransformer.seeded(SIZE, HEADS, 2, PLACES, gate=0.0)
    x, positions, _ = page()
    want = x
    for _ in range(4):
        want = layers.layer_norm(want)
    np.testing.assert_allclose(model(x, positions), want)


def test_order_of_boxes_does_not_matter():
    model = layers.BoxTransformer.seeded(SIZE, HEADS, 2, PLACES)
    x, positions, _ = page()
    turn = np.array([3, 0, 4, 1, 2])
    np.testing.assert_allclose(model(x[turn], positions[turn][:, turn]), model(x, positions)[turn])


def test_attention_without_places():
    model = layers.BoxTransformer.seeded(SIZE, HEADS, 1, None, activation="glu")
    x, positions, _ = page()
    np.testing.assert_allclose(model(x, positions), model(x))
    with pytest.raises(ValueError):
        layers.BoxTransformer.seeded(SIZE, HEADS, 1, None, modes=("c2p",))(x)


def test_positions_are_those_of_the_query(spark):
    rng = np.random.default_rng(5)
    x0, y0 = rng.integers(0, 64, 12) / 64, rng.integers(0, 64, 12) / 64
    y1 = y0 + rng.integers(0, 8, 12) / 128  # some boxes have no height
    rows = [(1, 0, i, float(x0[i]), float(y0[i]), float(y1[i])) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, page_num int, box_idx int, x0 double, y0 double, y1 double")
    found = layers.page_positions(x0, y0, y1)
    pairs = geometry.relative_positions(df).collect()
    assert len(pairs) == 144
    assert all((r.dx, r.dy) == tuple(found[r.i, r.j]) for r in pairs)


def test_pages_are_apart(spark):
    rows = [("a", p, i, 0.1 * i, 0.2 * i, 0.2 * i + 0.1, [float(i + c) for c in range(SIZE)]) for p in range(2) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id string, page_num int, box_idx int, x0 double, y0 double, y1 double, embedding array<double>")
    model = layers.BoxTransformer.seeded(SIZE, HEADS, 1, PLACES)
    out = {(r.page_num, r.box_idx): r.context for r in layers.contextualise(df, model).collect()}
    assert len(out) == 6 and all(len(v) == SIZE for v in out.values())
    for i in range(3):
        assert out[0, i] == pytest.approx(out[1, i])


def test_pooling_and_text_vectors():
    words = np.arange(6.0).reshape(3, 2)
    kernels = {1: np.ones((1, 2, 1)), 3: np.ones((3, 2, 1))}
    # width 1: the greatest word sums to 9; width 3: all three words sum to 15
    assert layers.cnn_pool(words, kernels, np.eye(2)).tolist() == [9.0, 15.0]
    tables = [np.array([[0.0], [1.0], [2.0]]), np.array([[10.0], [20.0]])]
    assert layers.text_embedding(np.array([[1, 1], [7, -1]]), tables).tolist() == [[21.0], [10.0]]


def test_pages_of_one_size_go_together(spark):
    rng = np.random.default_rng(3)
    model = layers.BoxTransformer.seeded(SIZE, HEADS, 2, PLACES)
    rows = [(p, 0, i, *map(float, rng.random(2)), 1.0, rng.normal(size=SIZE).tolist()) for p in range(9) for i in range(1 + p % 3)]
    df = spark.createDataFrame(rows, "doc_id long, page_num int, box_idx int, x0 double, y0 double, y1 double, embedding array<double>").repartition(2)
    found = layers.contextualise(df, model)
    assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()
    out = {(r.doc_id, r.box_idx): r.context for r in found.collect()}
    for p in range(9):
        own = [r for r in rows if r[0] == p]
        want = model(np.array([r[6] for r in own]), layers.page_positions(*(np.array([r[k] for r in own]) for k in (3, 4, 5))))
        np.testing.assert_allclose(np.array([out[p, i] for i in range(len(own))]), want)
