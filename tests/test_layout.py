import random

import pytest
from pyspark.sql import functions as F

from leafgrid.functions.graph import components
from leafgrid.operators import layout

CHARS = "doc_id string, page_num int, pos long, x0 double, x1 double, y0 double, y1 double, ch string, block string"


def random_page(rng, doc, page):
    """Characters of ragged lines in two columns with jitter, stacked closely or loosely."""
    out, pos, y = [], 0, 900.0
    for _ in range(rng.randint(1, 14)):
        h = rng.choice([8.0, 8.0, 10.0, 20.0])
        for x in rng.sample([10.0, 14.0, 300.0], rng.randint(1, 2)):
            for _ in range(rng.randint(1, 12)):
                dy = rng.choice([0.0, 0.0, 0.0, 1.0, 6.0])
                out.append((doc, page, pos, x, x + 5, y + dy, y + dy + h, rng.choice("abc é"), "x"))
                pos += rng.randint(1, 3)
                x += rng.choice([5.0, 5.0, 5.5, 7.0, 15.0, 15.5, 40.0])
        y -= h + rng.choice([0.0, 2.0, 4.0, 9.0])
    return out


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(11)
    return [c for d in range(12) for p in range(3) for c in random_page(rng, f"d{d}", p)]


def brute_lines(chars, overlap=0.5, margin=2.05, word=0.1):
    by = {}
    for c in sorted(chars, key=lambda c: c[2]):
        by.setdefault(c[:2], []).append(c)
    out = []
    for page, cs in by.items():
        lines = []
        for n, c in enumerate(cs):
            _, _, _, x0, x1, y0, y1, ch, _ = c
            if n:
                _, _, _, a0, a1, b0, b1, _, _ = cs[n - 1]
                shared = min(abs(b0 - y1), abs(b1 - y0)) if b0 <= y1 and y0 <= b1 else -1
                gap = 0 if a0 <= x1 and x0 <= a1 else min(abs(a0 - x1), abs(a1 - x0))
                if min(y1 - y0, b1 - b0) * overlap < shared and gap < max(x1 - x0, a1 - a0) * margin:
                    lines[-1].append((" " if a1 < x0 - word * max(x1 - x0, y1 - y0) else "") + ch)
                    boxes[-1].append(c)
                    continue
            if not n:
                boxes = []
            lines.append([ch])
            boxes.append([c])
        for i, (text, box) in enumerate(zip(lines, boxes, strict=True)):
            if "".join(text).strip():
                out.append((*page, i, min(c[3] for c in box), max(c[4] for c in box), min(c[5] for c in box), max(c[6] for c in box), "".join(text), len(box)))
    return out


def brute_blocks(lines, margin=0.5):
    root = {(*x[:2], x[2]): x[2] for x in lines}
    near = []
    for a in lines:
        for b in lines:
            if a[:2] == b[:2] and a[2] != b[2]:
                h = a[6] - a[5]
                d = h * margin
                if b[4] > a[3] and b[3] < a[4] and b[6] > a[5] - d and b[5] < a[6] + d and abs(b[6] - b[5] - h) <= d and (abs(a[3] - b[3]) <= d or abs(a[4] - b[4]) <= d or abs((a[3] + a[4] - b[3] - b[4]) / 2) <= d):
                    near.append(((*a[:2], a[2]), (*b[:2], b[2])))
    moved = True
    while moved:
        moved = False
        for a, b in near:
            least = min(root[a], root[b])
            moved |= root[a] != least or root[b] != least
            root[a] = root[b] = least
    return {(k, v) for k, v in root.items()}


def test_lines_and_blocks(spark, pages):
    chars = spark.createDataFrame(pages, CHARS).repartition(5)
    lines = layout.lines_of_chars(chars)
    want = brute_lines(pages)
    assert sorted(map(tuple, lines.collect())) == sorted(want)
    blocks = layout.blocks_of_lines(lines).collect()
    found = {((r.doc_id, r.page_num, r.line_idx), r.block) for r in blocks}
    assert found == brute_blocks(want) and len({(k[:2], b) for k, b in found}) < len(found)


def test_degenerate_characters(spark):
    rows = [("d", 0, 0, None, None, None, None, "a", ""), ("d", 0, 1, 0.0, 0.0, 0.0, 0.0, "b", ""), ("d", 0, 2, 0.0, 0.0, 0.0, 0.0, None, ""), ("d", None, 0, 1.0, 2.0, 1.0, 2.0, " ", ""), ("e", 1, 0, 1.0, 2.0, 1.0, 2.0, "é", "")]
    lines = layout.lines_of_chars(spark.createDataFrame(rows, CHARS))
    assert sorted((r.doc_id, r.line_idx, r.text) for r in lines.collect()) == [("d", 0, "a"), ("d", 1, "b"), ("e", 0, "é")]
    none = layout.lines_of_chars(spark.createDataFrame([], CHARS))
    assert none.collect() == [] and layout.block_order(layout.blocks_of_lines(none)).collect() == []


def slow_order(rects, flow):
    """The same merging with every pair looked at anew in each round."""
    groups = [(i, r, [i]) for i, r in enumerate(rects)]
    waits, number = set(), len(rects)
    union = lambda p, q: (min(p[0], q[0]), min(p[1], q[1]), max(p[2], q[2]), max(p[3], q[3]))
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    while len(groups) > 1:
        ranked = sorted((((a[0], b[0]) in waits), area(union(a[1], b[1])) - area(a[1]) - area(b[1]), a[0], b[0], a, b) for k, a in enumerate(groups) for b in groups[k + 1 :])
        late, _, i, j, a, b = ranked[0]
        whole = union(a[1], b[1])
        if not late and any(g[0] not in (i, j) and g[1][0] < whole[2] and g[1][2] > whole[0] and g[1][1] < whole[3] and g[1][3] > whole[1] for g in groups):
            waits.add((i, j))
            continue
        key = lambda g: ((1 - flow) * g[1][0] - (1 + flow) * (g[1][1] + g[1][3]), g[0])
        first, second = sorted((a, b), key=key)
        groups = [g for g in groups if g[0] not in (i, j)] + [(number, whole, first[2] + second[2])]
        number += 1
    return groups[0][2] if groups else []


def test_merge_order_against_slow_merging():
    rng = random.Random(8)
    for flow in (0.5, -1.0, 1.0):
        for _ in range(60):
            rects = [(x, y, x + rng.randint(0, 9), y + rng.randint(0, 5)) for x, y in ((rng.randint(0, 30), rng.randint(0, 30)) for _ in range(rng.randint(0, 9)))]
            assert layout.merge_order(rects, flow) == slow_order(rects, flow)


def test_two_columns_are_read_one_after_the_other():
    left = [(0.0, 100.0 - 12 * i, 40.0, 110.0 - 12 * i) for i in range(4)]
    right = [(60.0, 100.0 - 12 * i, 100.0, 110.0 - 12 * i) for i in range(4)]
    assert layout.merge_order([*left, *right], 0.0) == list(range(8))


def test_block_order_of_pages(spark, pages):
    blocks = layout.blocks_of_lines(layout.lines_of_chars(spark.createDataFrame(pages, CHARS))).persist()
    found = layout.block_order(blocks).collect()
    by = {}
    for r in sorted(found, key=lambda r: r.block):
        by.setdefault((r.doc_id, r.page_num), []).append(r)
    for rows in by.values():
        order = layout.merge_order([(r.x0, r.y0, r.x1, r.y1) for r in rows], 0.5)
        assert [rows[k].order_idx for k in order] == list(range(len(rows)))
    lines = layout.lines_in_order(blocks, layout.block_order(blocks, None)).collect()
    for d in {r.doc_id for r in lines}:
        own = sorted((r for r in lines if r.doc_id == d), key=lambda r: r.box_idx)
        assert [r.box_idx for r in own] == list(range(len(own))) and [r.page_num for r in own] == sorted(r.page_num for r in own)
    blocks.unpersist()


def test_components_of_long_chains(spark):
    nodes = spark.range(200).select((F.col("id") % 2).alias("g"), F.col("id").cast("int").alias("n"))
    edges = spark.range(198).filter("id <> 51").select((F.col("id") % 2).alias("g"), F.col("id").cast("int").alias("a"), (F.col("id") + 2).cast("int").alias("b"))
    found = {(r.g, r.n): r.root for r in components(nodes, edges, ["g"], "n").collect()}
    assert found == {(n % 2, n): 0 if n % 2 == 0 else 1 if n <= 51 else 53 for n in range(200)}
    alone = components(nodes, edges.limit(0), ["g"], "n").collect()
    assert all(r.n == r.root for r in alone) and len(alone) == 200
