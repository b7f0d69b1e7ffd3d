import random
import re
from collections import Counter

import pytest

from leafgrid.llm import winnowing
from leafgrid.llm.winnowing import contamination

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def brute(docs, items, span):
    windows = {}
    for item, text in items:
        w = words(text)
        m = min(len(w), span)
        for s in range(len(w) - m + 1) if m else ():
            windows.setdefault(tuple(w[s : s + m]), set()).add(str(item) if item is not None else "")
    sizes = {len(k) for k in windows}
    for doc_id, text in docs:
        w = words(text)
        at = [(s, m) for m in sizes for s in range(len(w) - m + 1) if tuple(w[s : s + m]) in windows]
        found = set().union(*[windows[tuple(w[s : s + m])] for s, m in at])
        yield doc_id, len(w), len({s + i for s, m in at for i in range(m)}), tuple(sorted(found)), tuple(sorted(at))


def agree(docs, doc_rows, items, item_rows, **options):
    found = [(r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), tuple(map(tuple, r.hits))) for r in contamination(docs, items, **options).collect()]
    assert Counter(found) == Counter(brute(doc_rows, item_rows, options.get("span", 10)))
    return found


@pytest.fixture(scope="module")
def passages(spark):
    """Items of all lengths, ties, case, letters whose case folds into ASCII, and documents that hold parts of them."""
    rng = random.Random(4)
    vocabulary = ["a", "b", "the", "The", "été", "ÉTÉ", "K9", "K9", "İx", "ix", "x1", "日本"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 4, 5, 7, 9, 10, 11, 30]))) for i in range(12)]
    items += [(12, None), (13, "..."), (None, text(12)), (14, items[8][1]), (14, items[8][1]), (15, text(3) + "same " * 40)]
    docs = []
    for i in range(60):
        parts = [text(rng.randint(0, 12))]
        for _ in range(rng.randint(0, 3)):
            part = (rng.choice(items)[1] or "").split(" ")
            a = rng.randint(0, len(part))
            parts += [" ".join(part[a : a + rng.randint(1, 40)]), " ", text(rng.randint(0, 3))]
        docs.append((i, "".join(parts)))
    docs += [(1, docs[1][1]), (None, docs[2][1]), (61, "same " * 3_000 + (items[8][1] or "")), (62, None), (63, "")]
    schema = "string, row string, f string, size string, hits string, items string"
    return spark.createDataFrame([(*d, *"xxxxx") for d in docs], f"doc_id long, text {schema}").repartition(4), docs, spark.createDataFrame([(*d, *"xxxxx") for d in items], f"item_id long, text {schema}"), items


@pytest.mark.parametrize("options", [{}, {"span": 6, "grain": 3}, {"grain": 10}, {"span": 4, "grain": 1}])
def test_against_brute_force(passages, options):
    assert sum(r[2] > 0 for r in agree(*passages, **options)) > 20


def test_full_bitmap_and_shuffled_join(passages, monkeypatch):
    monkeypatch.setattr(winnowing, "BITS", 64)
    monkeypatch.setattr(winnowing, "BROADCAST", 0)
    agree(*passages)


def test_text_beyond_a_chunk(spark):
    long = " ".join(f"w{i}" for i in range(250_000))
    docs = [(1, long), (2, long + " " + long[:200])]
    items = [(1, long[1_500_000:1_500_200]), (2, "w7 w8")]
    agree(spark.createDataFrame(docs, "doc_id long, text string"), docs, spark.createDataFrame(items, "item_id long, text string"), items)


def test_odd_rows_and_empty_tables(spark, odd, rows, none):
    item = spark.createDataFrame([(1, rows[3][1][:400])], "item_id long, text string")
    agree(odd, [(r[0], r[1]) for r in rows], item, [(1, rows[3][1][:400])])
    empty = contamination(odd, item.limit(0)).collect()
    assert len(empty) == len(rows) and not any(r.n_hit or r["items"] or r.hits for r in empty)
    assert contamination(none, item).collect() == []


def test_corpus(spark, corpus):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    rows = lambda df, c: [tuple(r) for r in df.select(c, "text").collect()]
    found = agree(corpus, rows(corpus, "doc_id"), items, rows(items, "item_id"))
    assert any(r[2] for r in found)
