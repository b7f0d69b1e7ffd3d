"""Numbering, vocabularies, tokens, shapes and batches against plain Python."""

import random

import regex

from leafgrid.functions import features


def test_numbering_across_ranges(spark):
    rng = random.Random(4)
    keys = [rng.randrange(3000) for _ in range(5000)] + [None, None]
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k int, i int")
    found = features.numbered(rows, ("k", "i"), "place").collect()
    want = sorted(enumerate(keys), key=lambda x: (x[1] is not None, x[1] or 0, x[0]))
    assert [(r.i, r.k) for r in sorted(found, key=lambda r: r.place)] == want
    assert sorted(r.place for r in found) == list(range(len(keys)))


def test_numbering_of_nothing_and_of_text(spark):
    assert features.numbered(spark.createDataFrame([], "k string"), ("k",), "place").collect() == []
    rows = spark.createDataFrame([(f"key {i:04}",) for i in range(1000)], "k string")
    assert all(int(r.k[4:]) == r.place for r in features.numbered(rows, ("k",), "place").collect())


def test_vocabulary_round_trip(spark):
    words = ["pear", "fig", "pear", None, "plum", "fig", "apple"]
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "at int, word string")
    known = features.build_vocabulary(rows.filter("word IS NOT NULL"), "word", ("at",))
    assert {r.value: r.idx for r in known.collect()} == {"pear": 1, "fig": 2, "plum": 3, "apple": 4}
    codes = features.encode(rows, known, "word")
    assert [r.idx for r in codes.orderBy("at").collect()] == [1, 2, 1, 0, 3, 2, 4]
    assert [r.value for r in features.decode(codes, known, "idx").orderBy("at").collect()] == words


def test_batches_of_documents(spark):
    rows = spark.createDataFrame([(f"doc {i:03}", i) for i in range(250)], "doc_id string, i int")
    assert all(r.batch == r.i // 4 for r in features.batch_docs(rows, 4).collect())


#: Hand-written: words with the blank after them, numbers, marks and breaks.
TEXTS = {
    "It's 3.5 km, no?": ["It'", "s ", "3.5 ", "km", ", ", "no", "?"],
    "a\nb\t c": ["a", "\n", "b", "\t ", "c"],
    "naïve  ÉTÉ «x»": ["naïve ", " ", "ÉTÉ ", "«", "x", "»"],
    "": [],
    "12,5% of №7": ["12,5", "% ", "of ", "№", "7"],
}


def test_tokens(spark):
    rows = spark.createDataFrame([(i, 0, t) for i, t in enumerate([*TEXTS, None])], "doc_id int, box_idx int, text string")
    found: dict[int, list[str]] = {}
    for r in features.tokens(rows).orderBy("doc_id", "word_idx").collect():
        found.setdefault(r.doc_id, []).append(r.token)
    assert [found.get(i, []) for i in range(len(TEXTS) + 1)] == [*TEXTS.values(), []]


def test_word_shapes(spark):
    words = ["Abc", "ABCDEFG", "a1B2", "Éñ٣", "ßtraße", "x" * 99, "x" * 100, "-----!", "...", "Ǆa", "", "中文字符多"]

    def shape(w):
        if len(w) >= 100:
            return "LONG"
        w = "".join("X" if regex.match(r"\p{Lu}", c) else "x" if regex.match(r"\p{L}", c) else "d" if regex.match(r"\p{Nd}", c) else c for c in w)
        return regex.sub(r"(?s)(.)\1{4,}", lambda m: m[1] * 4, w)

    rows = spark.createDataFrame([(w,) for w in words], "w string")
    assert {r.w: r.s for r in rows.select("w", features.word_shape(rows["w"]).alias("s")).collect()} == {w: shape(w) for w in words}
