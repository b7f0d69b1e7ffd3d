import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from leafgrid.llm import exact_dedup, jaccard_join, kernel, packets, substring_dedup
from leafgrid.llm.components import components

WORD = re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def exact(rows):
    groups = defaultdict(list)
    for r in rows:
        groups["".join(WORD.findall(r[1] or ""))].append(r)
    out = []
    for text, members in groups.items():
        best = min(members, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        out += [(r[0], best[0], len(members), hashlib.sha256(text.encode()).hexdigest()) for r in members]
    return Counter(out)


def test_exact_dedup(odd, rows):
    found = exact_dedup.exact_dedup(odd).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == exact(rows)
    kept = Counter(r.text_sha256 for r in found if r.kept)
    assert set(kept.values()) == {1} and set(kept) == {r.text_sha256 for r in found}
    assert all(r.doc_id == r.keep_id for r in found if r.kept)
    out = exact_dedup.drop_copies(odd)
    assert out.columns == odd.columns and out.count() == len(kept)


def test_exact_dedup_long_texts_that_part_late(spark):
    base = "abc " * 20000
    texts = [base + "x", base + "y", base + "x", base, base + "xz", "abc" * 20000]
    found = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert found == {0: (0, 2), 1: (1, 1), 2: (0, 2), 3: (3, 2), 4: (4, 1), 5: (3, 2)}


def cut(rows, n=35):
    words = [WORD.findall(r[1] or "") for r in rows]
    seen = Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    out = []
    for r, w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                gone[i : i + n] = [True] * n
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((r[0], len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def test_substring_dedup(odd, rows):
    found = Counter(tuple(r) for r in substring_dedup.repeated_windows(odd).collect())
    assert found == cut(rows)


def test_substring_dedup_short_windows(odd, rows):
    found = Counter(tuple(r) for r in substring_dedup.repeated_windows(odd, window=5).collect())
    assert found == cut(rows, 5)


def test_cover_reaches_every_shift():
    p, cover = substring_dedup.PERIOD, set(substring_dedup.COVER)
    for i in range(p):
        for j in range(p):
            assert any((i + d) % p in cover and (j + d) % p in cover for d in range(p))


def linked(rows):
    sets = []
    for r in rows:
        w = WORD.findall((r[1] or "").translate(LOW))
        sets.append({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 85 * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    low = defaultdict(list)
    for i, r in enumerate(rows):
        low[find(i)].append(r[0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in low.items()}
    return Counter((r[0], len(sets[i]), least[find(i)]) for i, r in enumerate(rows))


def test_checks_tell_windows_and_rows_apart():
    """Entries of one key and two checks are not repeated; numbers with checks survive packing."""
    key = np.array([7, 7, 7, 9, 9], np.uint64)
    number = np.array([1 << 32 | 5, 2 << 32 | 6, 1 << 32 | 8, 3 << 32 | 1, 4 << 32 | 1], np.int64)
    packer = packets.Packer(1)
    list(packer.add(key, np.arange(5), number))
    rows = [r for b in packer.flush() for r in b.to_pylist()]
    told = [packets.load(r["payload"]) for r in rows if r["kind"] == packets.SURE]
    assert [(d.tolist(), n.tolist()) for d, n, _ in told] == [([0, 2], [1 << 32 | 5, 1 << 32 | 8])]
    sent = [packets.load(r["payload"]) for r in rows if r["kind"] == packets.KEYS]
    assert sorted(zip(*(x.tolist() for x in sent[0]), strict=True)) == sorted(zip(range(5), number.tolist(), key.tolist(), strict=True))
    words = next(iter(kernel.chunks(pa.array(["one two three one two four", "one two three"])))).words()
    checks = substring_dedup._checks(words, 2)
    assert checks[0] == checks[3] == checks[6] and checks[1] == checks[7] != checks[4]


def test_jaccard_join(odd, rows):
    found = jaccard_join.jaccard_join(odd).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == linked(rows)
    out = jaccard_join.drop_near_copies(odd)
    assert out.columns == odd.columns
    assert out.filter(out.text.rlike(r"[^\x20\x09-\x0D]")).count() == len({r.component_id for r in found if r.n_shingles})


def test_jaccard_join_frequent_groups(spark):
    """Large groups of near copies, a passage that many share, and chains of links."""
    rng = np.random.default_rng(3)
    word = lambda: "w" + str(rng.integers(1 << 40))
    passage = [word() for _ in range(60)]
    texts = []
    base = [word() for _ in range(150)]
    for _ in range(60):
        t = list(base)
        for i in rng.integers(0, 150, 2):
            t[i] = word()
        texts.append(t)
    chain = [word() for _ in range(200)]
    for _ in range(30):
        chain = chain[:]
        for i in rng.integers(0, 200, 4):
            chain[i] = word()
        texts.append(chain)
    texts += [[word() for _ in range(int(rng.integers(1, 120)))] + passage for _ in range(60)]
    texts += [[word() for _ in range(n)] for n in range(1, 40)]
    short = [word() for _ in range(30)]
    texts += [[*short[:k], *short[k + 1 :]] for k in (0, 29)] + [short] * 3
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    found = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == linked(rows)


@pytest.mark.parametrize("fillers", [400, 20])
def test_jaccard_join_candidates_of_one_template(spark, monkeypatch, fillers):
    """Unlinked documents of one template: listed pairs follow the documents, and none is left to verify."""
    listed = {}
    plain = jaccard_join.materialise

    def counted(df, tag):
        out = plain(df, tag)
        if tag in ("singles", "combinations", "pairs", "rest"):
            listed[tag] = listed.get(tag, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard_join, "materialise", counted)
    per = []
    for n in (2000, 4000):
        rng = random.Random(9)
        texts = []
        for _ in range(n):
            words = [f"w{i}" for i in range(150)]
            for p in rng.sample(range(150), 7):
                words[p] = f"f{rng.randrange(fillers)}"
            texts.append(" ".join(words))
        listed.clear()
        found = jaccard_join.jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()
        assert all(r.component_id == r.doc_id for r in found) and len(found) == n
        assert listed["pairs"] == listed["rest"] == 0
        per.append((listed["singles"] + listed["combinations"]) / n)
    assert max(per) < 100


def test_jaccard_join_passages_and_split_groups(spark):
    """A passage in the middle of many texts, texts mixed of common passages, and a large group whose members link only to neighbours."""
    rng = np.random.default_rng(8)
    word = lambda: "w" + str(rng.integers(1 << 40))
    fresh = lambda n: [word() for _ in range(n)]
    passages = [fresh(40) for _ in range(5)]
    texts = [[*fresh(30), *passages[0], *passages[1], *fresh(int(rng.integers(5, 60)))] for _ in range(80)]
    texts += [[w for j in rng.permutation(5)[:3] for w in passages[j]] for _ in range(80)]
    base = fresh(100)
    for step in range(50):  # neighbours share 96 words, the first and the last nearly none
        texts.append(base[2 * step :] + [f"s{i}" for i in range(2 * step)])
    for _ in range(40):  # copies that a tenth of the words tells apart from the base, so few link to each other
        t = list(base)
        for i in rng.choice(100, 3, replace=False):
            t[i] = word()
        texts.append(t)
    rows = [(i, " ".join(texts[j])) for i, j in enumerate(rng.permutation(len(texts)))]
    found = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == linked(rows)


def test_near_copies_keep_unrelated_rows_of_null_and_repeated_ids(spark):
    one, two, three, four = (" ".join(f"{c}{i}" for i in range(40)) for c in "abcd")
    rows = [(None, one), (None, two), (None, one + " more"), (7, three), (7, four), (8, ""), (8, ""), (None, None), (None, None), (9, " \n")]
    out = jaccard_join.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = Counter((r.doc_id, r.text) for r in out)
    assert texts[None, one] + texts[None, one + " more"] == 1
    assert len(out) == len(rows) - 1 and all(texts[r] == rows.count(r) for r in rows[1:2] + rows[3:])


def test_combinations_are_complete():
    """Any two sets that can be linked share a combination of a size both use."""
    rng = np.random.default_rng(5)

    def combos(s):
        s = np.sort(s)
        d = 15 * len(s) // 85
        return {(k, *s[i : i + k]) for k in jaccard_join.combination_sizes(len(s)) for i in range(len(s[: k * (d + 1)]) - k + 1)}

    for _ in range(3000):
        n = int(rng.integers(6, 90))
        tokens = rng.permutation(n + 40)
        common, spare = tokens[:n], tokens[n:]
        most = n * 15 // 85
        a = int(rng.integers(0, most + 1))
        x, y = np.concatenate([common, spare[:a]]), np.concatenate([common, spare[a : most]])
        assert 100 * n >= 85 * (len(x) + len(y) - n)
        if len(x) > 5 and len(y) > 5 and set(x) != set(y):
            assert combos(x) & combos(y), (n, a, most)


def test_combinations_are_complete_below_85():
    rng = np.random.default_rng(6)

    def combos(s, percent):
        s = np.sort(s)
        d = (100 - percent) * len(s) // percent
        return {(k, *s[i : i + k]) for k in jaccard_join.combination_sizes(len(s), percent) for i in range(len(s[: k * (d + 1)]) - k + 1)}

    for percent in (60, 75, 80, 85, 90, 100):
        for n in (*range(1, 45), 200):
            most = n * (100 - percent) // percent
            for _ in range(30):
                a = int(rng.integers(0, most + 1))
                tokens = rng.permutation(n + most)
                x, y = np.concatenate([tokens[:n], tokens[n : n + a]]), np.concatenate([tokens[:n], tokens[n + a :]])
                assert most == 0 or combos(x, percent) & combos(y, percent), (percent, n, a, most)


def test_near_copies_at_80(spark):
    """Copies with a fifth appended, frequent enough for combinations, and small sets."""
    texts = [" ".join(f"a{i}" for i in range(104)) + "".join(f" n{k}x{i}" for i in range(20)) * (k > 0) for k in range(12)]
    texts += [" ".join(f"s{i}" for i in range(8)) + f" t{k}" * (k > 0) for k in range(12)] + ["other words that are linked with nothing at all"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in jaccard_join.drop_near_copies(docs, k=5, percent=80).collect()) == [0, 12, 24]


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 201)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 200: 200, 201: 200}


def test_empty(none):
    assert exact_dedup.exact_dedup(none).count() == 0
    assert substring_dedup.repeated_windows(none).count() == 0
    assert jaccard_join.jaccard_join(none).count() == 0
    assert jaccard_join.drop_near_copies(none).count() == 0
    assert exact_dedup.drop_copies(none).count() == 0
