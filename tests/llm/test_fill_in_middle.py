import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from leafgrid.llm.fill_in_middle import build_table, fill_in_middle

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def plain(doc_id, text):
    """The contract by Python's own regex and slices."""
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_against_regex(spark, odd, rows):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "<", "P", "S", "M", ">", " ", "\n", "é", "🙂", "<M>", " \t", "\v"]) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    texts += ["é <P " * 400_000, "<" * 2000, " " * 1_500_000, "<P", "> <S >"]
    own = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for table, want in ((own, list(enumerate(texts))), (odd, [(r[0], r[1]) for r in rows])):
        expected = [plain(*r) for r in want]
        assert Counter(map(tuple, fill_in_middle(table).collect())) == Counter(expected)
        digests = [(*r[:5], sha(r[5]), sha(t or "")) for r, (_, t) in zip(expected, want, strict=True)]
        assert Counter(map(tuple, fill_in_middle(table, check=True).collect())) == Counter(digests)


def test_empty_table_and_rates(spark, none, corpus):
    assert fill_in_middle(none).collect() == []
    forms = Counter(r.form for r in fill_in_middle(corpus, rate=100, spm=0).select("form").collect())
    assert forms["psm"] > 150 and not forms["spm"]


def test_table_forgets_after_two_bytes():
    follow, emit = build_table()
    assert follow.shape == emit.shape == (4, 256) and not np.any(emit[:, 0x80:0xC0] & 1)
    with pytest.raises(ValueError):
        build_table((b"<PP>", b"<S>", b"<M>"))
