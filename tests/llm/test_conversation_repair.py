import hashlib
import itertools
import random
import re

import duckdb
import pytest

from leafgrid.llm.conversation_repair import Chart, Grammar, damage, repair_conversations, repaired_turns
from leafgrid.llm.oracles import ORACLES

LEGAL = re.compile("(s?(ua)+)?")
COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
SCHEMA = "conv_id long, turn long, role string, text string, audit string, part string"


def brute(turns):
    """Least (cost, audit, repaired text) over every sequence of edits with at most two insertions in a row."""
    gaps = [g for n in range(3) for g in itertools.product(("user", "assistant"), repeat=n)]
    seen, choices = set(), []
    for role, text in turns:
        fault = "gone" if not text.strip(" \t\n\v\f\r") or (role, text) in seen else "cut" if text.strip(" \t\n\v\f\r")[-1] not in ".!?" else ""
        seen.add((role, text))
        extra = fault == "cut"
        kept = [(extra, "K", [(role, text)])] + [(2 + extra, "R", [(r, text)]) for r in ("user", "assistant")]
        choices.append([(3, "D", [])] + (kept if fault != "gone" else []))
    inserted = [(2 * len(g), "I" * len(g), [(r, "") for r in g]) for g in gaps]
    best = None
    for way in itertools.product(inserted, *itertools.chain.from_iterable((c, inserted) for c in choices)):
        cost = sum(w[0] for w in way)
        if best is not None and cost > best[0]:
            continue
        rows = [x for w in way for x in w[2]]
        if LEGAL.fullmatch("".join(r[:1] for r, _ in rows)):
            new = (cost, "".join(w[1] for w in way), "\n".join(f"{r}:{t}" for r, t in rows))
            best = new if best is None else min(best, new)
    return best


def some_turns(rng, n):
    return [(rng.choice(["user", "assistant", "system", "user", "assistant", "tool"]), rng.choice(["Yes.", "No", " ", "Why?", "So it is. ", "And\n"])) for _ in range(n)]


def test_against_every_repair(spark):
    rng = random.Random(3)
    convs = {i: some_turns(rng, i % 4) for i in range(40)}
    rows = [(c, t, role, text, 1) for c, turns in convs.items() for t, (role, text) in enumerate(turns)]
    found = {r.conv_id: r for r in repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copies long")).collect()}
    for c, turns in convs.items():
        if turns:
            cost, audit, text = brute(turns)
            assert (found[c].cost, found[c].audit, found[c].repaired_sha256) == (cost, audit, hashlib.sha256(text.encode()).hexdigest())


@pytest.fixture(scope="module")
def odd_conversations():
    """Null ids, turns, roles and texts, equal turns, ties, gaps, and a conversation with a third of all rows."""
    rng = random.Random(5)
    rows = [(c, t + 3 * (t > 4), *x, "x", "y") for c in range(60) for t, x in enumerate(some_turns(rng, rng.randint(1, 9)))]
    rows += [(99, t // 2, *x, "x", "y") for t, x in enumerate(some_turns(rng, 150))]
    rows += [(100, t, "user" if t % 2 else "assistant", "Same.", "x", "y") for t in range(40)]
    rows += [(None, 1, "user", "Hi.", "x", "y"), (None, None, None, None, "x", "y"), (101, None, "user", "A.", "x", "y"), (101, None, "assistant", "B.", "x", "y"), (102, 5, "", "C.", "x", "y")]
    rows += [(103, 1, "user", "Twice.", "x", "y")] * 3 + [(103, 2, "assistant", "É🙂.", "x", "y"), (104, 1, "user", "x" * 3_000_000, "x", "y")]
    return rows


@pytest.mark.parametrize("segment", [1024, 3])
def test_odd_conversations_against_sql(spark, odd_conversations, segment):
    table = spark.createDataFrame(odd_conversations, SCHEMA).repartition(5)
    found = repair_conversations(damage(table), segment=segment).select(*COLUMNS).collect()
    con = duckdb.connect()
    con.register("conversations", table.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    want = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLES['op13_conversation_repair']})").fetchall()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))


def test_turns_are_legal(spark, odd_conversations):
    turns = repaired_turns(damage(spark.createDataFrame(odd_conversations, SCHEMA)), segment=4).collect()
    by = {}
    for r in sorted(turns, key=lambda r: (r.part, r.no, r.place)):
        by.setdefault(r.conv_id, []).append(r.role[:1])
    assert by and all(LEGAL.fullmatch("".join(x)) for x in by.values())


def test_empty_tables_and_dropped_conversations(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair_conversations(damage(none)).collect() == [] and repaired_turns(damage(none)).collect() == []
    gone = repair_conversations(spark.createDataFrame([(7, 1, "user", "x", 0)], "conv_id long, turn long, role string, text string, copies long")).collect()
    assert [tuple(r) for r in gone] == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_grammar_is_checked():
    with pytest.raises(ValueError):
        Grammar(productions=(("a", "", "u"), ("b", "", "u")))
    other = Grammar(productions=(("done", "", "t"), ("done", "done", "t")), accept=("done",), spare=("tool",))
    assert Chart(other).fill("", [("x", 0, 1)])["done"] == (2, "R")
