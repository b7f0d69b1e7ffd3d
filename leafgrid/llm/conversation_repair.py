"""Repair of conversations by error-correcting Earley parsing.

A weighted grammar says in which order roles may speak.  Its productions are joined by three of
error: a turn is deleted, a turn takes another role, an empty turn is inserted.  The chart has a
column behind each turn; an item is a production with its dot, and of equal items the one of least
(cost, audit) stays, the audit being the initials of the edits so far.  The completed chart's best item yields the repair.

The grammar is left-linear (a head is a prefix and one role), so every item began with the
conversation and a column holds one completed item for each nonterminal.  That bounds a column by
the grammar, makes parsing linear, and lets a long conversation be parsed in segments: a segment's
chart is filled once from each nonterminal it can begin with, and keeps the cost of each way through.
Segments end with a turn, so insertions stand in front of the turn that needs them; then no audit of
a segment begins another of the same segment, and the least whole audit is that of least segments.

Scale: equal turns are counted first, with map-side combine.  Turns are dealt by ranges of
(conversation, turn, role, text), so a conversation of any size is spread over tasks, each of which
reads its turns as they come and holds a segment at a time.  Conversations that lie within one
segment are settled there.  Of the others one small row for each segment meets in one task, about
as many numbers as the square of the nonterminals for SEGMENT turns; their segments are then filled
again side by side, along the ways chosen.  Only the digest of a repaired conversation is made in
one task for each, turn by turn, since the hash of a text has no other way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from .packets import partitions
from .storage import materialise

SEGMENT, SEGMENT_CHARS = 1024, 4 << 20
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
_DONE = r"[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*\z"
_SEGMENT = (
    "part int, no int, whole boolean, blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns bigint, first bigint, last bigint, lead string, tail string, "
    "arcs array<struct<entry:int,exit:int,cost:bigint,rank:int>>, roles array<string>, texts array<string>, faults array<int>, copies array<bigint>, entry int, exit int, cost bigint"
)
_NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
Best = tuple[int, str]


@dataclass(frozen=True)
class Grammar:
    """Productions (head, prefix, initial of the role that ends the head); the prefix "" is the start.

    accept: the heads that a conversation may end with.  spare: roles that turns may be given and
    that may be inserted.  Adjacent initials outside follow are illegal.
    """

    productions: tuple[tuple[str, str, str], ...] = (("lead", "", "s"), ("asked", "", "u"), ("asked", "lead", "u"), ("asked", "answered", "u"), ("answered", "asked", "a"))
    accept: tuple[str, ...] = ("", "answered")
    spare: tuple[str, ...] = ("user", "assistant")
    rerole: int = 2
    delete: int = 3
    insert: int = 2
    cut: int = 1
    heads: tuple[str, ...] = field(init=False)
    follow: frozenset[str] = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "heads", ("", *dict.fromkeys(h for h, _, _ in self.productions)))
        ends = {}
        for head, _, t in self.productions:
            ends.setdefault(head, set()).add(t)
        object.__setattr__(self, "follow", frozenset(e + t for _, prefix, t in self.productions for e in ends.get(prefix, ())))
        given = {r[:1] for r in self.spare}
        free = [p for _, p, t in self.productions if t in given]
        if len(free) != len(set(free)) or len({(p, t) for _, p, t in self.productions}) != len(self.productions):
            raise ValueError("an edit must have one outcome: one head for a prefix and a role, one spare role for a prefix")

    def spares(self) -> dict[str, tuple[str, str]]:
        """prefix: (head, role) of the production that a spare role completes."""
        names = {r[:1]: r for r in self.spare}
        return {prefix: (head, names[t]) for head, prefix, t in self.productions if t in names}


class Chart:
    """Columns of completed items: head to its least (cost, audit)."""

    def __init__(self, grammar: Grammar):
        self.g = grammar
        self.spares = grammar.spares()

    def inserted(self, column: dict[str, Best]) -> dict[str, Best]:
        """The column with the items that insertions complete."""
        out, todo = dict(column), list(column)
        while todo:
            prefix = todo.pop()
            if prefix in self.spares:
                head, (cost, audit) = self.spares[prefix][0], out[prefix]
                new = (cost + self.g.insert, audit + "I")
                if head not in out or new < out[head]:
                    out[head] = new
                    todo.append(head)
        return out

    def behind(self, column: dict[str, Best], initial: str, fault: int) -> dict[str, Best]:
        """The column behind a turn."""
        out = {head: (cost + self.g.delete, audit + "D") for head, (cost, audit) in column.items()}
        if fault in (BLANK, DUPLICATE):
            return out
        extra = self.g.cut if fault == TRUNCATED else 0
        before = self.inserted(column)
        for head, prefix, t in self.g.productions:
            if prefix in before:
                cost, audit = before[prefix]
                if t == initial:
                    new = (cost + extra, audit + "K")
                elif prefix in self.spares and self.spares[prefix][0] == head:
                    new = (cost + extra + self.g.rerole, audit + "R")
                else:
                    continue
                if head not in out or new < out[head]:
                    out[head] = new
        return out

    def fill(self, entry: str, turns: Iterable[tuple[str, int, int]]) -> dict[str, Best]:
        """The last column for turns (initial, fault, copies) behind entry; all copies but the first must go."""
        column: dict[str, Best] = {entry: (0, "")}
        for initial, fault, copies in turns:
            column = self.behind(column, initial, fault)
            if copies > 1:
                column = {h: (cost + (copies - 1) * self.g.delete, audit + "D" * (copies - 1)) for h, (cost, audit) in column.items()}
        return column

    def ending(self, head: str) -> Best | None:
        """What a conversation that is at head still takes to be complete."""
        column = self.inserted({head: (0, "")})
        return min((column[h] for h in self.g.accept if h in column), default=None)

    def choose(self, arcs: list[dict[int, list[tuple[int, int, int]]]]) -> tuple[int, list[tuple[int, int]]]:
        """(cost, (entry, exit) of each segment) of the cheapest way, of equal ones that of least audit.

        arcs: for each segment the (exit, cost, rank of the audit) by entry, as numbers of heads.
        """
        left = {i: end[0] for i, h in enumerate(self.g.heads) if (end := self.ending(h))}
        rest = [left]
        for ways in reversed(arcs):
            left = {e: min(c + left[x] for x, c, _ in out if x in left) for e, out in ways.items() if any(x in left for x, _, _ in out)}
            rest.append(left)
        rest.reverse()
        at, chosen = 0, []
        for ways, here, then in zip(arcs, rest, rest[1:], strict=False):
            _, to = min((rank, x) for x, c, rank in ways[at] if x in then and c + then[x] == here[at])
            chosen.append((at, to))
            at = to
        return rest[0][0], chosen


def _arcs(chart: Chart, turns: list[tuple[str, int, int]], entries: Iterable[int]) -> list[dict]:
    heads, out = chart.g.heads, []
    for e in entries:
        column = chart.fill(heads[e], turns)
        for rank, (_, head) in enumerate(sorted((audit, h) for h, (_, audit) in column.items())):
            out.append({"entry": e, "exit": heads.index(head), "cost": column[head][0], "rank": rank})
    return out


def _by_entry(arcs: list[dict]) -> dict[int, list[tuple[int, int, int]]]:
    out: dict[int, list[tuple[int, int, int]]] = {}
    for a in arcs:
        out.setdefault(a["entry"], []).append((a["exit"], a["cost"], a["rank"]))
    return out


def _repaired(chart: Chart, row: dict) -> tuple[str, list[tuple[str, str]]]:
    """(audit, repaired turns) of a segment for which entry and exit are known; a null exit is the conversation's end."""
    turns = [(r[:1], f, n) for r, f, n in zip(row["roles"], row["faults"], row["copies"], strict=True)]
    at = chart.g.heads[row["entry"]]
    audit = chart.fill(at, turns)[chart.g.heads[row["exit"]]][1] + (chart.ending(chart.g.heads[row["exit"]])[1] if row["ends"] else "")
    whole = iter([x for r, t, n in zip(row["roles"], row["texts"], row["copies"], strict=True) for x in [(r, t)] * n])
    after = {(prefix, t): head for head, prefix, t in chart.g.productions}
    out = []
    for edit in audit:
        if edit == "D":
            next(whole)
            continue
        role, text = ("", "") if edit == "I" else next(whole)
        if edit == "K":
            at = after[at, role[:1]]
        else:
            at, role = chart.spares[at]
        out.append((role, text))
    return audit, out


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: turns damaged by a hash of their conversation and number.

    Of 20 hashes one drops the turn (copies 0), one empties its text, one removes its full stops and
    question and exclamation marks, one repeats it, one gives it to the user.  Nulls count as one
    blank, in the hash, the role and the text.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(blank("role"))
    copies = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).cast("long")
    return conversations.withColumn("kind", kind).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def _faults(turns: DataFrame) -> DataFrame:
    """Each distinct (conv_id, turn, role, text) with its copies and first fault; rows that none is left of only name their conversation."""
    there = F.col("copies") > 0
    rows = turns.select("conv_id", *[F.when(there, F.col(c)).alias(c) for c in ("turn", "role", "text")], "copies").groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    rows = rows.withColumn("same", F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text"), 256)).withColumn("at", F.struct(F.col("turn").isNotNull(), "turn"))
    firsts = rows.filter("same IS NOT NULL").groupBy("conv_id", "same").agg(F.min("at").alias("earliest")).withColumnsRenamed({"conv_id": "c", "same": "s"})
    rows = rows.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("same") == F.col("s")), "left")
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK).when(F.col("at") != F.col("earliest"), DUPLICATE).when(F.col("text").rlike(_DONE), TRUNCATED).otherwise(SOUND)
    return rows.select("conv_id", "turn", "role", "text", "copies", fault.cast("int").alias("fault"))


class _Segment:
    """Turns of one conversation as they come, with what a neighbour segment needs to know."""

    def __init__(self, grammar: Grammar, conv: object, part: int, no: int):
        self.g = grammar
        self.row = {"conv_id": conv, "part": part, "no": no, "whole": False, "turns": 0, "first": None, "last": None, "lead": None, "tail": None, "illegal": 0, "roles": [], "texts": [], "faults": [], "copies": []}
        self.n = {BLANK: 0, DUPLICATE: 0, TRUNCATED: 0, SOUND: 0}
        self.chars = 0

    def add(self, turn: int | None, role: str, text: str, copies: int, fault: int) -> None:
        r, initial = self.row, role[:1]
        if turn is not None and turn != r["last"]:
            r["turns"] += 1
            r["first"] = turn if r["first"] is None else r["first"]
            r["last"] = turn
        if r["tail"] is not None:
            r["illegal"] += r["tail"] + initial not in self.g.follow
        r["illegal"] += (copies - 1) * (initial + initial not in self.g.follow)
        r["lead"], r["tail"] = initial if r["lead"] is None else r["lead"], initial
        self.n[fault] += 1
        self.n[BLANK if fault == BLANK else DUPLICATE] += copies - 1
        for k, v in (("roles", role), ("texts", text), ("faults", fault), ("copies", copies)):
            r[k].append(v)
        self.chars += len(text)

    def close(self, chart: Chart, first: bool, whole: bool) -> dict:
        """The segment's row: if it may be entered anywhere, with the ways from every head."""
        r = self.row | {"blank": self.n[BLANK], "duplicate": self.n[DUPLICATE], "truncated": self.n[TRUNCATED], "whole": whole}
        turns = [(role[:1], f, n) for role, f, n in zip(r["roles"], r["faults"], r["copies"], strict=True)]
        r["arcs"] = _arcs(chart, turns, (0,) if first else range(len(self.g.heads)))
        if whole:
            r["cost"], [(r["entry"], r["exit"])] = chart.choose([_by_entry(r["arcs"])])
            r["arcs"] = None
        return r


def _segments(grammar: Grammar, fields: list[pa.Field], size: int):
    """Segments, numbered in each task; one is whole if the task has turns of other conversations before and behind it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chart, part, now, no, out, schema = Chart(grammar), TaskContext.get().partitionId(), None, 0, [], None
        fresh = False  # whether the segment begins a conversation, which is not known of a task's first
        for batch in batches:
            schema = schema or pa.schema([batch.schema.field(0), *fields])
            for conv, turn, role, text, copies, fault in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                other = now is not None and now.row["conv_id"] != conv
                if other or now is not None and (len(now.row["roles"]) >= size or now.chars >= SEGMENT_CHARS):
                    out.append(now.close(chart, fresh, fresh and other))
                    fresh, no, now = other, no + 1, None
                    if len(out) >= 64:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out = []
                now = now or _Segment(grammar, conv, part, no)
                if copies:
                    now.add(turn, role, text, copies, fault)
        if now is not None:
            out.append(now.close(chart, fresh, False))
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _ways(grammar: Grammar):
    """For conversations of several segments, which come in order: each segment's entry and exit, and the whole's numbers."""

    def settle(chart: Chart, rows: list[dict]) -> Iterator[tuple]:
        cost, ways = chart.choose([_by_entry(r["arcs"]) for r in rows])
        total = {k: sum(r[k] for r in rows) for k in ("blank", "duplicate", "truncated", "illegal", "turns")}
        first = last = tail = None
        for r in rows:
            total["turns"] -= r["first"] is not None and r["first"] == last
            first, last = r["first"] if first is None else first, last if r["last"] is None else r["last"]
            if r["lead"] is not None:
                total["illegal"] += tail is not None and tail + r["lead"] not in grammar.follow
                tail = r["tail"]
        gaps = 0 if first is None else last - first + 1 - total["turns"]
        for i, (r, (entry, to)) in enumerate(zip(rows, ways, strict=True)):
            yield r["part"], r["no"], entry, to, i == len(rows) - 1, gaps, total["blank"], total["duplicate"], total["truncated"], total["illegal"], cost

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chart, held = Chart(grammar), []
        names = ["part", "no", "entry", "exit", "ends", *_NUMBERS]
        types = [pa.int32()] * 4 + [pa.bool_()] + [pa.int64()] * 6
        put = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*settle(chart, rows), strict=True), types, strict=True)], names)
        for batch in batches:
            for r in batch.to_pylist():
                if held and held[0]["conv_id"] != r["conv_id"]:
                    yield put(held)
                    held = []
                held.append(r)
        if held:
            yield put(held)

    return run


def _chosen(turns: DataFrame, grammar: Grammar, size: int) -> tuple[DataFrame, StructField]:
    """Segments with the way through each and the numbers of their conversations."""
    conv = turns.schema["conv_id"]
    dealt = _faults(turns).repartitionByRange(partitions(turns), "conv_id", "turn", "role", "text").sortWithinPartitions("conv_id", "turn", "role", "text")
    fields = StructType.fromDDL(_SEGMENT)
    segments = materialise(dealt.mapInArrow(_segments(grammar, list(to_arrow_schema(fields)), size), StructType([conv, *fields])), "segments")
    gaps = F.coalesce(F.col("last") - F.col("first") + 1 - F.col("turns"), F.lit(0).cast("long"))
    keep = ["conv_id", "part", "no", "whole", "roles", "texts", "faults", "copies"]
    settled = segments.filter("whole").select(*keep, "entry", "exit", F.lit(True).alias("ends"), gaps.alias("gaps"), *_NUMBERS[1:])
    parted = segments.filter("NOT whole")
    narrow = parted.select("conv_id", "part", "no", "blank", "duplicate", "truncated", "illegal", "turns", "first", "last", "lead", "tail", "arcs")
    ways = narrow.repartition("conv_id").sortWithinPartitions("conv_id", "part", "no").mapInArrow(_ways(grammar), "part int, no int, entry int, exit int, ends boolean, " + ", ".join(f"{n} bigint" for n in _NUMBERS))
    return settled.unionByName(parted.select(*keep).join(ways, ["part", "no"])), conv


def repaired_turns(turns: DataFrame, grammar: Grammar = Grammar(), segment: int = SEGMENT) -> DataFrame:
    """conv_id, part, no, place, role, text of the repaired conversations, ordered within each by (part, no, place)."""
    segments, conv = _chosen(turns, grammar, segment)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chart = Chart(grammar)
        for batch in batches:
            for r in batch.to_pylist():
                out = [{"conv_id": r["conv_id"], "part": r["part"], "no": r["no"], "place": i, "role": role, "text": text} for i, (role, text) in enumerate(_repaired(chart, r)[1])]
                yield pa.RecordBatch.from_pylist(out, pa.schema([batch.schema.field(0), ("part", pa.int32()), ("no", pa.int32()), ("place", pa.int32()), ("role", pa.string()), ("text", pa.string())]))

    return segments.mapInArrow(run, StructType([conv, *StructType.fromDDL("part int, no int, place int, role string, text string").fields]))


def repair_conversations(turns: DataFrame, grammar: Grammar = Grammar(), segment: int = SEGMENT) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for each conversation of turns(conv_id, turn, role, text, copies).

    Turns go by number, nulls first, then role and text.  A turn's first fault counts: blank, a
    duplicate of an earlier one, or truncated (it ends without a full stop, question or exclamation
    mark).  Blank and duplicate turns must be deleted; a truncated one that stays costs more.  Rows
    without copies only name their conversation, which may be empty.  Null ids are one conversation;
    a role without an initial fits nowhere as it is; equal rows are copies; an empty table gives no
    rows; other columns are ignored.  Roles and texts are not null (see ``damage``).
    """
    segments, conv = _chosen(turns.select("conv_id", "turn", "role", "text", "copies"), grammar, segment)
    numbers = pa.schema([(n, pa.int64()) for n in _NUMBERS])
    out = StructType([conv, *StructType.fromDDL(", ".join(f"{n} bigint" for n in _NUMBERS) + ", audit string, repaired_sha256 string").fields])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chart = Chart(grammar)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                audit, turns_ = _repaired(chart, r)
                text = "\n".join(f"{role}:{text}" for role, text in turns_)
                rows.append({k: r[k] for k in ("conv_id", *_NUMBERS)} | {"audit": audit, "repaired_sha256": hashlib.sha256(text.encode()).hexdigest()})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([batch.schema.field(0), *numbers, ("audit", pa.string()), ("repaired_sha256", pa.string())]))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chart = Chart(grammar)
        for batch in batches:
            for r in batch.to_pylist():
                audit, turns_ = _repaired(chart, r)
                text = "\n".join(f"{role}:{text}" for role, text in turns_) if turns_ else None
                yield pa.RecordBatch.from_pylist([{k: r[k] for k in ("conv_id", "part", "no", *_NUMBERS)} | {"audit": audit, "text": text}], pa.schema([batch.schema.field(0), ("part", pa.int32()), ("no", pa.int32()), *numbers, ("audit", pa.string()), ("text", pa.string())]))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, audits, digest, schema = None, [], None, None
        done = lambda: pa.RecordBatch.from_pylist([now | {"audit": "".join(audits), "repaired_sha256": digest[0].hexdigest()}], schema)
        for batch in batches:
            schema = pa.schema([batch.schema.field(0), *numbers, ("audit", pa.string()), ("repaired_sha256", pa.string())])
            for r in batch.to_pylist():
                if now is None or now["conv_id"] != r["conv_id"]:
                    if now is not None:
                        yield done()
                    now, audits, digest = {k: r[k] for k in ("conv_id", *_NUMBERS)}, [], [hashlib.sha256(), False]
                audits.append(r["audit"])
                if r["text"] is not None:
                    digest[0].update((("\n" if digest[1] else "") + r["text"]).encode())
                    digest[1] = True
        if now is not None:
            yield done()

    piece = StructType([conv, *StructType.fromDDL("part int, no int, " + ", ".join(f"{n} bigint" for n in _NUMBERS) + ", audit string, text string").fields])
    parted = segments.filter("NOT whole").mapInArrow(pieces, piece).repartition("conv_id").sortWithinPartitions("conv_id", "part", "no").mapInArrow(join, out)
    return segments.filter("whole").mapInArrow(digests, out).unionByName(parted)
