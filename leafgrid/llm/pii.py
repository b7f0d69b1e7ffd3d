"""Personal data with offset-preserving deobfuscation.

Base patterns run on the text as it is.  Every text also goes through two transducers: one maps
homoglyphs to ASCII character by character, one rewrites spelled digits and at/dot disguises.  Every
output character remembers the source span it came from, so identifiers found in the normalised text
map back to source offsets.  They are added unless a base span of their kind holds them; a disguised
address must end as an address does.

Scale: one pass over whole texts, no shuffle.  Scans are linear in the text: an e-mail's local part
is looked for only before an ``@``.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .kernel import chunks

KINDS = ("email", "ip", "card", "phone")
# The base patterns.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
# Look-alike letters and digits, and their ASCII forms.
_LOOKALIKE = str.maketrans(
    "АВЕКМНОРСТХЈаеорсухіѕјԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧονⅠⅼօ＠．＋－０１２３４５６７８９٠١٢٣٤٥٦٧٨٩",
    "ABEKMHOPCTXJaeopcyxisjdqwABEZHIKMNOPTYXovIlo@.+-01234567890123456789",
) | {i: c for i in (*range(0x2460, 0x2500), *range(0x1D400, 0x1D800), *range(0xFF21, 0xFF5B)) if (c := unicodedata.normalize("NFKC", chr(i))).isascii() and c.isalnum() and len(c) == 1}
# Ranges that hold all of them: a class of few ranges is searched much faster than one of many characters.
_STRANGE = re.compile("[\u0391-\u0669\u2160-\u24ff\uff0b-\uff5a\U0001d400-\U0001d7ff]")
_NAMES = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
# Letters that the patterns take for i and s when they ignore case.
_FOLD = {0x130: "i", 0x131: "i", 0x17F: "s"}
_SPELLED = rf"\b(?:{'|'.join(_NAMES)})\b"
_TOKENS = rf"{_SPELLED}(?:[\x20,-]+(?:{_SPELLED}|[0-9]+))"
_OPEN, _CLOSE = r"[\[({<]\s*", r"\s*[\])}>]"
_DOT = rf"(?:(?<!\s)\s*+{_OPEN}(?:dot|punkt|point|punto|\.){_CLOSE}\s*|(?<=\w)\x20+-?dot-?\x20+(?=\w)|(?<=[^\W_])[-_]dot[-_](?=\w))"
# A dot that comes later in the domain of a disguised address.
_LATER = rf"(?:\x20+-?dot-?\x20+|\s*{_OPEN}(?:dot|\.)|[-_]dot[-_])"
_SIGNS = {
    "at": rf"(?P<at>(?<!\s)\s*+{_OPEN}(?:at|@){_CLOSE}\s*|(?<=\w)\x20+-?at-?\x20+(?=[\w-]{{1,63}}?{_LATER})|(?<=[^\W_])[-_]at[-_](?=[\w-]{{1,63}}?(?:{_LATER}|\.[a-z])))",
    "dot": rf"(?P<dot>{_DOT})",
    "run": rf"(?P<run>(?:\bplus\x20(?:[0-9]{{1,15}}[\x20,-]{{1,3}}){{0,15}}(?={_SPELLED}))?{_TOKENS}{{3,}}|{_TOKENS}{{0,2}}(?={_DOT}))",
    "lone": rf"(?P<lone>(?<=[0-9][\x20-]){_SPELLED}(?=[\x20-][0-9]))",
    # Digits with letters that look like digits among them.
    "odd": r"(?P<odd>(?<![^\W_])(?-i:[0-9OolI]*[0-9][OolI][0-9OolI]*|[OolI]+[0-9][0-9OolI]*)(?![^\W_]))",
}
# What a lower-case text must hold for a sign to be in it: without, the sign is not looked for.
_NAMED = "|".join(_NAMES)
_BRACKETED = re.compile(r"[\[({<]\s*(?:at|@|dot|punkt|point|punto|\.)")
_JOINED = re.compile(r"[-_]at[-_]")
_TWO_NAMES = re.compile(rf"(?:{_NAMED})[\x20,-]+(?:{_NAMED}|[0-9])")
_LONE = re.compile(rf"[0-9][\x20-](?:{_NAMED})[\x20-][0-9]")
_ODD = re.compile(r"[0-9][oli]|[oli][0-9]")


@lru_cache(None)
def _sign(*names: str) -> re.Pattern[str]:
    return re.compile("(?i)" + "|".join(_SIGNS[n] for n in names))


def signs(plain: str) -> re.Pattern[str] | None:
    """A pattern for the kinds of signs that the text can hold."""
    low = (plain.translate(_FOLD) if any(chr(c) in plain for c in _FOLD) else plain).lower()
    some = "dot" in low or _BRACKETED.search(low) or _JOINED.search(low)
    names = (["at", "dot"] if some else []) + (["run"] if some or _TWO_NAMES.search(low) else [])
    names += (["lone"] if _LONE.search(low) else []) + (["odd"] if _ODD.search(low) else [])
    return _sign(*names) if names else None


_DIGITS = str.maketrans("OolI", "0011")
_ENDING = re.compile(r"\.[A-Za-z]{2,}$")
# A short run of names after a dot disguise.
_AFTER_DOT = re.compile(rf"(?i){_TOKENS}{{0,2}}")
_PART = re.compile(rf"(?i)(?P<plus>\bplus\b)|(?P<name>{_SPELLED})|(?P<raw>[0-9])|(?P<gap>[\x20,-]+)")

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def find(text: str) -> dict[str, list[Span]]:
    """Leftmost non-overlapping matches of each kind; matches that fail their test are dropped."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    done, at = 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in _LOCAL:
            lo -= 1
        if lo < at and (m := _DOMAIN.match(text, at)):
            out["email"].append((lo, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        for m in _DOTTED.finditer(text) if "." in text else ():
            parts, lo = m.group().split("."), m.start()
            for i in range(0, len(parts) - 3, 4):
                hi = lo + sum(map(len, parts[i : i + 4])) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in parts[i : i + 4]):
                    out["ip"].append((lo, hi))
                lo = hi + 1
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                    out["phone"].append(m.span())
    return out


def normalise(text: str) -> tuple[str, list[Span], list[bool]] | None:
    """The deobfuscated text, the source span of each of its characters and whether it was rewritten.

    None if nothing was rewritten.
    """
    plain = text.translate(_LOOKALIKE) if _STRANGE.search(text) else text
    sign = signs(plain)
    if plain is text and not (sign and sign.search(text)):
        return None
    out: list[str] = []
    spans: list[Span] = []
    new: list[bool] = []

    def copy(lo: int, hi: int) -> None:
        out.append(plain[lo:hi])
        spans.extend((i, i + 1) for i in range(lo, hi))
        new.extend(plain[i] != text[i] for i in range(lo, hi))

    def put(c: str, lo: int, hi: int) -> None:
        out.append(c)
        spans.append((lo, hi))
        new.append(True)

    at, dotted = 0, False
    while sign:
        m = sign.search(plain, at)
        if dotted and not (m and m.start() == at):
            m = _AFTER_DOT.match(plain, at) or m
        if not m:
            break
        copy(at, m.start())
        at = m.end()
        kind = m.lastgroup
        dotted = kind == "dot"
        if kind in ("at", "dot"):
            put("@" if kind == "at" else ".", *m.span())
            continue
        if kind == "lone":
            put(_NAMES[m.group().translate(_FOLD).lower()], *m.span())
            continue
        if kind == "odd":
            for i in range(*m.span()):
                if plain[i] in "OolI":
                    put(plain[i].translate(_DIGITS), i, i + 1)
                else:
                    copy(i, i + 1)
            continue
        for p in _PART.finditer(plain, *m.span()):
            if p.lastgroup == "plus":
                put("+", *p.span())
            elif p.lastgroup == "name":
                put(_NAMES[p.group().translate(_FOLD).lower()], *p.span())
            elif p.lastgroup == "raw":
                copy(*p.span())
    copy(at, len(plain))
    return ("".join(out), spans, new) if any(new) else None


def disguised(text: str) -> dict[str, list[Span]]:
    """Source spans of identifiers that only the normalised text shows."""
    found = normalise(text)
    if found is None:
        return {}
    plain, spans, new = found
    rewritten = [0]
    for n in new:
        rewritten.append(rewritten[-1] + n)
    ends = lambda k, a, b: k != "email" or _ENDING.search(plain, a, b)
    return {k: [(spans[a][0], spans[b - 1][1]) for a, b in hits if rewritten[b] > rewritten[a] and ends(k, a, b)] for k, hits in find(plain).items()}


def scan(raw: bytes) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans) by kind and start, in code points."""
    base: dict[str, list[Span]] = dict.fromkeys(KINDS, [])
    text = raw.decode("utf-8", "replace")
    if b"@" in raw or len(raw.translate(None, b"0123456789")) + 4 <= len(raw):
        base = find(text)
    more = disguised(text)
    plain = [(k, a, b) for k in KINDS for a, b in base[k]]
    every = []
    for k in KINDS:
        own = base[k]
        every += [(k, a, b) for a, b in sorted(own + [(a, b) for a, b in more.get(k, ()) if not any(x <= a and b <= y for x, y in own)])]
    return plain, every


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())]))
_NONE = hashlib.sha256(b"").hexdigest()


def find_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of docs, pii (all spans), pii_base (base spans) and pii_sha256 (of the base spans).

    Offsets are code points, end exclusive.  Null and empty texts have no spans; repeated rows are
    scanned alike; columns of docs with these names are replaced.
    """
    names = ["pii", "pii_base", "pii_sha256"]
    docs = docs.drop(*names)
    schema = StructType([*docs.schema.fields, StructField("pii", SPANS), StructField("pii_base", SPANS), StructField("pii_sha256", StringType())])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_rows = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
        for batch in batches:
            for c in chunks(batch.column(batch.schema.get_field_index(text_col))):
                found = [scan(c.text(i)) for i in range(len(c))]
                sha = [hashlib.sha256(joined(base).encode()).hexdigest() if base else _NONE for base, _ in found]
                yield pa.RecordBatch.from_arrays([*batch.slice(c.lo, len(c)).columns, pa.array([as_rows(e) for _, e in found], kind), pa.array([as_rows(b) for b, _ in found], kind), pa.array(sha)], [*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)
