"""ASCII forms of words, in the JVM.

Single letters come from a rule: a character whose compatibility decomposition, without marks, is one
ASCII character takes that.  Other scripts and letters that become several have tables.  Of the
sources of several characters the longest that begins at a place counts, from the left.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that become several, or that have no decomposition, and the Greek and Cyrillic alphabets.
TABLE = {
    "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ł": "l", "ħ": "h", "ı": "i", "ŋ": "ng", "ĸ": "q",
    "α": "a", "β": "v", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "i", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m",
    "ν": "n", "ξ": "x", "ο": "o", "π": "p", "ρ": "r", "σ": "s", "ς": "s", "τ": "t", "υ": "y", "φ": "f", "χ": "ch", "ψ": "ps", "ω": "o",
    "ου": "ou", "αυ": "av", "ευ": "ev", "ού": "ou", "αύ": "av", "εύ": "ev", "γγ": "ng", "γκ": "gk", "μπ": "b", "ντ": "nt", "γξ": "nx", "γχ": "nch",
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i", "к": "k", "л": "l", "м": "m",
    "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh",
    "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya", "і": "i", "є": "ye", "ґ": "g", "ћ": "c", "ђ": "dj", "љ": "lj", "њ": "nj", "џ": "dz",
    "‘": "'", "’": "'", "“": '"', "”": '"', "„": '"', "–": "-", "—": "-", "…": "...", "€": "EUR", "№": "No", "«": "<<", "»": ">>", "°": "deg", "×": "x", "·": ".", "•": "*",
}


@lru_cache(1)
def tables() -> tuple[dict[str, str], dict[str, str]]:
    """(single characters to at most one, all others) with capitals by rule."""
    one: dict[str, str] = {}
    many: dict[str, str] = {}
    for i in (*range(0x80, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F190)):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(i)) if not unicodedata.combining(c))
        if plain != chr(i) and plain.isascii():
            (one if len(plain) < 2 else many)[chr(i)] = plain
        elif len(plain) == 1 and plain != chr(i) and plain in TABLE:  # a Greek or Cyrillic letter with a mark
            (one if len(TABLE[plain]) < 2 else many)[chr(i)] = TABLE[plain]
        elif len(plain) == 1 and plain != chr(i) and plain.lower() in TABLE and len(plain.lower()) == 1:
            (one if len(TABLE[plain.lower()]) < 2 else many)[chr(i)] = TABLE[plain.lower()].capitalize()
    for source, to in TABLE.items():
        for s, t in {source: to, source.capitalize(): to.capitalize(), source.upper(): to.upper() if len(source) > 1 else to.capitalize()}.items():
            if s not in one and (s == source or len(s) == len(source)):
                (one if len(s) == 1 and len(t) < 2 else many)[s] = t
    return one, many


def single() -> tuple[str, str]:
    """The single characters and what they become; those that go stand at the end."""
    one, _ = tables()
    kept = [c for c in one if one[c]]
    return "".join(kept) + "".join(c for c in one if not one[c]), "".join(one[c] for c in kept)


def ascii_fold(word: Column, missing: str | None = None) -> Column:
    """ASCII form of a word without outer blanks; characters that no table has stay, or become missing.

    Null stays null.  Words of ASCII alone pass untouched.
    """
    _, many = tables()
    sources = sorted(many, key=lambda s: (-len(s), s))
    escape = lambda s: "".join("\\" + c if c.isascii() and not c.isalnum() else c for c in s)
    first = "[" + "".join(sorted({escape(s[0]) for s in sources})) + "]"
    pattern = "(?s)" + "|".join(map(escape, sources)) + "|."
    table = F.from_json(F.lit(_json(many)), "map<string,string>")
    parts = F.transform(F.regexp_extract_all(word, F.lit(pattern), F.lit(0)), lambda x: F.coalesce(F.when(F.octet_length(x) > 1, F.element_at(table, x)), x))
    joined = F.when(word.rlike(first), F.array_join(parts, "")).otherwise(word)
    folded = F.translate(joined, *single())
    if missing is not None:
        folded = F.regexp_replace(folded, r"[^\x00-\x7F]", missing)
    return F.trim(F.when(F.octet_length(word) == F.length(word), word).otherwise(folded))


#: Latin letters and the usual marks, as ranges of characters; all but U+0001.
LATIN = (("\x00", "\x00"), ("\x02", "\u017f"), ("\u2010", "\u2027"), ("€", "€"))


def latin_spelled(text: Column) -> Column:
    """A text of LATIN characters with those that become several replaced; single() tells the rest of their ASCII forms."""
    for c, to in tables()[1].items():
        if len(c) == 1 and any(lo <= c <= hi for lo, hi in LATIN):
            text = F.replace(text, F.lit(c), F.lit(to))
    return text


def _json(table: dict[str, str]) -> str:
    import json

    return json.dumps(table, ensure_ascii=False)
