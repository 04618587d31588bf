"""Column functions on code points: normalisation, kana, classes of characters.

Everything counts Unicode code points. Nulls stay null.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

VOICED, SEMIVOICED = "゙", "゚"

#: White space as the search defines it.
SPACE = "[\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"
#: White space and sound marks, which a query may hold anywhere.
IGNORABLE = SPACE[:-1] + VOICED + SEMIVOICED + "]"
KANA = "[\\u3041-\\u309F\\u30A0-\\u30FF]"
JAPANESE = "[\\p{IsHan}\\u3041-\\u309F\\u30A0-\\u30FF\\u3005\\u3006\\u30FC\\u3099\\u309A]"


def _tables() -> tuple[str, str]:
    """Full-width ASCII and half-width kana with what they stand for (Unicode's compatibility forms)."""
    pairs = {chr(c): chr(c - 0xFEE0).lower() for c in range(0xFF01, 0xFF5F)} | {"　": " "}
    pairs |= {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0xFF61, 0xFF9E)}
    pairs |= {"ﾞ": VOICED, "゛": VOICED, "ﾟ": SEMIVOICED, "゜": SEMIVOICED}
    return "".join(pairs), "".join(pairs.values())


WIDE, PLAIN = _tables()
HIRAGANA = "".join(map(chr, [*range(0x3041, 0x3097), 0x309D, 0x309E]))
KATAKANA = "".join(chr(ord(c) + 0x60) for c in HIRAGANA)


def _composed(mark: str) -> dict[str, str]:
    pairs = {chr(c): unicodedata.normalize("NFC", chr(c) + mark) for c in range(0x3041, 0x3100)}
    return {a: b for a, b in pairs.items() if len(b) == 1 and a != b}


#: Base kana to voiced and semi-voiced kana.
COMPOSED = {VOICED: _composed(VOICED), SEMIVOICED: _composed(SEMIVOICED)}


def code_points(s: Column) -> Column:
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, ""))


def lower_each(s: Column) -> Column:
    """Lower case code point by code point: no final sigma, no context."""
    return F.array_join(F.transform(code_points(s), lambda c: F.lower(c)), "")


def normalize(s: Column) -> Column:
    """Lower case, full-width to plain, half-width kana to full, sound marks to combining ones."""
    return F.translate(lower_each(s), WIDE, PLAIN)


def to_katakana(s: Column) -> Column:
    return F.translate(s, HIRAGANA, KATAKANA)


def is_han(s: Column) -> Column:
    return s.rlike(r"^\p{IsHan}+$")


def is_maybe_japanese(s: Column) -> Column:
    return s.rlike(f"^{JAPANESE}+$")


def is_kana(s: Column) -> Column:
    return s.rlike(f"^{KANA}*$")


def is_sound_mark(s: Column) -> Column:
    return s.rlike(f"^[{VOICED}{SEMIVOICED}]+$")


def strip_sound_marks(s: Column) -> Column:
    return F.translate(s, VOICED + SEMIVOICED, "")


def is_space(s: Column) -> Column:
    return s.rlike(f"^{SPACE}$")


def strip_ignorable(s: Column) -> Column:
    return F.regexp_replace(s, IGNORABLE, "")


def span_length(span: Column) -> Column:
    return span["end"] - span["start"]


def compose_dakuten(s: Column) -> Column:
    """Base kana with a combining sound mark become one code point."""
    out = s
    for mark, pairs in COMPOSED.items():
        for base, one in pairs.items():
            out = F.replace(out, F.lit(base + mark), F.lit(one))
    return F.when(s.rlike(f"[{VOICED}{SEMIVOICED}]"), out).otherwise(s)  # few strings have a mark


def rewritten(s: str, rules: list[tuple[str, str]]) -> str:
    """All rules in order, replaced everywhere, again and again until nothing changes."""
    seen = {s}
    while True:
        new = s
        for a, b in rules:
            new = new.replace(a, b)
        if new == s:
            return s
        if new in seen:
            raise ValueError("the rules go round in a circle")
        seen.add(new)
        s = new


def normalizer(rules: list[tuple[str, str]]):
    """A column function that rewrites to a fixpoint; rules may not lengthen."""
    for a, b in rules:
        if not a or len(b) > len(a):
            raise ValueError(f"{a!r} to {b!r} lengthens")
    return F.udf(lambda s: None if s is None else rewritten(s, rules), "string", useArrow=True)


#: Romaji spellings that count as one.
ROMAJI_RULES = [
    ("-", ""),
    ("aa", "a"), ("ii", "i"), ("uu", "u"), ("ee", "e"), ("oo", "o"), ("ou", "o"),
    ("mb", "nb"), ("mp", "np"), ("mm", "nm"),
    ("sha", "sya"), ("tsu", "tu"), ("chi", "ti"), ("shi", "si"), ("ji", "zi"),
]


#: The same rules as expressions that settle a string of any length at once; those of ``m`` are apart, as their order matters.
_VOWELS = [("-", ""), ("a+", "a"), ("i+", "i"), ("u+", "u"), ("e+", "e"), ("o[ou]+", "o")]
_NASAL = [("mb", "nb"), ("mp", "np"), ("mm", "nm")]
_SYLLABLES = [("sha", "sya"), ("tsu", "tu"), ("chi", "ti"), ("shi", "si"), ("ji", "zi")]


def reduce_romaji(s: Column) -> Column:
    """All rules but those of ``m``."""
    for a, b in _VOWELS + _SYLLABLES:
        s = F.regexp_replace(s, a, b)
    return s


def normalize_romaji(s: Column) -> Column:
    """The rules in order to a fixpoint. (A second round settles what is left of a run of ``m``, none more.)"""
    s = reduce_romaji(s)
    for a, b in _NASAL * 2:
        s = F.replace(s, F.lit(a), F.lit(b))
    return s
