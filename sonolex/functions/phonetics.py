"""Readings: kana to romaji, romaji rewriting, pinyin candidates."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, functions as F

from .text import _NASAL, _SYLLABLES, _VOWELS, normalize_romaji

#: Hepburn spellings of single kana and of those with a small one.
_SINGLE = """ア a イ i ウ u エ e オ o カ ka キ ki ク ku ケ ke コ ko サ sa シ shi ス su セ se ソ so タ ta チ chi ツ tsu テ te ト to
ナ na ニ ni ヌ nu ネ ne ノ no ハ ha ヒ hi フ fu ヘ he ホ ho マ ma ミ mi ム mu メ me モ mo ヤ ya ユ yu ヨ yo
ラ ra リ ri ル ru レ re ロ ro ワ wa ヰ wi ヱ we ヲ wo ン n ガ ga ギ gi グ gu ゲ ge ゴ go ザ za ジ ji ズ zu ゼ ze ゾ zo
ダ da ヂ ji ヅ zu デ de ド do バ ba ビ bi ブ bu ベ be ボ bo パ pa ピ pi プ pu ペ pe ポ po ヴ vu"""
_SMALL = "ウィ wi ウェ we ウォ wo ヴァ va ヴィ vi ヴェ ve ヴォ vo ファ fa フィ fi フェ fe フォ fo ティ ti ディ di トゥ tu ドゥ du シェ she ジェ je チェ che ツァ tsa ツィ tsi ツェ tse ツォ tso"
#: Kana that begin no reading of their own, and those that end none.
NOT_FIRST = "ァィゥェォぁぃぅぇぉャュョゃゅょヮゎㇰㇱㇲㇳㇴㇵㇶㇷㇸㇹㇺㇻㇼㇽㇾㇿー"
NOT_LAST = "ッっ"
#: Initials, two letters before one.
INITIALS = "zh ch sh b p m f d t n l g k h j q x r z c s y w".split()


def _morae() -> dict[str, str]:
    pairs = _SINGLE.split()
    out = dict(zip(pairs[::2], pairs[1::2]))
    for kana in "キギシジチヂニヒビピミリ":
        stem = out[kana][:-1]
        for small, vowel in zip("ャュョ", "auo"):
            out[kana + small] = stem + ("" if stem in ("sh", "ch", "j") else "y") + vowel
    pairs = _SMALL.split()
    return out | dict(zip(pairs[::2], pairs[1::2]))


MORAE = _morae()


def to_romaji_strictly(kana: Column) -> Column:
    """Hepburn of hiragana or katakana; empty where a reading can't begin or end so, or something isn't kana."""
    from .text import to_katakana

    s = to_katakana(kana)
    for mora in sorted(MORAE, key=lambda m: (-len(m), m)):
        s = F.replace(s, F.lit(mora), F.lit(MORAE[mora]))
    s = F.regexp_replace(s, "ッ+(?=ch)", "t")
    s = F.regexp_replace(s, "ッ(?=ッ*([a-z]))", "$1")
    for vowel, long in zip("aiueo", "aiueu"):
        s = F.regexp_replace(s, f"{vowel}ー", vowel + long)
    bad = kana.rlike(f"^[{NOT_FIRST}]") | kana.rlike(f"[{NOT_LAST}]$") | kana.rlike("[ンん][アイウエオヤユヨあいうえおやゆよ]")
    return F.when(bad | ~s.rlike("^[a-z]+$"), "").otherwise(s)


@lru_cache(maxsize=100_000)
def romaji_of(kana: str) -> str:
    """The same for a Python string in katakana, with the spellings settled."""
    if not kana or kana[0] in NOT_FIRST or kana[-1] in NOT_LAST or re.search("ン[アイウエオヤユヨ]", kana):
        return ""
    out, i = "", 0
    while i < len(kana):
        two = kana[i : i + 2]
        if two in MORAE:
            out, i = out + MORAE[two], i + 2
        else:
            out, i = out + MORAE.get(kana[i], kana[i]), i + 1
    out = re.sub("ッ+(?=ch)", "t", out)
    out = re.sub("ッ(?=ッ*([a-z]))", r"\1", out)
    for vowel, long in zip("aiueo", "aiueu"):
        out = out.replace(vowel + "ー", vowel + long)
    if not re.fullmatch("[a-z]+", out):
        return ""
    return settled_romaji(out)


def reduced_romaji(s: str) -> str:
    for a, b in _VOWELS + _SYLLABLES:
        s = re.sub(a, b, s)
    return s


def settled_romaji(s: str) -> str:
    """``normalize_romaji`` of a Python string."""
    s = reduced_romaji(s)
    for a, b in _NASAL * 2:
        s = s.replace(a, b)
    return s


def normal_forms(s: str) -> list[str]:
    """All strings that no rule changes and that rewriting leads to, one place at a time. All rules but those of ``m`` lead to one string
    in any order. An ``m`` before m, b or p may become n; one whose follower became n first stays. For display: a long run of m has very many
    forms, and matching (``romaji_key``) doesn't list them."""
    parts = [""]
    for run in re.findall("m+|[^m]+", reduced_romaji(s) + " "):
        if run[0] != "m":
            if run[0] in "bp":
                parts = [x for x in parts if not x.endswith("m")]
            parts = [x + run for x in parts]
            continue
        for _ in run[1:]:
            parts = [x + y for x in parts for y in "mn" if not (y == "m" and x.endswith("m"))]
        parts = [x + y for x in parts for y in "mn" if not (y == "m" and x.endswith("m"))]
    out = {x.rstrip(" ") for x in parts}
    # the last m of a run becomes n only before b or p
    return sorted(x for x in out if x and _reaches(reduced_romaji(s), x))


def _reaches(reduced: str, form: str) -> bool:
    return len(reduced) == len(form) and all(a == b or a == "m" and b == "n" and reduced[i + 1 : i + 2] in ("m", "b", "p") for i, (a, b) in enumerate(zip(reduced, form)))


def romaji_key(s: Column) -> Column:
    """Strings of which one leads to the other share a key."""
    return F.translate(s, "m", "n")


def reaches(reduced: Column, form: Column) -> Column:
    """Whether rewriting leads from a reduced string to a settled one; both have the same key."""
    at = lambda s, i: F.substring(s, i, 1)
    same = F.forall(F.sequence(F.lit(1), F.length(form)), lambda i: (at(reduced, i) == at(form, i)) | ((at(reduced, i) == "m") & (at(form, i) == "n") & at(reduced, i + 1).isin("m", "b", "p")))
    return (F.length(form) > 0) & (F.length(reduced) == F.length(form)) & same


def pinyin_candidates(reading: Column) -> Column:
    """Distinct: the reading, its initial, the initial's first letter (or its own), and the fuzzy final."""
    initial = F.regexp_extract(reading, f"^({'|'.join(INITIALS)})", 1)
    fuzzy = F.when(reading.rlike("[aei]ng$"), F.regexp_replace(reading, "([aei])ng$", "$1n"))
    first = F.when(initial != "", F.substring(initial, 1, 1)).otherwise(F.substring(reading, 1, 1))
    every = F.array(reading, F.when(initial != "", initial), first, fuzzy)
    return F.array_distinct(F.filter(every, lambda x: x.isNotNull() & (x != "")))


__all__ = ["MORAE", "normal_forms", "normalize_romaji", "pinyin_candidates", "reaches", "romaji_key", "romaji_of", "settled_romaji", "to_romaji_strictly"]
