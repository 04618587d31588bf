"""Documents to token occurrences.

A document's normalised code points fall into runs that may be Japanese or Chinese and single other characters. Runs give Kana and
Romaji tokens for phrases with a reading that isn't put together from shorter ones, and Han and Pinyin tokens for characters; other
characters that aren't white space give a Raw token each. Offsets count code points, white space included.

Phrases have no longest length: dictionary entries are looked up as long as the dictionary has any, and kana are read as far as one reading can
reach (``_sounds``). Tokens come in the order of emission, ``seq``: by run (or single character), and in a run all Kana, all Romaji (both by length,
place and reading), then Han and Pinyin character by character.

Defined results: null and empty texts have no tokens; a document row gives its tokens, whether its text repeats or not; columns besides doc_id and text are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import phonetics, text as T
from ..sources.dictionaries import Dictionaries

RAW, KANA, ROMAJI, HAN, PINYIN = range(5)
TYPES = ("Raw", "Kana", "Romaji", "Han", "Pinyin")


def type_name(column) -> Column:
    return F.element_at(F.array(*map(F.lit, TYPES)), column + 1)


def _cells(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, ch, cjk) of every code point."""
    points = docs.select("doc_id", F.posexplode(T.code_points(T.normalize(F.col("text")))).alias("pos", "ch"))
    return points.withColumn("cjk", T.is_maybe_japanese(F.col("ch")))


def _seq(run: Column, kind: int, a: Column, b: Column, text: Column) -> Column:
    """What sorts as tokens are emitted."""
    return F.struct(run.cast("int").alias("run"), F.lit(kind).alias("kind"), a.cast("int").alias("a"), b.cast("int").alias("b"), text.alias("text"))


def raw_tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, type, text, start, end, seq) of the Raw tokens; narrow."""
    cells = _cells(docs).where(~F.col("cjk") & ~T.is_space(F.col("ch")))
    return cells.select("doc_id", F.lit(RAW).alias("type"), F.col("ch").alias("text"), F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), _seq(F.col("pos"), 0, F.lit(0), F.lit(0), F.lit("")).alias("seq"))


def runs(docs: DataFrame) -> DataFrame:
    """(doc_id, start, run) of the maximal runs; found inside the row, without a shuffle."""
    rows = docs.select("doc_id", T.normalize(F.col("text")).alias("s")).where(F.col("s").rlike(T.JAPANESE))
    rows = rows.withColumn("cps", T.code_points(F.col("s")))
    rows = rows.withColumn("in", F.transform("cps", lambda c: T.is_maybe_japanese(c)))
    edge = lambda here, there: F.expr(f"filter(sequence(0, size(in) - 1), i -> in[i] and ({there} or not in[{here}]))")
    rows = rows.withColumn("a", edge("greatest(i - 1, 0)", "i = 0")).withColumn("b", edge("least(i + 1, size(in) - 1)", "i = size(in) - 1"))
    rows = rows.select("doc_id", "cps", F.explode(F.arrays_zip("a", "b")).alias("r"))
    return rows.select("doc_id", F.col("r.a").alias("start"), F.expr("array_join(slice(cps, r.a + 1, r.b - r.a + 1), '')").alias("run"))


def is_phrase(phrase: Column, following: Column) -> Column:
    """The rule for phrases: they neither begin with a sound mark nor stand before one."""
    return ~T.is_sound_mark(F.substring(phrase, 1, 1)) & ((following == "") | ~T.is_sound_mark(following))


def phrases(found: DataFrame, longest: int | None = None, valid=is_phrase) -> DataFrame:
    """(doc_id, start, run, at, len, phrase) of all phrases, of up to ``longest`` characters (sound marks don't count) if given. valid: another
    rule, from the phrase and the code point behind it."""
    n = F.length("run")
    rows = found.withColumn("at", F.explode(F.sequence(F.lit(0), n - 1)))
    most = F.length("run") - F.col("at")
    if longest is not None:
        marks = f"[{T.VOICED}{T.SEMIVOICED}]*"
        most = F.length(F.regexp_extract(F.expr("substring(run, at + 1)"), f"^(?:.{marks}){{0,{max(longest, 1)}}}", 0))
    rows = rows.withColumn("len", F.explode(F.sequence(F.lit(1), F.greatest(most, F.lit(1)))))
    rows = rows.withColumn("phrase", F.expr("substring(run, at + 1, len)")).withColumn("next", F.expr("substring(run, at + len + 1, 1)"))
    return rows.where(valid(F.col("phrase"), F.col("next"))).drop("next")


def _looked_up(rows: DataFrame, dictionaries: Dictionaries) -> DataFrame:
    """Phrases with ``key`` -> with the dictionary's ``reading``; single kana aren't looked up."""
    known = dictionaries.kana_readings.select(F.col("surface").alias("key"), T.to_katakana(F.col("reading")).alias("reading")).distinct()
    return rows.where(~(T.is_kana(F.col("key")) & (F.length("key") == 1))).join(known, "key")


def kana_readings(found: DataFrame, dictionaries: Dictionaries) -> DataFrame:
    """phrases -> with ``reading``: kana read themselves; the dictionary reads all but single kana."""
    rows = found.withColumn("key", T.strip_sound_marks(T.compose_dakuten(F.col("phrase"))))
    own = rows.where(T.is_kana(F.col("key")) & (F.col("key") != "")).withColumn("reading", T.to_katakana(F.col("key")))
    return own.unionByName(_looked_up(rows, dictionaries).select(*own.columns)).distinct()


def atomic(rows: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Those readings (at, len, reading) that aren't two or more kept readings of parts of the phrase in a row."""
    kept: dict[int, list[tuple[int, str]]] = {}
    out = []
    for at, n, reading in sorted(set(rows), key=lambda r: (r[1], r[0], r[2])):
        if not reading:
            continue
        seen, todo, made = {(at, 0)}, [(at, 0)], False
        while todo and not made:
            p, t = todo.pop()
            for m, r in kept.get(p, ()):
                if m < n and p + m <= at + n and reading.startswith(r, t):
                    state = (p + m, t + len(r))
                    if state == (at + n, len(reading)):
                        made = True
                        break
                    if state not in seen:
                        seen.add(state)
                        todo.append(state)
        if not made:  # parts are shorter than the phrase: m < n above
            out.append((at, n, reading))
            kept.setdefault(at, []).append((n, reading))
    return out


_MARKS = T.VOICED + T.SEMIVOICED
_MEET = {"aa", "ii", "uu", "ee", "oo", "ou"}


def _kana_of(unit: str) -> str:
    """A character with its sound marks, in katakana: the first mark composes if it can, others are dropped."""
    one = T.COMPOSED.get(unit[1:2], {}).get(unit[0], unit[0])
    return one.translate(_TO_KATAKANA)


_TO_KATAKANA = dict(zip(map(ord, T.HIRAGANA), T.KATAKANA))
_IS_KANA = re.compile("[\u3041-\u309F\u30A0-\u30FF]+")


def spoken(run: str) -> list[tuple[int, int, str]]:
    """(at, len, romaji) of the run's kana phrases that may be more than their parts.

    A phrase is the sum of its parts where it can be cut between two kana whose romaji don't contract; then all longer ones are, too."""
    units = re.findall(f"[^{_MARKS}][{_MARKS}]*", run)
    begin = len(run) - sum(map(len, units))  # marks that stand first belong to nothing
    edge, kana = [begin], []
    for u in units:
        edge.append(edge[-1] + len(u))
        kana.append(_kana_of(u))
    out = []
    for i in range(len(kana)):
        text = ""
        for j in range(i, len(kana)):
            if not _IS_KANA.fullmatch(kana[j]):
                break
            before, text = text, text + kana[j]
            if before:
                left = phonetics.romaji_of(before)
                right = phonetics.romaji_of(kana[j]) or phonetics.romaji_of("".join(kana[j : j + 2])) or phonetics.romaji_of("".join(kana[j : j + 3]))
                # cut here, both sides say as much as the whole
                if left and right and kana[j] not in phonetics.NOT_FIRST and left[-1] + right[0] not in _MEET:
                    break
            said = phonetics.romaji_of(text)
            if said:
                out.append((edge[i], edge[j + 1] - edge[i], said))
    return out


def _sounds(run: str, rows) -> list[tuple[int, int, int, str]]:
    """(type, at, len, text) of a run from its dictionary readings."""
    kana = {(r["at"], r["len"], r["reading"]) for r in rows or []}
    romaji = {(a, n, phonetics.romaji_of(x)) for a, n, x in kana} | set(spoken(run))
    at = 0
    for u in re.findall(f"[{_MARKS}]+|[^{_MARKS}][{_MARKS}]*", run):
        if u[0] not in _MARKS and _IS_KANA.fullmatch(_kana_of(u)):
            kana.add((at, len(u), _kana_of(u)))  # longer kana are the sum of these
        at += len(u)
    return [(KANA, *r) for r in atomic(list(kana))] + [(ROMAJI, *r) for r in atomic(list(romaji))]


def tokenize(docs: DataFrame, dictionaries: Dictionaries | None = None) -> DataFrame:
    """(doc_id, type, text, start, end, seq) of all tokens; seq sorts them as they are emitted."""
    raw = raw_tokens(docs)
    if dictionaries is None:
        return raw
    found = runs(docs)
    known = phrases(found, dictionaries.longest).withColumn("key", T.strip_sound_marks(T.compose_dakuten(F.col("phrase"))))
    read = _looked_up(known, dictionaries).select("doc_id", "start", "at", "len", "reading")
    read = read.groupBy("doc_id", "start").agg(F.collect_set(F.struct("at", "len", "reading")).alias("rows"))  # of one run
    sounds = F.udf(_sounds, "array<struct<type:int,at:int,len:int,text:string>>", useArrow=True)
    sound = found.join(read, ["doc_id", "start"], "left").select("doc_id", F.col("start").alias("s"), F.explode(sounds("run", "rows")).alias("t"))
    order = F.when(F.col("t.type") == KANA, _seq(F.col("s"), 0, F.col("t.len"), F.col("t.at"), F.col("t.text"))).otherwise(_seq(F.col("s"), 1, F.col("t.len"), F.col("t.at"), F.col("t.text")))
    sound = sound.select("doc_id", F.col("t.type").alias("type"), F.col("t.text").alias("text"), (F.col("s") + F.col("t.at")).alias("start"), (F.col("s") + F.col("t.at") + F.col("t.len")).alias("end"), order.alias("seq"))
    chars = found.select("doc_id", F.col("start").alias("s"), F.posexplode(T.code_points(F.col("run"))).alias("at", "ch"))
    variants = dictionaries.han_variants.distinct()
    han = chars.join(variants, "ch", "left").withColumn("variant", F.coalesce("variant", F.when(T.is_han(F.col("ch")), F.col("ch")))).where("variant is not null")
    han = han.select("doc_id", "s", "at", "variant").distinct()
    pinyin = han.join(dictionaries.pinyin_readings.select(F.col("ch").alias("variant"), "reading"), "variant")
    pinyin = pinyin.select("doc_id", "s", "at", F.explode(phonetics.pinyin_candidates(F.col("reading"))).alias("text")).distinct()

    def one(df: DataFrame, kind: int, text: str) -> DataFrame:
        at = F.col("s") + F.col("at")
        return df.select("doc_id", F.lit(kind).alias("type"), F.col(text).alias("text"), at.alias("start"), (at + 1).alias("end"), _seq(F.col("s"), 2, F.col("at"), F.lit(kind), F.col(text)).alias("seq"))

    return raw.unionByName(sound).unionByName(one(han, HAN, "variant")).unionByName(one(pinyin, PINYIN, "text"))


def inspect_tokens(docs: DataFrame, tokens: DataFrame) -> DataFrame:
    """(doc_id, seq, line): ``Type: "text" <- "original" [start, end]``."""
    rows = tokens.join(docs.select("doc_id", F.col("text").alias("original")), "doc_id")
    part = F.expr("substring(original, start + 1, end - start)")
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    line = F.concat(type_name(F.col("type")), F.lit(": "), quote(F.col("text")), F.lit(" <- "), quote(part), F.lit(" ["), F.col("start"), F.lit(", "), F.col("end"), F.lit("]"))
    return rows.select("doc_id", "seq", line.alias("line"))


__all__ = ["HAN", "KANA", "PINYIN", "RAW", "ROMAJI", "TYPES", "atomic", "inspect_tokens", "is_phrase", "kana_readings", "phrases", "raw_tokens", "runs", "tokenize", "type_name"]
