"""Query segments and the tokens they match.

A query (query_id, query) is normalised and put in katakana; every piece [l, r] of it is a segment. Romaji tokens match a segment that
rewrites to them; Kana tokens match as wholes or by prefix anywhere; Raw, Han and Pinyin tokens match as wholes, or by prefix where
the segment ends the query. White space and sound marks inside a segment are passed over. A step that moves in none of the tries
gives nothing (see ``edges``).

Defined results: null and blank queries match nothing; every query row matches on its own if its id is its own (rows that share an id are taken for
one query of several spellings); other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import phonetics, text as T
from .index import Index


def segments(queries: DataFrame, trim: bool = False) -> DataFrame:
    """(query_id, l, r, n, seg, bare, last) of every segment that doesn't end in white space; blank queries have none."""
    text = F.trim(F.col("query")) if trim else F.col("query")
    rows = queries.where(F.length(T.strip_ignorable(F.col("query"))) >= 0).where(~F.col("query").rlike(f"^{T.SPACE}*$"))
    rows = rows.select("query_id", T.to_katakana(T.normalize(text)).alias("q")).withColumn("n", F.length("q"))
    rows = rows.withColumn("l", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("r", F.explode(F.sequence(F.col("l"), F.col("n") - 1)))
    rows = rows.withColumn("seg", F.expr("substring(q, l + 1, r - l + 1)")).withColumn("last", F.expr("substring(q, r + 1, 1)"))
    rows = rows.where(~T.is_space(F.col("last")))
    return rows.select("query_id", "l", "r", "n", "seg", T.strip_ignorable(F.col("seg")).alias("bare"), "last")


_VOICED = {one: base for pairs in T.COMPOSED.values() for base, one in pairs.items()}


def _plain(s):
    """Without sound marks, composed or not."""
    return F.translate(T.strip_sound_marks(s), "".join(_VOICED), "".join(_VOICED.values()))


def _settled(kana: str, ways: list[str] | None) -> tuple[str, bool]:
    """(the segment with each mark composed if a token goes on so, else dropped; whether it ends in no mark, or in one that was composed)."""
    known, out, moved = set(ways or []), "", True
    for ch in kana:
        moved = True
        if ch in T.COMPOSED:
            one = T.COMPOSED[ch].get(out[-1:], None)
            moved = one is not None and out[:-1] + one in known
            out = out[:-1] + one if moved else out
        else:
            out += ch
    return out, moved


def resolve_marks(segs: DataFrame, kana: DataFrame) -> DataFrame:
    """Adds ``kana``, the segment with its sound marks settled, and ``moved``: whether its last code point counted. kana: distinct prefixes of Kana tokens.

    What may decide a mark are the prefixes that are spelt alike but for marks: one join for all marks of all segments."""
    rows = segs.withColumn("kana", F.regexp_replace("seg", T.SPACE, ""))
    marks = f"[{T.VOICED}{T.SEMIVOICED}]"
    free = rows.where(~F.col("kana").rlike(marks)).withColumn("moved", F.lit(True))
    bound = rows.where(F.col("kana").rlike(marks))
    at = F.filter(F.sequence(F.lit(1), F.length("kana")), lambda i: F.substring(F.col("kana"), i, 1).isin(T.VOICED, T.SEMIVOICED))
    keys = bound.withColumn("key", F.explode(F.array_distinct(F.transform(at, lambda i: _plain(F.substring(F.col("kana"), F.lit(1), i))))))
    known = kana.select("prefix", _plain(F.col("prefix")).alias("key"))
    ways = keys.join(known, "key").groupBy("query_id", "l", "r").agg(F.collect_set("prefix").alias("ways"))
    settle = F.udf(_settled, "struct<kana:string,moved:boolean>", useArrow=True)
    done = bound.join(ways, ["query_id", "l", "r"], "left").withColumn("s", settle("kana", "ways"))
    return free.unionByName(done.select(*segs.columns, F.col("s.kana").alias("kana"), F.col("s.moved").alias("moved")))


def edges(index: Index, queries: DataFrame, trim: bool = False, long_vowel_at_end: bool = False) -> DataFrame:
    """(query_id, l, r, n, token_id, type, text, cp_len, rank, is_prefix) of all matches.

    A romaji match at (l, r) is dropped if the token also matches at (l, r - 1) and no Raw, Han or Pinyin token begins with what
    stands before r: then no trie moves at r. So a long vowel that ends a word isn't found where only romaji could take
    it; ``long_vowel_at_end`` keeps such matches.
    """
    prefixes = index.token_prefixes
    kana = prefixes.where("trie = 'kana'")
    other = prefixes.where("trie = 'other'")
    segs = segments(queries, trim)
    if "kana" in index.tries:
        segs = resolve_marks(segs, kana.select("prefix").distinct()).where("moved")
    else:  # no mark composes
        segs = segs.where(~T.is_sound_mark(F.col("last")))
    keys = ["query_id", "l", "r", "n"]

    rest = segs.where("bare <> ''").select(*keys, F.col("bare").alias("prefix")).join(other, "prefix").where("is_exact or r = n - 1")
    every = rest.select(*keys, "token_id", "is_exact", F.lit(2).alias("rank"))

    if "romaji" in index.tries:
        latin = segs.where(F.col("bare").rlike("^[a-z-]+$")).select(*keys, "bare", T.reduce_romaji(F.col("bare")).alias("reduced"))
        tokens = prefixes.where("trie = 'romaji' and is_exact").select("token_id", "prefix", phonetics.romaji_key(F.col("prefix")).alias("key"))
        latin = latin.withColumn("key", phonetics.romaji_key(F.col("reduced")))
        romaji = latin.join(tokens, "key").where(phonetics.reaches(F.col("reduced"), F.col("prefix"))).select(*keys, "bare", "token_id").distinct()
        if not long_vowel_at_end:
            before = romaji.select("query_id", "l", (F.col("r") + 1).alias("r"), "token_id", F.col("bare").alias("was"))
            alive = other.select(F.col("prefix").alias("was")).distinct()
            still = before.join(alive, "was", "left_anti").select("query_id", "l", "r", "token_id")
            romaji = romaji.join(still, ["query_id", "l", "r", "token_id"], "left_anti")
        every = every.unionByName(romaji.select(*keys, "token_id", F.lit(True).alias("is_exact"), F.lit(0).alias("rank")))

    if "kana" in index.tries:
        own = segs.where("kana <> ''").select(*keys, F.col("kana").alias("prefix"), F.lit(True).alias("same"))
        last = F.expr("substring(kana, length(kana), 1)")
        for pairs in T.COMPOSED.values():
            voiced = segs.where(last.isin(*pairs)).select(*keys, F.concat(F.expr("substring(kana, 1, length(kana) - 1)"), F.translate(last, "".join(pairs), "".join(pairs.values()))).alias("prefix"), F.lit(False).alias("same"))
            own = own.unionByName(voiced)
        found = own.join(kana, "prefix").select(*keys, "token_id", (F.col("is_exact") & F.col("same")).alias("is_exact"), F.lit(1).alias("rank"))
        every = every.unionByName(found)

    every = every.groupBy(*keys, "token_id", "rank").agg((~F.max("is_exact")).alias("is_prefix"))
    return every.join(index.tokens.drop("trie"), "token_id")
