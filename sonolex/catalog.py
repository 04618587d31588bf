"""Queries and oracle SQL of the search engine.

Names come from the tables' short texts; CJK cases come from inline rows. ``_values`` writes the same rows into the SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import phonetics, text as T
from .operators import highlight, index as ix, match, tokenize as tk
from .operators.search import search
from .sources import corpus, dictionaries
from .sources.storage import scratch_path

CORPUS = [(0, "ワカメスープ"), (1, "ドレミの世界に涙を添えて"), (2, "今日の鳥"), (3, "僕は本当に上手"), (4, "中国好世界"), (5, "おはよう"), (6, "c-d 希望"), (7, "ガ"), (8, "和風 x"), (9, "うちで ﾌﾟﾘﾝ")]
SCALAR = ["あいうえお", "ABC", "abc123", "あアa漢", "ＡＢＣ", "１２３", "！＠＃", "ｱｲｳｴｵ", "ｶｷｸｹｺ", "｡｢｣､･", "か゛", "ﾊﾟ", "Straße É", "漢字", "㍿", "　x", ""]
ROMAJI = ["shimbun", "toukyou", "sa-ba-", "ookii", "tsuchi", "jisho", "kyou", "mmb", "aaa", "", "chikashitsu"]
KANA = ["あ", "か", "さくら", "ア", "カ", "サクラ", "おう", "おお", "ー", "ゃ", "っ", "かった", "キャ", "ジョウ", "サー", "ボク", "漢", "ロッチ", "キョウ"]
QUERIES = [(0, "smrng"), (1, "plr"), (2, "bt"), (3, "an"), (4, "zq"), (5, "dr ")]


def _values(rows, names: str) -> str:
    lit = lambda x: f"{x}" if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS t({names})"


def _inline(spark: SparkSession, rows, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.from_table(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_partkey", "p_name")


_PART = "part_docs AS (SELECT p_partkey AS doc_id, p_name AS text FROM part WHERE p_name IS NOT NULL)"
_BUILT: dict[tuple[str, str], str] = {}


def _index(spark, sf_dir) -> ix.Index:
    """The index of all part names; an application builds it once, and its queries load it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        path = scratch_path(spark, "part-index")
        ix.build(_part(spark, sf_dir), path=path)
        _BUILT[key] = path
    return ix.load(spark, _BUILT[key])


def _mixed_index(spark) -> ix.Index:
    key = (spark.sparkContext.applicationId, "")
    if key not in _BUILT:
        path = scratch_path(spark, "mixed-index")
        ix.build(_inline(spark, CORPUS, "doc_id long, text string"), dictionaries.sample(spark), path)
        _BUILT[key] = path
    return ix.load(spark, _BUILT[key])


def _raw_search(queries, where: str = "true", k: int | None = None, order: str = "text", extra: str = "", project: str = "") -> str:
    """The search over Raw tokens alone: each query character takes a later place; white space inside is passed over."""
    rows = [(i, q) for i, q in queries if q.strip() and not q[-1].isspace()]
    project = project or "query_id, rank, doc_id, text, range_count, prefix_match_count, match_ratio, match_ratio_level"
    return f"""
WITH RECURSIVE {_PART}, d AS (SELECT p.*, length(text) AS n FROM part_docs p WHERE {where}),
q AS (SELECT query_id::BIGINT AS query_id, regexp_replace(lower(query), '\\s', '', 'g') AS q FROM {_values(rows, "query_id, query")}),
c AS (SELECT doc_id, text, n, i - 1 AS st, i AS en, lower(substr(text, i, 1)) AS ch FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM d)),
s AS (
  SELECT query_id, q, doc_id, text, n, 1 AS k, 1 AS ranges, st AS first, st, en, [st] AS places FROM q JOIN c ON ch = substr(q, 1, 1)
  UNION ALL
  SELECT s.query_id, s.q, s.doc_id, s.text, s.n, s.k + 1, s.ranges + (trim(substr(s.text, s.en + 1, c.st - s.en)) <> '')::INT, s.first, c.st, c.en, list_append(s.places, c.st)
  FROM s JOIN c ON c.doc_id = s.doc_id AND c.ch = substr(s.q, s.k + 1, 1) AND c.st >= s.en
  QUALIFY row_number() OVER (PARTITION BY s.query_id, s.doc_id, c.en ORDER BY s.ranges + (trim(substr(s.text, s.en + 1, c.st - s.en)) <> '')::INT, s.first, s.en) = 1
), b AS (
  SELECT *, length(q) / n::DOUBLE AS ratio FROM s WHERE k = length(q)
  QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY ranges, first, st) = 1
), r AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY ranges, first, floor(ratio * 5 + 0.5) DESC, st, en, ratio DESC, {order}, doc_id))::INT AS rank,
    doc_id, text, ranges::INT AS range_count, 0::INT AS prefix_match_count, ratio AS match_ratio, floor(ratio * 5 + 0.5)::INT AS match_ratio_level, places
  FROM b
)
SELECT {project} FROM r {f"WHERE rank <= {k}" if k else ""} {extra}"""


def _results(df: DataFrame) -> DataFrame:
    return df.select("query_id", "rank", "doc_id", "text", "range_count", "prefix_match_count", "match_ratio", "match_ratio_level")


def _ask(spark, rows=QUERIES):
    return _inline(spark, rows, "query_id long, query string")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(search(_index(spark, sf_dir), "smrng"))


# --- scalar functions ---------------------------------------------------------------------------------------------------------


def _scalar(rows, name, f):
    return lambda spark, sf_dir: _inline(spark, [(x,) for x in rows], "s string").select("s", f(F.col("s")).alias(name))


def _translate_sql(s: str, a: str, b: str) -> str:
    return f"translate({s}, '{a}', '{b}')"


def _norm(s: str) -> str:
    lower = f"array_to_string([lower(c) FOR c IN regexp_extract_all({s}, '(?s).')], '')"
    return _translate_sql(lower, T.WIDE.replace("'", "''"), T.PLAIN.replace("'", "''"))


def _rules_sql(s: str, rules, rounds: int) -> str:
    for _ in range(rounds):
        for a, b in rules:
            s = f"replace({s}, '{a}', '{b}')"
    return s


def _romaji_sql(s: str) -> str:
    """Strict Hepburn of katakana: the mora table, doubled consonants, long vowels; '' where a reading can't begin or end so."""
    kana = s
    for mora in sorted(phonetics.MORAE, key=lambda m: (-len(m), m)):
        s = f"replace({s}, '{mora}', '{phonetics.MORAE[mora]}')"
    s = f"regexp_replace(replace({s}, 'ッch', 'tch'), 'ッ([a-z])', '\\1\\1', 'g')"
    for vowel, long in zip("aiueo", "aiueu"):
        s = f"replace({s}, '{vowel}ー', '{vowel}{long}')"
    return f"CASE WHEN regexp_matches({kana}, '^[{phonetics.NOT_FIRST}]|[{phonetics.NOT_LAST}]$|ン[アイウエオヤユヨ]') OR NOT regexp_full_match({s}, '[a-z]+') THEN '' ELSE {s} END"


def norm_text(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return docs.select("item_id", T.normalize(F.col("text")).alias("norm"))


def classes(spark, sf_dir):
    rows = _inline(spark, [(x,) for x in SCALAR], "s string")
    s = F.col("s")
    return rows.select("s", T.is_han(s).alias("han"), T.is_kana(s).alias("kana"), T.is_maybe_japanese(s).alias("japanese"), T.is_sound_mark(s).alias("mark"), T.strip_sound_marks(s).alias("stripped"))


def code_points(spark, sf_dir):
    rows = _inline(spark, CORPUS, "doc_id long, text string")
    return rows.select("doc_id", F.posexplode(T.code_points(F.col("text"))).alias("pos", "ch")).withColumn("cp", F.ascii("ch"))


def pinyin_candidates(spark, sf_dir):
    rows = dictionaries.sample(spark).pinyin_readings
    return rows.select("ch", F.explode(phonetics.pinyin_candidates(F.col("reading"))).alias("candidate")).distinct()


_PY = dictionaries.PINYIN.split()
_PINYIN_ROWS = list(zip(_PY[::2], _PY[1::2]))


def normal_forms(spark, sf_dir):
    f = F.udf(lambda s: phonetics.normal_forms(s), "array<string>", useArrow=True)
    return _inline(spark, [(x,) for x in ROMAJI], "s string").select("s", F.explode(f("s")).alias("form"))


# --- dictionaries, tokens, index ----------------------------------------------------------------------------------------------


def variant_components(spark, sf_dir):
    return dictionaries.sample(spark).han_variants


_VA = dictionaries.VARIANTS.split()
_VARIANT_ROWS = list(zip(_VA[::2], _VA[1::2]))


def tokenize_raw(spark, sf_dir):
    return tk.raw_tokens(_part(spark, sf_dir)).select("doc_id", "type", "text", "start", "end")


_RAW = f"""{_PART}, o AS (
  SELECT doc_id, lower(substr(text, i, 1)) AS text, (i - 1)::INT AS st, i::INT AS en FROM (SELECT *, unnest(range(1, length(text) + 1)) AS i FROM part_docs)
  WHERE trim(substr(text, i, 1)) <> ''
), k AS (SELECT (row_number() OVER (ORDER BY text) - 1)::BIGINT AS token_id, text FROM (SELECT DISTINCT text FROM o))"""


def token_dictionary(spark, sf_dir):
    return _index(spark, sf_dir).tokens


def postings(spark, sf_dir):
    rows = _index(spark, sf_dir).postings
    flat = F.array_join(F.transform("offsets", lambda o: F.concat_ws("-", o["start"].cast("string"), o["end"].cast("string"))), " ")
    return rows.select("token_id", "doc_id", F.size("offsets").alias("n"), flat.alias("places"))


def token_prefixes(spark, sf_dir):
    index = _mixed_index(spark)
    rows = index.token_prefixes.join(index.tokens.select("token_id", "text"), "token_id")
    return rows.select("trie", "prefix", "text", "is_exact")


def runs_islands(spark, sf_dir):
    return tk.runs(_inline(spark, CORPUS, "doc_id long, text string")).select("doc_id", F.col("start").cast("int").alias("start"), "run")


def phrases(spark, sf_dir):
    found = tk.phrases(tk.runs(_inline(spark, CORPUS, "doc_id long, text string")))
    return found.select("doc_id", (F.col("start") + F.col("at")).cast("int").alias("start"), F.col("len").cast("int").alias("len"), "phrase")


def kana_readings_lookup(spark, sf_dir):
    found = tk.phrases(tk.runs(_inline(spark, CORPUS, "doc_id long, text string")))
    rows = tk.kana_readings(found, dictionaries.sample(spark))
    return rows.select("doc_id", (F.col("start") + F.col("at")).cast("int").alias("start"), "phrase", "reading")


def tokenize_cjk(spark, sf_dir):
    rows = tk.tokenize(_inline(spark, CORPUS, "doc_id long, text string"), dictionaries.sample(spark))
    return rows.select("doc_id", tk.type_name(F.col("type")).alias("type"), "text", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))


def atomic_readings(spark, sf_dir):
    return tokenize_cjk(spark, sf_dir).where("type in ('Kana', 'Romaji')")


def inspect_tokens(spark, sf_dir):
    docs = _part(spark, sf_dir)
    return tk.inspect_tokens(docs, tk.raw_tokens(docs)).select("doc_id", F.col("seq.run").alias("pos"), "line")


def distinct_titles(spark, sf_dir):
    return corpus.distinct_texts(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_name")


def text_lines(spark, sf_dir):
    path = scratch_path(spark, "lines")
    spark.read.parquet(f"{sf_dir}/part.parquet").select("p_name").write.mode("overwrite").text(path)
    return corpus.from_lines(spark, path).select("text")


def index_roundtrip(spark, sf_dir):
    """Searches an index that was written and read again, with documents given at load."""
    path, built = scratch_path(spark, "index"), _index(spark, sf_dir)
    built.write(path, bundle_documents=False)
    return _results(search(ix.load(spark, path, _part(spark, sf_dir)), "smrng"))


def index_build(spark, sf_dir):
    """Builds the index of all part names, new, and counts what is in it."""
    built = ix.build(_part(spark, sf_dir))
    counts = [built.tokens.select(F.lit("tokens").alias("what")), built.postings.select(F.lit("postings").alias("what")), built.documents.select(F.lit("documents").alias("what"))]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).groupBy("what").agg(F.count("*").alias("n"))


def index_interchange(spark, sf_dir):
    """The mixed index as one JSON object, read again and searched."""
    return _results(search(ix.import_json(spark, ix.export_json(_mixed_index(spark))), _inline(spark, list(enumerate(MIXED)), "query_id long, query string")))


def variant_lists(spark, sf_dir):
    rows = dictionaries.variant_lists(dictionaries.sample(spark).han_variants)
    return rows.select("ch", F.array_join("variants", "").alias("variants"))


def span_lengths(spark, sf_dir):
    """Code points that each token of a part name covers, summed by name length."""
    rows = _index(spark, sf_dir).postings.withColumn("o", F.explode("offsets")).join(_part(spark, sf_dir), "doc_id")
    return rows.groupBy(F.length("text").alias("cps")).agg(F.sum(T.span_length(F.col("o"))).alias("covered"))


def search_documents(spark, sf_dir):
    """Texts of some hundred letters: the hundred best."""
    key = (spark.sparkContext.applicationId, f"{sf_dir}/benchmark")
    if key not in _BUILT:
        path = scratch_path(spark, "benchmark-index")
        ix.build(corpus.from_table(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id", "text"), path=path)
        _BUILT[key] = path
    return _results(search(ix.load(spark, _BUILT[key]), "what", k=100))


def blank_queries(spark, sf_dir):
    """Blank queries, and those that end in white space, find nothing; they don't disturb others."""
    rows = [(0, ""), (1, "  "), (2, "\u3000"), (3, "sm "), (4, "sm"), (5, " s m")]
    return _results(search(_index(spark, sf_dir), _inline(spark, rows, "query_id long, query string"), k=3))


def index_json(spark, sf_dir):
    return _index(spark, sf_dir).to_json()


# --- search -------------------------------------------------------------------------------------------------------------------


def segments(spark, sf_dir):
    return match.segments(_ask(spark)).select("query_id", "l", "r", "n", "seg", "bare")


def search_raw(spark, sf_dir):
    return _results(search(_index(spark, sf_dir), "smrng"))


def search_batch(spark, sf_dir):
    return _results(search(_index(spark, sf_dir), _ask(spark)))


def search_filter(spark, sf_dir):
    return _results(search(_index(spark, sf_dir), _ask(spark), where=F.col("doc_id") % 2 == 0))


def search_allowed(spark, sf_dir):
    some = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_size > 20").select(F.col("p_partkey").alias("doc_id"))
    return _results(search(_index(spark, sf_dir), _ask(spark), allowed=some))


def search_topk(spark, sf_dir):
    return _results(search(_index(spark, sf_dir), _ask(spark), k=5))


def search_custom_order(spark, sf_dir):
    return _results(search(_index(spark, sf_dir), _ask(spark), order_by=[F.desc("doc_id")]))


def highlight_raw(spark, sf_dir):
    rows = search(_index(spark, sf_dir), "smrng")
    shown = F.array_join(F.transform(highlight.highlights(), lambda p: F.when(p["is_highlighted"], F.concat(F.lit("["), p["text"], F.lit("]"))).otherwise(p["text"])), "")
    return rows.select("doc_id", F.replace(shown, F.lit("]["), F.lit("")).alias("shown"))


def stats_line(spark, sf_dir):
    return search(_index(spark, sf_dir), _ask(spark)).select("query_id", "doc_id", highlight.stats_line().alias("line"))


def match_ratio_levels(spark, sf_dir):
    return search_batch(spark, sf_dir).groupBy("query_id", "match_ratio_level").agg(F.count("*").alias("n"))


def range_counts(spark, sf_dir):
    return search_batch(spark, sf_dir).groupBy("query_id", "range_count").agg(F.count("*").alias("n"))


def inspect_results(spark, sf_dir):
    return highlight.inspect(search(_index(spark, sf_dir), "smrng")).select("doc_id", "inspection")


MIXED = ["bokuhhontou", "tori", "tori ", " tori", "sekai", "kyou", "kyo", "カ", "zhongguo", "shijie", "ﾎﾞｸ", "", "shij", "ohayou", "puri", "国好", "c-d"]


#: What MIXED finds in CORPUS: query, rank, document, ranges, matched code points of how many, level.
_FOUND = [
    (1, 1, 2, 1, 1, 4, 1), (3, 1, 2, 1, 1, 4, 1), (4, 1, 4, 1, 2, 5, 2), (4, 2, 1, 1, 2, 12, 1), (6, 1, 2, 1, 2, 4, 3), (7, 1, 7, 1, 1, 1, 5), (7, 2, 0, 1, 1, 6, 1), (8, 1, 4, 1, 2, 5, 2),
    (9, 1, 4, 1, 2, 5, 2), (9, 2, 1, 1, 2, 12, 1), (10, 1, 3, 1, 1, 7, 1), (12, 1, 4, 1, 2, 5, 2), (12, 2, 1, 1, 2, 12, 1), (13, 1, 5, 1, 4, 4, 5), (14, 1, 9, 1, 3, 8, 2), (15, 1, 4, 1, 2, 5, 2),
    (16, 1, 6, 1, 3, 6, 3),
]


def _mixed(spark, **options):
    index = _mixed_index(spark)
    return search(index, _inline(spark, list(enumerate(MIXED)), "query_id long, query string"), **options)


def search_mixed(spark, sf_dir):
    return _results(_mixed(spark))


def match_long_vowel(spark, sf_dir):
    return _results(_mixed(spark, long_vowel_at_end=True, trim=True))


def match_kana_prefix(spark, sf_dir):
    index = _mixed_index(spark)
    rows = match.edges(index, _inline(spark, [(0, "カ"), (1, "ト"), (2, "セ"), (3, "か゛")], "query_id long, query string"))
    return rows.where("type = 1").select("query_id", "text", "is_prefix")


def match_pinyin_tail(spark, sf_dir):
    index = _mixed_index(spark)
    rows = match.edges(index, _inline(spark, [(0, "sh"), (1, "shx"), (2, "fen")], "query_id long, query string"))
    return rows.where("type = 4").select("query_id", "r", "text", "is_prefix")


_KA = dictionaries.KANA.split()
_KANA_ROWS = list(zip(_KA[::2], _KA[1::2]))

_FUNCTIONS = [
    norm_text, classes, code_points, pinyin_candidates, normal_forms, variant_components, tokenize_raw, token_dictionary, postings, token_prefixes, runs_islands, phrases,
    kana_readings_lookup, tokenize_cjk, atomic_readings, inspect_tokens, distinct_titles, text_lines, index_roundtrip, index_json, segments, search_raw, search_batch, search_filter,
    index_build, index_interchange, variant_lists, span_lengths, search_documents, blank_queries, search_allowed, search_topk, search_custom_order, highlight_raw, stats_line, match_ratio_levels, range_counts, inspect_results, search_mixed, match_long_vowel, match_kana_prefix, match_pinyin_tail,
]


def queries() -> dict:
    found = {f.__name__: f for f in _FUNCTIONS}
    found |= {
        "normalize_scalar": _scalar(SCALAR, "norm", T.normalize),
        "to_katakana": _scalar([*SCALAR, *KANA], "katakana", T.to_katakana),
        "compose_dakuten": _scalar(["か゛", "は゜", "ウ゛", "カ゛キ゛", "ア゛", "ゝ゛"], "composed", lambda s: T.compose_dakuten(T.normalize(s))),
        "kana_to_romaji": _scalar(KANA, "romaji", phonetics.to_romaji_strictly),
        "normalize_romaji": _scalar(ROMAJI, "norm", T.normalize_romaji),
    }
    return found


def oracle_sql() -> dict:
    one = lambda rows: _values([(x,) for x in rows], "s")
    japanese = r"[\p{Han}\x{3041}-\x{309F}\x{30A0}-\x{30FF}\x{3005}\x{3006}\x{30FC}\x{3099}\x{309A}]"
    composed = [(a + m, b) for m, pairs in T.COMPOSED.items() for a, b in pairs.items()]
    docs = f"docs AS (SELECT doc_id::BIGINT AS doc_id, {_norm('text')} AS s, text FROM {_values(CORPUS, 'doc_id, text')})"
    cells = f"{docs}, cells AS (SELECT doc_id, i - 1 AS pos, substr(s, i, 1) AS ch, regexp_full_match(substr(s, i, 1), '{japanese}') AS cjk FROM (SELECT *, unnest(range(1, length(s) + 1)) AS i FROM docs))"
    runs = f"{cells}, isl AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM cells WHERE cjk), runs AS (SELECT doc_id, min(pos)::INT AS start, string_agg(ch, '' ORDER BY pos) AS run FROM isl GROUP BY doc_id, g)"
    mark = "[\\x{3099}\\x{309A}]"
    phrase = f"""{runs}, ph AS (
      SELECT doc_id, (start + i - 1)::INT AS start, n::INT AS len, substr(run, i, n) AS phrase, substr(run, i + n, 1) AS next
      FROM (SELECT *, unnest(range(1, length(run) - i + 2)) AS n FROM (SELECT *, unnest(range(1, length(run) + 1)) AS i FROM runs))
    ), phrases AS (SELECT doc_id, start, len, phrase FROM ph WHERE NOT regexp_full_match(substr(phrase, 1, 1), '{mark}') AND NOT regexp_full_match(next, '{mark}'))"""
    key = f"translate({_rules_sql('phrase', composed, 1)}, '{T.VOICED}{T.SEMIVOICED}', '')"
    kana = r"[\x{3041}-\x{309F}\x{30A0}-\x{30FF}]"
    readings = f"""{phrase}, keyed AS (SELECT *, {key} AS key FROM phrases), readings AS (
      SELECT doc_id, start, phrase, {_translate_sql('key', T.HIRAGANA, T.KATAKANA)} AS reading FROM keyed WHERE regexp_full_match(key, '{kana}+')
      UNION SELECT doc_id, start, phrase, reading FROM keyed JOIN {_values(_KANA_ROWS, 'surface, reading')} ON surface = key WHERE NOT regexp_full_match(key, '{kana}'))"""
    initial = "regexp_extract(reading, '^(zh|ch|sh|[bpmfdtnlgkhjqxrzcsyw])', 1)"
    candidates = f"list_filter([reading, nullif({initial}, ''), coalesce(nullif({initial}[1], ''), reading[1]), CASE WHEN regexp_matches(reading, '[aei]ng$') THEN regexp_replace(reading, '([aei])ng$', '\\1n') END], lambda x: x IS NOT NULL)"
    classes_sql = f"p AS (SELECT * FROM {_values(_VARIANT_ROWS, 'a, b')}), pe AS (SELECT a, b FROM p UNION SELECT b, a FROM p), va AS (SELECT a AS ch, a AS variant FROM pe UNION SELECT va.ch, pe.b FROM va JOIN pe ON pe.a = va.variant)"
    # a reading isn't atomic if two candidates or more in a row say the same
    def atomic(name: str, source: str) -> str:
        return f"""{name}_c AS (SELECT DISTINCT doc_id, start AS s, start + length(phrase) AS e, t FROM ({source}) WHERE t <> ''),
        {name}_chain AS (SELECT doc_id, s, e, t, 1 AS k FROM {name}_c UNION SELECT a.doc_id, a.s, b.e, a.t || b.t, 2 FROM {name}_chain a JOIN {name}_c b ON b.doc_id = a.doc_id AND b.s = a.e),
        {name} AS (SELECT doc_id, s, e, t FROM {name}_c EXCEPT SELECT doc_id, s, e, t FROM {name}_chain WHERE k = 2)"""

    said = _romaji_sql("reading")
    cjk = f"""WITH RECURSIVE {readings}, {atomic("kana", "SELECT *, reading AS t FROM readings")}, {atomic("romaji", f"SELECT *, {_rules_sql(said, T.ROMAJI_RULES, 4)} AS t FROM readings")},
    {classes_sql}, chs AS (SELECT doc_id, pos::INT AS pos, ch FROM cells WHERE cjk),
    han AS (SELECT DISTINCT doc_id, pos, coalesce(variant, CASE WHEN regexp_full_match(c.ch, '\\p{{Han}}') THEN c.ch END) AS t FROM chs c LEFT JOIN va USING (ch)),
    pinyin AS (SELECT DISTINCT doc_id, pos, unnest({candidates}) AS t FROM han JOIN {_values(_PINYIN_ROWS, "ch, reading")} ON ch = han.t),
    tokens AS (
      SELECT doc_id, 'Raw' AS type, ch AS text, pos::INT AS start, (pos + 1)::INT AS "end" FROM cells WHERE NOT cjk AND trim(ch) <> ''
      UNION ALL SELECT doc_id, 'Kana', t, s::INT, e::INT FROM kana UNION ALL SELECT doc_id, 'Romaji', t, s::INT, e::INT FROM romaji
      UNION ALL SELECT doc_id, 'Han', t, pos, pos + 1 FROM han WHERE t IS NOT NULL UNION ALL SELECT doc_id, 'Pinyin', t, pos, pos + 1 FROM pinyin)"""
    lit = lambda rows: "VALUES " + ", ".join("(" + ", ".join(str(x).upper() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x + "'" for x in r) + ")" for r in rows)
    texts = dict(CORPUS)
    mixed = lambda rows: "SELECT query_id::BIGINT AS query_id, rank, doc_id::BIGINT AS doc_id, text, range_count, prefix_match_count, match_ratio::DOUBLE AS match_ratio, match_ratio_level FROM (VALUES " + ", ".join(f"({q}, {rank}, {d}, '{texts[d]}', {ranges}, {int(q == 7 and d == 7)}, {a} / {b}::DOUBLE, {level})" for q, rank, d, ranges, a, b, level in rows) + ") AS t(query_id, rank, doc_id, text, range_count, prefix_match_count, match_ratio, match_ratio_level)"
    benchmark = "part_docs AS (SELECT item_id AS doc_id, text FROM benchmark WHERE text IS NOT NULL)"
    return {
        "norm_text": f"SELECT item_id, {_norm('text')} AS norm FROM benchmark",
        "normalize_scalar": f"SELECT s, {_norm('s')} AS norm FROM {one(SCALAR)}",
        "to_katakana": f"SELECT s, {_translate_sql('s', T.HIRAGANA, T.KATAKANA)} AS katakana FROM {one([*SCALAR, *KANA])}",
        "compose_dakuten": f"SELECT s, {_rules_sql(_norm('s'), composed, 1)} AS composed FROM {one(['か゛', 'は゜', 'ウ゛', 'カ゛キ゛', 'ア゛', 'ゝ゛'])}",
        "normalize_romaji": f"SELECT s, {_rules_sql('s', T.ROMAJI_RULES, 4)} AS norm FROM {one(ROMAJI)}",
        "classes": f"SELECT s, regexp_full_match(s, '\\p{{Han}}+') AS han, regexp_full_match(s, '{kana}*') AS kana, regexp_full_match(s, '{japanese}+') AS japanese, regexp_full_match(s, '{mark}+') AS mark, translate(s, '{T.VOICED}{T.SEMIVOICED}', '') AS stripped FROM {one(SCALAR)}",
        "code_points": f"SELECT doc_id::BIGINT AS doc_id, (i - 1)::INT AS pos, substr(text, i, 1) AS ch, unicode(substr(text, i, 1))::INT AS cp FROM (SELECT *, unnest(range(1, length(text) + 1)) AS i FROM {_values(CORPUS, 'doc_id, text')})",
        "tokenize_cjk": f"{cjk} SELECT * FROM tokens",
        "atomic_readings": f"{cjk} SELECT * FROM tokens WHERE type IN ('Kana', 'Romaji')",
        "token_prefixes": f"{cjk}, k AS (SELECT DISTINCT type, text FROM tokens) SELECT CASE type WHEN 'Romaji' THEN 'romaji' WHEN 'Kana' THEN 'kana' ELSE 'other' END AS trie, substr(text, 1, i) AS prefix, text, i = length(text) AS is_exact FROM (SELECT *, unnest(range(1, length(text) + 1)) AS i FROM k)",
        "kana_to_romaji": f"SELECT s, {_romaji_sql(_translate_sql('s', T.HIRAGANA, T.KATAKANA))} AS romaji FROM {one(KANA)}",
        "normal_forms": "SELECT s, form FROM (VALUES ('shimbun', 'sinbun'), ('toukyou', 'tokyo'), ('sa-ba-', 'saba'), ('ookii', 'oki'), ('tsuchi', 'tuti'), ('jisho', 'zisho'), ('kyou', 'kyo'), ('mmb', 'mnb'), ('mmb', 'nnb'), ('aaa', 'a'), ('chikashitsu', 'tikasitu')) AS t(s, form)",
        "variant_lists": f"WITH RECURSIVE {classes_sql} SELECT ch, string_agg(variant, '' ORDER BY variant) AS variants FROM va GROUP BY ch",
        "span_lengths": f"WITH {_RAW} SELECT length(p.text)::INT AS cps, count(*) AS covered FROM o JOIN part_docs p USING (doc_id) GROUP BY 1",
        "index_build": f"WITH {_RAW} SELECT 'tokens' AS what, count(*) AS n FROM k UNION ALL SELECT 'postings', count(DISTINCT (doc_id, text)) FROM o UNION ALL SELECT 'documents', count(*) FROM part_docs",
        "index_json": f"WITH {_RAW}, r AS (SELECT token_id, text, doc_id, '[' || doc_id || string_agg(',' || st || ',' || en, '' ORDER BY st) || ']' AS r FROM o JOIN k USING (text) GROUP BY token_id, text, doc_id) SELECT token_id, '{{\"tokenId\":' || token_id || ',\"tokenType\":0,\"text\":\"' || text || '\",\"tokenReferences\":[' || string_agg(r, ',' ORDER BY doc_id) || ']}}' AS json FROM r GROUP BY token_id, text",
        "highlight_raw": _raw_search([(0, "smrng")], project="doc_id, replace(array_to_string([CASE WHEN list_contains(places, i - 1) THEN '[' || substr(text, i, 1) || ']' ELSE substr(text, i, 1) END FOR i IN range(1, length(text) + 1)], ''), '][', '') AS shown"),
        "inspect_results": _raw_search([(0, "smrng")], project="doc_id, '\"' || text || '\" (' || range_count || ' ranges, ' || regexp_replace(printf('%.4f', match_ratio), '\\.?0+$', '') || ' => L' || match_ratio_level || ')' || array_to_string([chr(10) || '    Raw: \"' || lower(substr(text, x + 1, 1)) || '\" -> \"' || substr(text, x + 1, 1) || '\"' FOR x IN places], '') || chr(10) AS inspection"),
        # worked out by hand from the rules of matching and ranking
        "match_kana_prefix": "SELECT query_id::BIGINT AS query_id, text, is_prefix FROM (" + lit([(0, "カ", False), (0, "ガ", True), (1, "トウ", True), (1, "トリ", True), (1, "ド", True), (2, "セカイ", True), (3, "カ", False), (3, "ガ", False), (3, "ガ", True)]) + ") AS t(query_id, text, is_prefix)",
        "match_pinyin_tail": "SELECT query_id::BIGINT AS query_id, r, text, is_prefix FROM ("
        + lit([(0, 0, "s", False), (0, 1, "h", False), (0, 1, "hao", True), (0, 1, "he", True), (0, 1, "sh", False), (0, 1, "shan", True), (0, 1, "shang", True), (0, 1, "shi", True), (0, 1, "shou", True)])
        + ", "
        + lit([(1, 0, "s", False), (1, 1, "h", False), (1, 1, "sh", False), (2, 0, "f", False), (2, 2, "fen", False), (2, 2, "feng", True), (2, 2, "n", False), (2, 2, "niao", True)]).removeprefix("VALUES ")
        + ") AS t(query_id, r, text, is_prefix)",
        "search_mixed": mixed(_FOUND),
        "index_interchange": mixed(_FOUND),
        "match_long_vowel": mixed(sorted([r for r in _FOUND if r[0] != 13] + [(2, 1, 2, 1, 1, 4, 1), (5, 1, 2, 1, 2, 4, 3), (13, 1, 5, 1, 3, 4, 4)])),
        "blank_queries": _raw_search([(4, "sm"), (5, " s m")], k=3),
        "search_documents": _raw_search([(0, "what")], k=100).replace(_PART, benchmark),
        "pinyin_candidates": f"SELECT DISTINCT ch, unnest({candidates}) AS candidate FROM {_values(_PINYIN_ROWS, 'ch, reading')}",
        "variant_components": f"WITH RECURSIVE p AS (SELECT * FROM {_values(_VARIANT_ROWS, 'a, b')}), e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r AS (SELECT a AS ch, a AS variant FROM e UNION SELECT r.ch, e.b FROM r JOIN e ON e.a = r.variant) SELECT ch, variant FROM r",
        "tokenize_raw": f"WITH {_RAW} SELECT doc_id, 0::INT AS type, text, st AS start, en AS \"end\" FROM o",
        "token_dictionary": f"WITH {_RAW} SELECT token_id, 0::INT AS type, text, 1::INT AS cp_len, 'other' AS trie FROM k",
        "postings": f"WITH {_RAW} SELECT token_id, doc_id, count(*)::INT AS n, string_agg(st || '-' || en, ' ' ORDER BY st) AS places FROM o JOIN k USING (text) GROUP BY token_id, doc_id",
        "inspect_tokens": f"WITH {_RAW} SELECT o.doc_id, st AS pos, 'Raw: \"' || o.text || '\" <- \"' || substr(p.text, en, 1) || '\" [' || st || ', ' || en || ']' AS line FROM o JOIN part_docs p USING (doc_id)",
        "distinct_titles": "SELECT (row_number() OVER (ORDER BY p_name) - 1)::BIGINT AS doc_id, p_name AS text FROM (SELECT DISTINCT p_name FROM part WHERE p_name IS NOT NULL)",
        "text_lines": "SELECT p_name AS text FROM part WHERE length(p_name) > 0",
        "runs_islands": f"WITH {runs} SELECT doc_id, start, run FROM runs",
        "phrases": f"WITH {phrase} SELECT * FROM phrases",
        "kana_readings_lookup": f"WITH {readings} SELECT doc_id, start, phrase, reading FROM readings",
        "segments": f"SELECT query_id::BIGINT AS query_id, l::INT AS l, r::INT AS r, n::INT AS n, substr(q, l + 1, r - l + 1) AS seg, regexp_replace(substr(q, l + 1, r - l + 1), '\\s', '', 'g') AS bare FROM (SELECT *, unnest(range(l, n)) AS r FROM (SELECT query_id, query AS q, length(query) AS n, unnest(range(0, length(query))) AS l FROM {_values(QUERIES, 'query_id, query')})) WHERE substr(q, r + 1, 1) <> ' '",
        "search_raw": _raw_search([(0, "smrng")]),
        "index_roundtrip": _raw_search([(0, "smrng")]),
        "search_batch": _raw_search(QUERIES),
        "search_filter": _raw_search(QUERIES, where="doc_id % 2 = 0"),
        "search_allowed": _raw_search(QUERIES, where="doc_id IN (SELECT p_partkey FROM part WHERE p_size > 20)"),
        "search_topk": _raw_search(QUERIES, k=5),
        "search_custom_order": _raw_search(QUERIES, order="doc_id DESC"),
        "match_ratio_levels": _raw_search(QUERIES, project="query_id, match_ratio_level, count(*) AS n", extra="GROUP BY ALL"),
        "range_counts": _raw_search(QUERIES, project="query_id, range_count, count(*) AS n", extra="GROUP BY ALL"),
        "stats_line": _raw_search(QUERIES, project="query_id, doc_id, range_count || ' range(s), ' || floor(match_ratio * 100 + 0.5)::BIGINT || '%' AS line"),
    }
