import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from sonolex.operators import highlight, index as ix, tokenize as tk
from sonolex.operators.search import search
from sonolex.sources import corpus, dictionaries

C1 = ["ワカメスープ", "ドレミの世界に涙を添えて", "今日の鳥", "僕と風と上手"]


@pytest.fixture(scope="module")
def words(spark):
    return dictionaries.sample(spark)


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.fixture(scope="module")
def c1(spark, words):
    return ix.build(table(spark, C1), words).cache()


def ids(df):
    return [r["doc_id"] for r in df.orderBy("query_id", "rank").collect()]


def test_mixed_query(c1):
    """Romaji, a variant character and kana in one query."""
    r = search(c1, "bokuto风じょう").withColumn("parts", highlight.highlights()).collect()
    assert [x["doc_id"] for x in r] == [3]
    assert (r[0]["range_count"], r[0]["match_ratio"], r[0]["match_ratio_level"]) == (2, 4 / 6, 3)
    assert [p["text"] for p in r[0]["parts"] if p["is_highlighted"]] == ["僕", "と", "風", "上"]
    assert "".join(p["text"] for p in r[0]["parts"]) == C1[3]


def test_options(spark, c1):
    assert ids(search(c1, "tori")) == [2]
    assert ids(search(c1, " tori")) == [2]
    assert ids(search(c1, "tori ")) == []
    assert ids(search(c1, "tori ", trim=True)) == [2]
    assert ids(search(c1, "")) == ids(search(c1, " 　")) == []
    assert ids(search(c1, "tori", where=F.col("doc_id") != 2)) == []
    assert ids(search(c1, "tori", allowed=spark.createDataFrame([(1,)], "doc_id long"))) == []


def test_a_long_query_ends(spark, words):
    """Sixty syllables; and a run of m, which has very many spellings."""
    index = ix.build(table(spark, ["しち" * 15, "ンバ" * 3]), words)
    assert ids(search(index, "shichi" * 15)) == [0]
    assert ids(search(index, "shichi" * 15 + "x" + "m" * 60)) == []
    assert ids(search(index, "nbanbanba")) == [1]


def test_long_documents_are_searched(spark):
    """Longer than any row-wise fold would do; both folds agree."""
    made = random.Random(5)
    texts = ["".join(made.choice("abc  d") for _ in range(n)) for n in (3, 9, 40, 700, 1500)] + ["x" * 6000 + "abq" + " " * 300 + "d", "", "   "]
    index = ix.build(table(spark, texts))
    for query in ("abcd", "a d", "bb", "qd", "d"):
        rows = [tuple(r) for r in search(index, query).orderBy("rank").collect()]
        assert {r[2] for r in rows} == {i for i, t in enumerate(texts) if subsequence(t, query)}
        few = {r[2]: r for r in rows if len(texts[r[2]]) < 100}
        other = {r["doc_id"]: tuple(r) for r in search(index, query, long=0, where=F.col("doc_id") < 3).collect()}
        assert {i: r[4:] for i, r in few.items()} == {i: r[4:] for i, r in other.items()}


def subsequence(text, query):
    rest = iter(text)
    return all(ch in rest for ch in query if ch != " ")


def test_both_folds_agree_on_mixed_scripts(c1):
    queries = c1.spark.createDataFrame(list(enumerate(["bokuto风じょう", "to", "sekai", "ni", "じ", "t"])), "query_id long, query string")
    rows = lambda **o: sorted((r["query_id"], r["rank"], r["doc_id"], r["range_count"], r["match_ratio"], r["prefix_match_count"], str(r["tokens"])) for r in search(c1, queries, **o).collect())
    assert rows() == rows(long=0) != []


def test_awkward_rows(spark, words):
    docs = spark.createDataFrame([(1, "Tori 鳥", "x"), (2, None, "y"), (3, "", "z"), (4, "Tori 鳥", "x")], "doc_id long, text string, type string")
    index = ix.build(docs, words)
    assert sorted(ids(search(index, "tori"))) == [1, 4] and ids(search(index, "x")) == []
    asked = spark.createDataFrame([(0, None, "q"), (1, "鳥", "r"), (2, "  ", "s")], "query_id long, query string, text string")
    assert {(r["query_id"], r["doc_id"]) for r in search(index, asked).collect()} == {(1, 1), (1, 4)}
    with pytest.raises(ValueError):
        ix.build(docs.unionByName(docs.limit(1)), words)


def test_phrases_have_no_longest_length(spark, words):
    """Twenty vowels are one reading, as each contracts with the next; a dictionary's longest entry is found."""
    rows = [(r["start"], r["end"], r["text"]) for r in tk.tokenize(table(spark, ["あ" * 20]), words).where("type = 2").collect()]
    assert (0, 20, "a") in rows and len(rows) == 210
    more = dictionaries.Dictionaries(spark.createDataFrame([("東" * 30, "ナガイ")], "surface string, reading string"), words.pinyin_readings, words.han_variants)
    assert (0, 30, "ナガイ") in {(r["start"], r["end"], r["text"]) for r in tk.tokenize(table(spark, ["東" * 30]), more).collect()}


def test_emission_order(spark, words):
    rows = [(r["type"], r["text"], r["start"]) for r in tk.tokenize(table(spark, ["今日a"]), words).orderBy("seq").collect()]
    kinds = [t for t, _, _ in rows]
    assert kinds[-1] == 0 and [k for k in kinds if k in (1, 2)] == sorted(k for k in kinds if k in (1, 2))  # all Kana, then all Romaji
    tail = [(s, t) for t, _, s in rows if t in (3, 4)]
    assert tail == sorted(tail)  # then Han and Pinyin, character by character
    assert rows[:5] == [(1, "イマ", 0), (1, "コン", 0), (1, "ニチ", 1), (1, "ヒ", 1), (1, "キョウ", 0)]


def test_own_phrase_rule(spark):
    found = tk.runs(table(spark, ["かき"]))
    assert {r["phrase"] for r in tk.phrases(found).collect()} == {"か", "き", "かき"}
    assert {r["phrase"] for r in tk.phrases(found, valid=lambda phrase, following: F.length(phrase) == 1).collect()} == {"か", "き"}


def test_interchange(spark, c1, words):
    text = ix.export_json(c1)
    data = json.loads(text)
    assert list(data) == ["documents", "tokenTypes", "tokenReferences", "tries"] and data["documents"] == C1
    again = ix.import_json(spark, text)
    for query in ("bokuto风じょう", "tori", "か"):
        assert [tuple(r) for r in search(c1, query).collect()] == [tuple(r) for r in search(again, query).collect()]
    with pytest.raises(ValueError):
        ix.import_json(spark, ix.export_json(c1, bundle_documents=False))
    bare = ix.import_json(spark, ix.export_json(c1, bundle_documents=False), table(spark, C1))
    assert ids(search(bare, "tori")) == [2]


def test_order_and_limit(spark, words):
    index = ix.build(table(spark, ["テストA", "テストB", "テストC"]), words)
    assert ids(search(index, "テスト", order_by=[F.desc("doc_id")])) == [2, 1, 0]
    assert ids(search(index, "テスト", k=2)) == [0, 1]


def test_long_vowel(spark, words):
    index = ix.build(table(spark, ["今日"]), words)
    assert ids(search(index, "kyo")) == [0]
    assert ids(search(index, "kyou")) == ids(search(index, "kyo-")) == []
    assert ids(search(index, "kyou", long_vowel_at_end=True)) == [0]


def test_voiced(spark, words):
    index = ix.build(table(spark, ["ガ"]), words)
    r = search(index, "カ").collect()
    assert len(r) == 1 and r[0]["prefix_match_count"] == 1 and r[0]["match_ratio"] == 1.0
    assert search(index, "か゛").first()["prefix_match_count"] == 0


def test_tokens(spark, words):
    got = {(r["start"], r["end"], tk.TYPES[r["type"]], r["text"]) for r in tk.tokenize(table(spark, ["今日"]), words).collect()}
    assert got >= {(0, 1, "Han", "今"), (0, 1, "Pinyin", "jin"), (0, 1, "Kana", "コン"), (0, 1, "Kana", "イマ"), (0, 1, "Romaji", "kon"), (0, 1, "Romaji", "ima"), (0, 2, "Kana", "キョウ"), (0, 2, "Romaji", "kyo"), (1, 2, "Romaji", "niti"), (1, 2, "Romaji", "hi")}
    got = [(r["start"], r["type"], r["text"]) for r in tk.tokenize(table(spark, ["a-b"]), words).orderBy("start").collect()]
    assert got == [(0, 0, "a"), (1, 0, "-"), (2, 0, "b")]


def test_store_and_load(spark, c1, tmp_path):
    path = f"file://{tmp_path}/index"
    c1.write(path, bundle_documents=False)
    with pytest.raises(ValueError):
        ix.load(spark, path)
    assert ids(search(ix.load(spark, path, table(spark, C1)), "tori")) == [2]
    c1.write(path)
    assert ids(search(ix.load(spark, path), "tori")) == [2]


def test_variants(spark):
    pairs = spark.createDataFrame([("1", "2"), ("2", "3"), ("4", "5"), ("3", "4"), ("7", "88")], "from_ch string, to_ch string")
    got = {r["ch"] for r in dictionaries.variant_classes(pairs).where("variant = '1'").collect()}
    assert got == set("12345")


def test_line_source(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\ntwo\n")
    assert [r["text"] for r in corpus.from_lines(spark, str(tmp_path / "a.txt")).orderBy("doc_id").collect()] == ["one", "two"]
    (tmp_path / "a.json").write_text('{"title": "x"}\n{"title": "x"}\n{"title": "b"}\n')
    assert [r["text"] for r in corpus.from_json(spark, str(tmp_path / "a.json")).orderBy("doc_id").collect()] == ["b", "x"]


def chains(text, query):
    """Documents a Raw query matches, by trying every subsequence."""
    return any("".join(text[i] for i in at) == query for at in itertools.combinations(range(len(text)), len(query)))


def test_raw_search_is_a_subsequence_search(spark):
    texts = ["".join(p) for n in (1, 2, 3, 4) for p in itertools.product("ab", repeat=n)]
    index = ix.build(table(spark, texts)).cache()
    for query in ("a", "ab", "aab", "bb"):
        assert {texts[i] for i in ids(search(index, query))} == {t for t in texts if chains(t, query)}


def test_empty_corpus(spark, words):
    assert ids(search(ix.build(spark.createDataFrame([], "doc_id long, text string"), words), "a")) == []
