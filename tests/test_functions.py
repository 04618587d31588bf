import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from sonolex.functions import phonetics, text as T
from sonolex.operators.tokenize import atomic


def column(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string").select("i", f(F.col("s")).alias("x")).collect()
    return [r["x"] for r in sorted(rows, key=lambda r: r["i"])]


def test_normalize(spark):
    cases = {"ＡＢＣ": "abc", "１２３": "123", "！＠＃": "!@#", "　": " ", "ｱｲｳｴｵ": "アイウエオ", "ｶｷｸｹｺ": "カキクケコ", "ﾞ": "゙", "゛": "゙", "ﾟ": "゚", "゜": "゚", "｡｢｣､･": "。「」、・", "ABC": "abc", "": ""}
    assert column(spark, T.normalize, cases) == list(cases.values())
    assert column(spark, T.normalize, [None]) == [None]


def test_katakana(spark):
    cases = {"あいうえお": "アイウエオ", "かきくけこ": "カキクケコ", "アイウエオ": "アイウエオ", "abc123": "abc123", "漢字": "漢字", "あアa漢": "アアa漢"}
    assert column(spark, T.to_katakana, cases) == list(cases.values())


def test_romaji(spark):
    cases = {"あ": "a", "か": "ka", "さくら": "sakura", "ア": "a", "カ": "ka", "サクラ": "sakura", "おう": "ou", "おお": "oo", "ー": "", "ゃ": "", "っ": "", "かった": "katta", "ロッチ": "rotchi", "キャ": "kya", "漢": ""}
    assert column(spark, phonetics.to_romaji_strictly, cases) == list(cases.values())


def test_python_romaji_agrees(spark):
    words = ["ジョウ", "トウキョウ", "シンブン", "サーバー", "カッタ", "シャチョウ", "ツキ", "ー", "キョ", "シンイチ"]
    settled = [r["x"] for r in spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, s string").select("i", T.normalize_romaji(phonetics.to_romaji_strictly(F.col("s"))).alias("x")).orderBy("i").collect()]
    assert [phonetics.romaji_of(w) for w in words] == settled


def test_classes(spark):
    assert column(spark, T.is_han, ["中", "国", "日", "本", "a", "あ", "ア", "1"]) == [True] * 4 + [False] * 4
    assert column(spark, T.is_space, [" ", "　", "﻿", "\x85", "a"]) == [True, True, True, False, False]


def test_pinyin(spark):
    got = column(spark, phonetics.pinyin_candidates, ["zhong", "feng", "an", "hang"])
    assert got == [["zhong", "zh", "z"], ["feng", "f", "fen"], ["an", "a"], ["hang", "h", "han"]]


def test_normal_forms_is_not_confluent():
    assert set(phonetics.normal_forms("mmb")) >= {"mnb", "nnb"}
    assert phonetics.normal_forms("sha") == ["sya"]
    assert phonetics.normal_forms("-") == []


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aiueomnbptshcj-", max_size=9))
def test_settled_spelling_is_a_normal_form(s):
    settled = s
    while True:
        new = settled
        for a, b in T.ROMAJI_RULES:
            new = new.replace(a, b)
        if new == settled:
            break
        settled = new
    assert settled == "" or settled in phonetics.normal_forms(s)


def one_place_at_a_time(s):
    seen, todo, out = {s}, [s], set()
    while todo:
        x = todo.pop()
        moved = False
        for a, b in T.ROMAJI_RULES:
            at = x.find(a)
            while at >= 0:
                moved = True
                y = x[:at] + b + x[at + len(a) :]
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
                at = x.find(a, at + 1)
        if not moved:
            out.add(x)
    return sorted(out - {""})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aiueombpmschtjuyn-", max_size=8))
def test_normal_forms_against_brute_force(s):
    assert phonetics.normal_forms(s) == one_place_at_a_time(s)
    assert phonetics.settled_romaji(s) == T.rewritten(s, T.ROMAJI_RULES)


def test_romaji_of_any_length(spark):
    long = ["a" * 5000, "ou" * 3000, "m" * 41 + "ba", "shi" * 2000, "o-u" * 500]
    assert column(spark, T.normalize_romaji, long) == [T.rewritten(x, T.ROMAJI_RULES) for x in long]
    assert column(spark, phonetics.to_romaji_strictly, ["ッ" * 9 + "カ"]) == ["k" * 10 + "a"] and phonetics.romaji_of("ッ" * 9 + "カ") == "k" * 10 + "a"


def test_normalizer(spark):
    assert column(spark, T.normalizer([("aa", "a"), ("ab", "c")]), ["aaaab", "xab", None, ""]) == ["ac", "xc", None, ""]
    with pytest.raises(ValueError):
        T.normalizer([("a", "bb")])
    with pytest.raises(ValueError):
        T.rewritten("a", [("b", "c"), ("a", "b"), ("c", "a")])


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="あいうえおかこきゃょうっンんーとくぐ゛゜マバ漢アッサシチツ", max_size=8))
def test_spoken_phrases_against_all_phrases(run):
    """The search for readings that contract finds what a filter over all phrases finds."""
    import re

    from sonolex.operators import tokenize as tk

    units = [(m.start(), m.group()) for m in re.finditer(f"[^{tk._MARKS}][{tk._MARKS}]*", run)]
    kana, romaji = [], []
    for i in range(len(units)):
        for j in range(i, len(units)):
            said = "".join(tk._kana_of(u) for _, u in units[i : j + 1])
            if tk._IS_KANA.fullmatch(said):
                n = units[j][0] + len(units[j][1]) - units[i][0]
                kana.append((units[i][0], n, said))
                romaji.append((units[i][0], n, phonetics.romaji_of(said)))
    assert sorted(tk._sounds(run, [])) == sorted([(tk.KANA, *r) for r in atomic(kana)] + [(tk.ROMAJI, *r) for r in atomic(romaji)])


def test_grafted_trie():
    from sonolex.operators import index as ix

    tokens = [(0, "sya"), (1, "tu"), (2, "o"), (3, "sa"), (4, "kanbe")]
    root = ix.graft(ix.trie(tokens), T.ROMAJI_RULES)
    for text, token in (("sha", 0), ("tsu", 1), ("ou", 2), ("oo", 2), ("o-", 2), ("saa", 3), ("kambe", 4), ("syaa", 0), ("s-ha", 0)):
        assert ix.accepted(root, text) == {token}
    assert ix.accepted(root, "x") == set() and ix.accepted(root, "s", below=True) == {0, 3}
    data = ix.serialize_trie(root)
    assert ix.deserialize_trie(data) == {t: x for t, x in tokens}
    again = ix.read_trie(data)
    assert ix.serialize_trie(again) == data and ix.accepted(again, "sha") == {0} and ix.accepted(again, "kambe") == {4}
    assert ix.serialize_trie([(0, "ab"), (1, "a")]) == [0, 97, 2, 0, 1, 98, 3, -2, 2, -1]
    with pytest.raises(ValueError):
        ix.graft(ix.trie([(0, "a"), (1, "aa")]), [("aa", "a")])
    with pytest.raises(ValueError):
        ix.graft(ix.trie([(0, "a")]), [("a", "bb")])


def test_atomic():
    rows = [(0, 1, "キョ"), (1, 1, "ウ"), (0, 2, "キョウ"), (0, 2, "コンニチ"), (0, 1, "コン"), (1, 1, "ニチ"), (0, 2, "アス")]
    assert (0, 2, "アス") in atomic(rows)
    assert (0, 2, "キョウ") not in atomic(rows) and (0, 2, "コンニチ") not in atomic(rows)


@pytest.mark.parametrize("tokens", [[(0, "apple"), (1, "app"), (2, "banana")], [(0, "")], [], [(5, "あ"), (6, "あい"), (7, "あ")]])
def test_trie_round_trip(tokens):
    from sonolex.operators.index import deserialize_trie, serialize_trie

    assert deserialize_trie(serialize_trie(tokens)) == dict(tokens)
