"""Reading, pinyin and variant dictionaries as DataFrames, and the variant classes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

#: A small sample; an application brings its own tables of the same shape.
KANA = "僕 ボク 和 ワ 風 フウ 本 ホン 当 トウ 上 ジョウ 手 シュ 手 テ 今 コン 今 イマ 日 ニチ 日 ヒ 今日 キョウ 和風 ワフウ 宵 ヨイ 鳥 トリ 世界 セカイ 希望 キボウ 涙 ナミダ 添 ソ 本当 ホントウ 上手 ジョウズ"
PINYIN = "僕 pu 和 he 風 feng 风 feng 本 ben 当 dang 當 dang 上 shang 手 shou 今 jin 日 ri 中 zhong 行 xing 行 hang 国 guo 國 guo 你 ni 好 hao 世 shi 界 jie 宵 xiao 鳥 niao 鸟 niao"
VARIANTS = "国 國 风 風 当 當 鸟 鳥 泪 涙 淚 涙"


@dataclass
class Dictionaries:
    """kana_readings (surface, reading), pinyin_readings (ch, reading), han_variants (ch, variant)."""

    kana_readings: DataFrame
    pinyin_readings: DataFrame
    han_variants: DataFrame

    @cached_property
    def longest(self) -> int:
        """Characters of the longest surface: the dictionary is static, so it is asked once."""
        return self.kana_readings.agg(F.max(F.length("surface"))).first()[0] or 0


def _pairs(spark: SparkSession, text: str, names: str) -> DataFrame:
    words = text.split()
    return spark.createDataFrame(list(zip(words[::2], words[1::2])), ", ".join(f"{n} string" for n in names.split()))


def sample(spark: SparkSession) -> Dictionaries:
    return Dictionaries(_pairs(spark, KANA, "surface reading"), _pairs(spark, PINYIN, "ch reading"), variant_classes(_pairs(spark, VARIANTS, "from_ch to_ch")))


def empty(spark: SparkSession) -> Dictionaries:
    make = lambda names: spark.createDataFrame([], ", ".join(f"{n} string" for n in names.split()))
    return Dictionaries(make("surface reading"), make("ch reading"), make("ch variant"))


def variant_classes(pairs: DataFrame) -> DataFrame:
    """Connected components of single-character pairs, as (ch, variant) for every two of a class, itself included.

    Pairs of longer strings are ignored. The pairs are characters of a script, some ten thousand at most, so the driver joins them.
    """
    one = pairs.where((F.length("from_ch") == 1) & (F.length("to_ch") == 1)).distinct()
    root: dict[str, str] = {}

    def find(ch: str) -> str:
        root.setdefault(ch, ch)
        while root[ch] != ch:
            root[ch] = root[root[ch]]
            ch = root[ch]
        return ch

    for r in one.select("from_ch", "to_ch").collect():
        a, b = sorted((find(r["from_ch"]), find(r["to_ch"])))
        root[b] = a
    label = pairs.sparkSession.createDataFrame([(ch, find(ch)) for ch in sorted(root)], "ch string, root string")
    return label.join(label.select(F.col("ch").alias("variant"), "root"), "root").select("ch", "variant")


def variant_lists(classes: DataFrame) -> DataFrame:
    """(ch, variants): each character's class as a list in the order of code points."""
    return classes.groupBy("ch").agg(F.array_sort(F.collect_set("variant")).alias("variants"))
