"""Texts that nothing is asked of aren't shuffled."""

import random

import pytest
from pyspark.sql import functions as F

from sonolex.llm import common, minhash, suffixtree

rng = random.Random(5)
TEXTS = [" ".join(f"{rng.getrandbits(60):x}" for _ in range(600)) for _ in range(300)]


def shuffled(spark, run):
    """Bytes that the stages of run() write to shuffles."""
    sc = spark.sparkContext
    jvm, store = sc._jvm, sc._jsc.sc().statusStore()

    def total():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = total()
    run()
    return total() - before


@pytest.mark.parametrize("run, most", [(minhash.without_near_duplicates, 0.5), (suffixtree.remove_repeated_passages, 1.6)])
def test_texts_stay_where_they_are(spark, run, most):
    rows = list(enumerate(TEXTS + [TEXTS[0] + " more", TEXTS[1] + " more"]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert shuffled(spark, lambda: run(docs).write.format("noop").mode("overwrite").save()) < most * sum(map(len, TEXTS))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("most", [1 << 14, 0])
def test_among(spark, monkeypatch, most):
    monkeypatch.setattr(common, "BITMAPS", most)
    numbers = [0, 1, 7, 8, 32766, 32767, 32768, 32769, 1 << 33, (1 << 33) + 1, (5 << 33) + 40_000, None]
    rows = spark.createDataFrame([(n, str(n)) for n in numbers + [8]], f"{common.KEY} long, `a.b` string")
    scratch = common.Scratch(spark, "test")
    for chosen in ([], [0], [1, 8, 8, 32767], [7, 32768, 1 << 33], numbers[:-1]):
        ids = spark.createDataFrame([(n,) for n in chosen], f"{common.KEY} long")
        found, rest = (sorted(x["a.b"] for x in part.collect()) for part in common.among(rows, ids, scratch, "bits"))
        assert found == sorted(str(n) for n in numbers + [8] if n in chosen)
        assert rest == sorted(str(n) for n in numbers + [8] if n not in chosen)
