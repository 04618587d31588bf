"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of n-grams (1 to 3 letters, with word borders) by language and hash bucket come from all training rows, summed inside
tasks and then by Spark. The log-probability matrix (``BUCKETS`` x languages, a size that no corpus changes) is broadcast, and
texts are scored in batches: hash all n-grams of a batch at once, gather their matrix rows, sum them by text.

Defined results: ``und`` with score 0 for null texts and texts without a letter, and for all texts if nothing could be learned;
ties go to the first language by name; repeated rows count each; an empty table gives an empty result; other columns are
ignored. The score is the posterior probability of the language that is predicted.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import mix, pieces, prepare

BUCKETS, GRAMS, LANGUAGES = 1 << 16, (1, 2, 3), 1000
HELD = 64  # languages that a task counts before it hands on what it has


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def gram_buckets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams, text by text, and the n + 1 borders. Non-letters stand for word borders."""
    joined = [(t or "").lower() for t in texts]
    size = np.array([len(t) + 2 for t in joined])
    raw = "".join([f" {t} " for t in joined]).encode("utf-32-le", "surrogatepass")
    chars = np.frombuffer(raw, "<u4").astype(np.int64)
    chars = np.where(_letters()[chars], chars, 0)
    text = np.repeat(np.arange(len(joined)), size)
    out, owner = [], []
    for n in GRAMS:
        if len(chars) < n:
            continue
        m = len(chars) - n + 1
        key, some = np.full(m, np.uint64(n)), np.zeros(m, bool)
        for i in range(n):
            part = chars[i : i + m]
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + part.astype(np.uint64))
            some |= part > 0
        some &= text[:m] == text[n - 1 :]
        if n > 1:
            some &= (chars[:m] > 0) | (chars[1 : m + 1] > 0)
        out.append((key[some] % np.uint64(BUCKETS)).astype(np.int32))
        owner.append(text[:m][some])
    owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)
    order = np.argsort(owner, kind="stable")
    return (np.concatenate(out) if out else np.zeros(0, np.int32))[order], np.searchsorted(owner[order], np.arange(len(joined) + 1))


def _count(batches):
    counts: dict[str, np.ndarray] = {}
    for part in pieces(batches, 1 << 20):
        langs = part.column("lang").to_pylist()
        buckets, edge = gram_buckets(part.column("text").to_pylist())
        code = {x: i for i, x in enumerate(sorted(set(langs)))}
        own = np.repeat([code[x] for x in langs], np.diff(edge))
        seen = np.bincount(own * BUCKETS + buckets, minlength=len(code) * BUCKETS).reshape(len(code), BUCKETS)
        for x, i in code.items():
            counts[x] = counts.get(x, 0) + seen[i]
        if len(counts) > HELD:
            yield from _rows(counts)
            counts.clear()
    yield from _rows(counts)


def _rows(counts):
    for x, seen in counts.items():
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(seen[at], pa.int64())], ["lang", "bucket", "n"])


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", smooth: float = 0.5) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities [bucket, language]) from every labelled row; no more than ``LANGUAGES`` languages."""
    prepare(labelled.sparkSession)
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    if rows.select("lang").distinct().limit(LANGUAGES + 1).count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    counts = rows.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counts.toArrow()
    langs = sorted(set(table["lang"].to_pylist()))
    seen = np.full((BUCKETS, len(langs)), smooth)
    code = {x: i for i, x in enumerate(langs)}
    seen[table["bucket"].to_numpy(), [code[x] for x in table["lang"].to_pylist()]] += table["n"].to_numpy()
    return langs, np.log(seen / seen.sum(0)).astype(np.float32)


def _predict(shared):
    def run(batches):
        langs, logs = shared.value
        for part in pieces(batches, 1 << 20):
            texts = part.column("text").to_pylist()
            buckets, edge = gram_buckets(texts)
            pred, score = ["und"] * len(texts), np.zeros(len(texts))
            full = np.flatnonzero(np.diff(edge))
            if len(langs) and len(full):
                total = np.stack([np.add.reduceat(logs[:, i][buckets].astype(np.float64), edge[:-1][full]) for i in range(len(langs))], 1)
                best = total.argmax(1)
                score[full] = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
                for i, b in zip(full, best):
                    pred[i] = langs[b]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("held_out"), pa.array(pred, pa.string()), pa.array(score)], ["id", "held_out", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", held_out=None) -> DataFrame:
    """(id, held_out, lang_pred, score) of every text."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(id_col).alias("id"), (F.lit(False) if held_out is None else held_out).alias("held_out"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    shared = spark.sparkContext.broadcast(model)
    return rows.mapInArrow(_predict(shared), f"id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)


def op6_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return predict(docs, train(docs.where(~held)), held_out=held)
