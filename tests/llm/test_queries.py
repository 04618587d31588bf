"""The registered queries themselves, on the smallest given tables: against their SQL, or against brute force where SQL can't say it."""

import collections
import hashlib
import itertools
import zlib

import duckdb
import numpy as np
import pytest

from sonolex.llm import registry, tokens

SF = "/root/testdata/sf0.001"


def table(name, *columns):
    return duckdb.sql(f"select {', '.join(columns)} from '{SF}/{name}.parquet'").fetchall()


def rows(spark, query, *columns):
    return [tuple(r) for r in registry.queries()[query](spark, SF).select(*columns).collect()]


@pytest.mark.parametrize("query", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, query):
    db = duckdb.connect()
    for name in ("documents", "benchmark", "pages", "labels"):
        db.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    want = db.execute(registry.oracle_sql()[query])
    names = [d[0] for d in want.description]
    plain = lambda r: tuple(round(x, 5) if isinstance(x, float) else x for x in r)
    assert sorted(map(plain, rows(spark, query, *names))) == sorted(map(plain, want.fetchall()))


@pytest.fixture(scope="module")
def encoded():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer())
    return {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4") for i, x in table("documents", "doc_id", "text")}


def test_packing_query(spark, encoded):
    bins, seen = collections.defaultdict(list), collections.Counter()
    for doc, piece, start, length, crc, sequence, offset in rows(spark, "op3_packing", "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"):
        own = encoded[doc]
        assert zlib.crc32(own[start : start + length].tobytes()) == crc
        assert length == 2048 or piece == 0 and length == (len(own) - 1) % 2048 + 1
        bins[sequence].append((offset, length))
        seen[doc] += length
    assert seen == {i: len(x) for i, x in encoded.items()}
    for held in bins.values():
        held.sort()
        assert [a for a, _ in held] == [0, *itertools.accumulate(n for _, n in held)][:-1] and sum(n for _, n in held) <= 2048
    assert len(bins) <= 1.02 * -(-sum(seen.values()) // 2048) + 1


def test_token_file_query(spark, encoded):
    at, want = 0, []
    for i in sorted(encoded):
        want.append((i, at, len(encoded[i]), zlib.crc32(encoded[i].tobytes())))
        at += len(encoded[i])
    assert sorted(rows(spark, "op7_repair", "doc_id", "start", "n_tokens", "ids_crc32")) == want


def test_byte_dedup_query(spark):
    texts = {i: (x or "").encode() for i, x in table("documents", "doc_id", "text")}
    count = collections.Counter(t[j : j + 200] for t in texts.values() for j in range(len(t) - 199))
    want = []
    for i, t in texts.items():
        gone = np.zeros(len(t) + 1, np.int64)
        for j in range(len(t) - 199):
            if count[t[j : j + 200]] > 1:
                gone[j] += 1
                gone[j + 200] -= 1
        flag = np.cumsum(gone)[: len(t)] > 0
        spans = int((np.diff(np.concatenate([[0], flag.astype(int)])) == 1).sum())
        want.append((i, len(t), int(flag.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(t, flag) if not g)).hexdigest()))
    assert sorted(rows(spark, "op9_pfp", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) == sorted(want)


def test_decontamination_query(spark):
    """Documents that hold an item's words in order are found; those that share no eight words in order with an item aren't."""
    words = lambda t: [w.strip(".,;:!?\"'()") for w in (t or "").lower().split()]
    items = {i: words(x) for i, x in table("benchmark", "item_id", "text")}
    docs = {i: words(x) for i, x in table("documents", "doc_id", "text")}
    grams = lambda w: {tuple(w[j : j + 8]) for j in range(len(w) - 7)}
    held = {i: grams(w) for i, w in docs.items()}
    asked = {i: grams(w) for i, w in items.items()}
    found = set(rows(spark, "op10_decontaminate", "doc_id", "item_id"))
    whole = {(d, i) for d, g in held.items() for i, a in asked.items() if a and a <= g}
    some = {(d, i) for d, g in held.items() for i, a in asked.items() if a & g}
    assert whole and whole <= found <= some


def test_pipeline_stages_keep_clean_documents(spark):
    """No clean document without a near copy goes in the stages that drop documents."""
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toxic = {i for i, y in table("labels", "doc_id", "toxic") if y}
    left = {r["doc_id"] for r in P.STAGES[0][1](spark, docs, SF).select("doc_id").collect()}
    every = {r["doc_id"] for r in docs.select("doc_id").collect()}
    labelled = {i for i, y in table("labels", "doc_id", "toxic")}
    assert len((every - left) & labelled - toxic) <= 1
