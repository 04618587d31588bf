"""Exact substring dedup over words with prefix-partitioned suffix trees.

Suffixes are split by a variable-length prefix, the words up to and with their anchor gram (``repeats``): all suffixes under one
prefix come to one group, and groups fit in memory. A group's suffix tree is held as a suffix array with the words that neighbours have in
common (``SuffixTree``); an internal node is an interval of it whose neighbours all agree in the node's depth. A suffix whose deepest internal
node is ``window`` words deep or more starts a maximal repeat, and every window that begins in the repeat is one too. Where
one prefix has more than ``repeats.HOT`` slices, it is made longer, at last as long as the window itself; then the prefix is the tree's
node, and counting its suffixes tells whether it is an inner one.

Defined results: null and empty texts have no words; texts shorter than a window lose nothing; repeated rows, with or without an
id, count as one text each, so they repeat each other, and give one row each; an empty table gives an empty result; other
columns are ignored. Words are compared by 64-bit hashes (tabulation), windows word by word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bytes_of, doubled, pieces, words
from .repeats import removed_units, repeats

WINDOW, GRAM = 35, 8


def _units(data, offsets):
    starts, ends, hashed, border = words(data, offsets)
    grams = np.zeros(len(hashed), np.uint64)
    grams[: max(0, len(hashed) - GRAM + 1)] = doubled(hashed, GRAM)
    return hashed, grams, starts, ends, border


def _named(*names: np.ndarray) -> np.ndarray:
    """Names of tuples, in their order."""
    key = names[0]
    for x in names[1:]:
        many = int(x.max(initial=0)) + 1
        if (int(key.max(initial=0)) + 1) * many >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
        key = key * many + x
    return np.unique(key, return_inverse=True)[1]


class SuffixTree:
    """The suffix tree of token sequences, down to 81 tokens, as a suffix array and the lengths that neighbours share.

    Names of the substrings of 1, 3, 9, 27 and 81 tokens, in their order, come from triples of the names before; a name is a place in the
    tree. Sequences end with tokens of their own, so no node runs over an end."""

    def __init__(self, tokens: np.ndarray, border: np.ndarray):
        n, many = len(tokens), len(border) - 1
        self.at = np.arange(n) + np.repeat(np.arange(many), np.diff(border))  # where a token stands among the ends
        kinds, name = np.unique(tokens, return_inverse=True)
        held = np.zeros(n + many + 1, np.int64)
        held[self.at] = name
        held[border[1:] + np.arange(many)] = len(kinds) + np.arange(many)
        held[-1] = len(kinds) + many
        self.levels = [(1, held)]
        for size in (3, 9, 27, 81):
            last = self.levels[-1][1]
            far = [np.concatenate([last[k:], np.repeat(last[-1:], min(k, len(last)))]) for k in (size // 3, 2 * size // 3)]
            self.levels.append((size, _named(last, *far)))
        self.order = np.argsort(self.levels[-1][1][self.at], kind="stable")  # of the tokens' own suffixes

    def shared(self) -> np.ndarray:
        """How many tokens each suffix has in common with the one before it in the order; 81 and more count as 81."""
        here = self.at[self.order]
        a, b = here[:-1], here[1:]
        out = np.zeros(len(a), np.int64)
        for size, name in reversed(self.levels):
            for _ in range(2 if size < 81 else 1):
                x, y = np.minimum(a + out, len(name) - 1), np.minimum(b + out, len(name) - 1)
                out += size * ((name[x] == name[y]) & (x != y) & (out < 81))
        return np.concatenate([[0], np.minimum(out, 81)])[: len(here)]

    def depth(self) -> np.ndarray:
        """For each token: the depth of the deepest internal node above the suffix that starts there."""
        shared = self.shared()
        out = np.empty(len(shared), np.int64)
        out[self.order] = np.maximum(shared, np.append(shared[1:], 0))
        return out

    def nodes(self, least: int) -> list[tuple[int, np.ndarray]]:
        """(depth, places) of every internal node of ``least`` tokens or more: its suffixes' places."""
        shared, out, open_ = self.shared().tolist(), [], []
        for i, depth in enumerate([*shared[1:], 0]):
            start = i
            while open_ and open_[-1][0] > depth:
                d, start = open_.pop()
                out.append((d, np.sort(self.order[start : i + 1])))
            if depth >= least and (not open_ or open_[-1][0] < depth):
                open_.append((depth, start))
        return out


def _solver(window: int):
    def solve(data, offsets, cnt):
        _, _, hashed, border = words(data, offsets)
        total = int(cnt.sum())
        at = np.repeat(border[:-1], cnt) + np.arange(total) - np.repeat(np.cumsum(cnt) - cnt, cnt)
        # slices of one text may overlap, but no window of a group is in two of them
        return SuffixTree(hashed, border).depth()[at] >= window

    return solve


def _kept(batches, all_texts=True):
    for part in pieces(batches, 1 << 20):
        data, offsets = bytes_of(part.column("text"))
        starts, ends, _, border = words(data, offsets)
        gone = removed_units(part.column("whole").to_numpy(zero_copy_only=False).astype(bool), part.column("spans"), border)
        raw, texts = data.tobytes(), []
        sums = np.concatenate([[0], np.cumsum(gone)])
        lost = sums[border[1:]] - sums[border[:-1]]
        for i in range(part.num_rows):
            a, b = border[i], border[i + 1]
            if not lost[i]:
                own = raw[offsets[i] : offsets[i + 1]]
                texts.append(b" ".join(own.split()) if all_texts else own)
            else:
                keep = np.flatnonzero(~gone[a:b]) + a
                texts.append(b" ".join([raw[x:y] for x, y in zip(starts[keep].tolist(), ends[keep].tolist())]))
        rest = [c for c in part.schema.names if c.startswith("rest_")]
        yield pa.RecordBatch.from_arrays(
            [part.column("own"), pa.array(np.diff(border), pa.int64()), pa.array(lost, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()), *[part.column(c) for c in rest]],
            ["own", "n_words", "n_removed", "kept", *rest],
        )


def remove_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, carry: list[str] | None = None, all_texts: bool = True) -> DataFrame:
    """(id, n_words, n_removed, kept, carried columns): texts without the words that a repeated window covers.

    Kept words are joined by one space; with all_texts=False a text that loses nothing stays as it is.
    """
    if not GRAM <= window <= 81:
        raise ValueError(f"window must be {GRAM} to 81")
    carry = carry or []
    rest = [F.col(f"`{c}`").alias(f"rest_{i}") for i, c in enumerate(carry)]
    docs = docs.select(F.col(id_col).cast("long").alias("own"), F.col(text_col).alias("text"), *rest)
    marked = repeats(docs, _units, _solver(window), window, GRAM, "suffixtree").drop("id")
    kinds = "".join(f", rest_{i} {docs.schema[f'rest_{i}'].dataType.simpleString()}" for i in range(len(carry)))
    out = marked.mapInArrow(lambda b: _kept(b, all_texts), "own long, n_words long, n_removed long, kept string" + kinds)
    return out.select(F.col("own").alias(id_col), "n_words", "n_removed", "kept", *[F.col(f"rest_{i}").alias(c) for i, c in enumerate(carry)])


def op4_substring(spark, sf_dir: str) -> DataFrame:
    out = remove_repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []::VARCHAR[]) AS ws FROM documents),
g AS (
  SELECT doc_id, i, md5(array_to_string(ws[i : i + 34], ' ')) AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)
), r AS (SELECT doc_id, i FROM g WHERE k IN (SELECT k FROM g GROUP BY k HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM r),
l AS (SELECT doc_id, list(j) AS js, count(*) AS n FROM gone GROUP BY doc_id),
k AS (
  SELECT w.doc_id, len(ws) AS n_words, coalesce(l.n, 0) AS n_removed, CASE WHEN l.n IS NULL THEN ws END AS whole
  FROM w LEFT JOIN l USING (doc_id)
), e AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS j FROM w WHERE doc_id IN (SELECT doc_id FROM l)),
t AS (SELECT e.doc_id, string_agg(x, ' ' ORDER BY e.j) AS t FROM e ANTI JOIN gone USING (doc_id, j) GROUP BY e.doc_id)
SELECT k.doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed,
  sha256(coalesce(t.t, array_to_string(whole, ' '), '')) AS kept_sha256
FROM k LEFT JOIN t USING (doc_id)
"""
