"""Exact byte-level dedup with suffix arrays over a prefix-free parse.

Texts that may share ``window`` bytes meet in groups that fit in memory (``repeats``). A group's slices are parsed into
phrases: a rolling hash of ``TRIGGER`` bytes that is 0 modulo ``PERIOD`` ends a phrase and begins the next, so phrases
overlap by a trigger and no phrase's rest is a prefix of another's. Highly repetitive text has few distinct phrases (the
dictionary) and a short parse.

* The dictionary's suffixes are sorted by their bytes, to the phrase's end or the window's (prefix doubling from 8 bytes on, going
  on only with what is still tied).
* The parse's suffixes are sorted by their phrases' ranks, with the bytes that neighbours have in common.
* The group's suffixes come in the order of (what is left of the phrase, parse that follows). Neighbours agree in as many bytes as the
  rest of the phrase has and the parse's suffixes have in common (a range minimum); where those are ``window`` or more, both places
  are repeats. Bytes are compared, not hashes of them.

Anchors with more than ``repeats.HOT`` slices are settled before by counting windows under longer and longer prefixes (``repeats``).

Defined results: null and empty texts have no bytes and lose nothing; texts shorter than a window lose nothing; repeated
rows, ids or not, are texts of their own and repeat each other, one row out for each; removed bytes may split a character, so what is
kept is binary; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bytes_of, joined, mix, pieces
from .repeats import removed_units, repeats

WINDOW, GRAM = 200, 32
TRIGGER, PERIOD = 8, 32


def eights(data: np.ndarray, order: str = "<") -> np.ndarray:
    """The 8 bytes from each position as a number; behind the end there are zeros."""
    held = np.zeros(len(data) + 8, np.uint8)
    held[: len(data)] = data
    return np.ndarray(len(data), f"{order}u8", held.tobytes(), strides=(1,)).astype(np.uint64)


def _grams(data: np.ndarray) -> np.ndarray:
    """Hashes of the GRAM (32) bytes from each position; 0 where fewer are left."""
    out = np.zeros(len(data), np.uint64)
    if len(data) >= GRAM:
        x = mix(eights(data))
        x = joined(x[:-8], x[8:])
        x = joined(x[:-16], x[16:])
        out[: len(data) - GRAM + 1] = x[: len(data) - GRAM + 1]
    return out


def _units(data, offsets):
    at = np.arange(len(data))
    return data, _grams(data), at, at + 1, offsets


def parse(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where phrases begin: the begin of each text and each trigger."""
    begin = (mix(eights(data)) % np.uint64(PERIOD)) == 0
    inside = np.zeros(len(data) + 1, bool)
    for back in range(1, TRIGGER):  # a trigger may not run over a text's end
        at = offsets[1:] - back
        inside[at[at >= 0]] = True
    begin &= ~inside[: len(data)]
    begin[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(begin)


def dictionary_ranks(data: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of all suffixes of the dictionary's phrases by their first ``depth`` bytes, or fewer where the phrase ends (``left`` bytes
    on); equal ones share a rank."""
    if not len(data):
        return np.zeros(0, np.int64)
    first = eights(data, ">")
    over = left < 8
    first[over] &= ~(np.uint64(0xFFFFFFFFFFFFFFFF) >> (left[over].astype(np.uint64) * np.uint64(8)))  # nothing of the next phrase
    name = np.unique(first, return_inverse=True)[1]
    name, many = np.unique(name * 9 + np.minimum(left, 8), return_inverse=True, return_counts=True)[1:]
    rank = (np.cumsum(many) - many)[name]  # a group's rank is its first place
    have = 8
    tied = np.flatnonzero((many[name] > 1) & (left > have))
    while len(tied) and have < depth:
        step = min(have, depth - have)
        key = (rank[tied] << 32) | rank[tied + step]
        order = np.argsort(key, kind="stable")
        key, at = key[order], np.arange(len(tied))
        old, new = np.ones(len(tied), bool), np.ones(len(tied), bool)
        new[1:] = key[1:] != key[:-1]
        old[1:] = (key[1:] >> 32) != (key[:-1] >> 32)
        start = np.maximum.accumulate(np.where(new, at, 0))
        tied = tied[order]
        rank[tied] = (key >> 32) + start - np.maximum.accumulate(np.where(old, at, 0))
        edge = np.flatnonzero(new)
        have += step
        tied = tied[(np.repeat(np.diff(np.append(edge, len(at))), np.diff(np.append(edge, len(at)))) > 1) & (left[tied] > have)]
    return rank


def parse_ranks(phrase: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Ranks of the parse's suffixes by their phrases' ranks (a suffix array's inverse); a text's end comes first. phrase: from 1."""
    n = len(phrase)
    rank, step = np.unique(phrase, return_inverse=True)[1] + 1 if n else phrase, 1
    while step < n and rank.max() < n:
        nxt = np.zeros(n, np.int64)
        same = text[step:] == text[:-step]
        if not same.any():
            break
        nxt[:-step][same] = rank[step:][same]
        new = np.unique(rank * (n + 2) + nxt, return_inverse=True)[1] + 1
        if new.max() == rank.max():
            break
        rank, step = new, step * 2
    return rank


def common_bytes(words8: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many bytes the suffixes at a and b have in common, ``most`` at most."""
    out, open_ = np.zeros(len(a), np.int64), np.flatnonzero(most > 0)
    while len(open_):
        at = out[open_]
        differ = words8[a[open_] + at] ^ words8[b[open_] + at]
        low = differ & (~differ + np.uint64(1))
        step = np.where(differ == 0, 8, np.searchsorted(np.uint64(1) << np.arange(8, 64, 8, dtype=np.uint64), low, "right"))
        out[open_] = np.minimum(at + step, most[open_])
        open_ = open_[(step == 8) & (out[open_] < most[open_])]
    return out


class Minimum:
    """Range minima of an array (a sparse table)."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        while 2 ** len(self.rows) <= len(values):
            half, last = 2 ** (len(self.rows) - 1), self.rows[-1]
            self.rows.append(np.minimum(last[:-half], last[half:]))

    def over(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """min(values[low : high]); low < high."""
        out, level = np.empty(len(low), np.int64), np.log2(high - low).astype(np.int64)
        for k in np.unique(level).tolist():
            i = np.flatnonzero(level == k)
            out[i] = np.minimum(self.rows[k][low[i]], self.rows[k][high[i] - 2**k])
        return out


def repeated(data: np.ndarray, offsets: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """For each place: do its ``window`` bytes (all of one text) start at another of the places too?"""
    many = np.zeros(len(at), bool)
    if len(at) < 2:
        return many
    begin = parse(data, offsets)
    text = np.searchsorted(offsets, begin, "right") - 1
    text_end = offsets[1:][text]
    border = np.append(begin[1:], len(data))  # where the next phrase begins, or the text's end
    inner = border < text_end
    end = np.where(inner, border + TRIGGER, text_end)
    # the dictionary: distinct phrases in the order of their bytes
    raw = data.tobytes()
    held = [raw[a:b] for a, b in zip(begin.tolist(), end.tolist())]
    listed = sorted(set(held))
    place = {p: i for i, p in enumerate(listed)}
    phrase = np.array([place[p] for p in held], np.int64)
    size = np.array([len(p) for p in listed], np.int64)
    start = np.cumsum(size) - size
    left = np.repeat(start + size, size) - np.arange(size.sum())
    rest_rank = dictionary_ranks(np.frombuffer(b"".join(listed), np.uint8), left, window)
    # the parse: its suffixes in order, and what neighbours have in common
    rank = parse_ranks(phrase + 1, text)
    order = np.argsort(rank, kind="stable")
    where = np.empty(len(order), np.int64)
    where[order] = np.arange(len(order))
    upper, lower = order[:-1], order[1:]
    reach = np.minimum(np.minimum(text_end[upper] - begin[upper], text_end[lower] - begin[lower]), window)
    held8 = eights(np.concatenate([data, np.zeros(window + 8, np.uint8)]))
    shared = Minimum(np.concatenate([[0], common_bytes(held8, begin[upper], begin[lower], reach)]))
    # both together: the order of the group's suffixes
    own = np.searchsorted(begin, at, "right") - 1
    rest = rest_rank[start[phrase[own]] + at - begin[own]]
    need = window - (border[own] - at)  # bytes of the parse that follows
    inside = inner[own] & (end[own] - at <= window)  # else the window lies in the phrase
    follow = np.where(inside, where[np.minimum(own + 1, len(begin) - 1)], 0)
    line = np.lexsort((follow, rest))
    a, b = line[:-1], line[1:]
    equal = rest[a] == rest[b]
    ask = np.flatnonzero(equal & inside[a] & (follow[a] != follow[b]))
    equal[ask] = shared.over(follow[a[ask]] + 1, follow[b[ask]] + 1) >= need[a[ask]]
    many[a[equal]] = True
    many[b[equal]] = True
    return many


def _solver(window: int):
    def solve(data, offsets, cnt):
        total = int(cnt.sum())
        at = np.repeat(offsets[:-1], cnt) + np.arange(total) - np.repeat(np.cumsum(cnt) - cnt, cnt)
        return repeated(data, offsets, at, window)

    return solve


def _kept(batches):
    for part in pieces(batches, 1 << 20):
        data, offsets = bytes_of(part.column("text"))
        gone = removed_units(part.column("whole").to_numpy(zero_copy_only=False).astype(bool), part.column("spans"), offsets)
        flag = np.concatenate([[0], np.cumsum(gone)])
        lost = flag[offsets[1:]] - flag[offsets[:-1]]
        rise = gone.copy()
        rise[1:] &= ~gone[:-1]
        edge = offsets[:-1][(np.diff(offsets) > 0)]
        rise[edge] = gone[edge]
        runs = np.concatenate([[0], np.cumsum(rise)])
        left = np.ascontiguousarray(data[~gone]).tobytes()
        kept = np.concatenate([[0], np.cumsum(np.diff(offsets) - lost)])
        body = [left[a:b] for a, b in zip(kept[:-1].tolist(), kept[1:].tolist())]
        yield pa.RecordBatch.from_arrays(
            [part.column("own"), pa.array(np.diff(offsets), pa.int64()), pa.array(lost, pa.int64()), pa.array(runs[offsets[1:]] - runs[offsets[:-1]], pa.int64()), pa.array(body, pa.binary())],
            ["own", "n_bytes", "n_removed", "n_spans", "kept"],
        )


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept): UTF-8 bytes without those that a repeated ``window``-byte string covers."""
    if window < 2 * GRAM:
        raise ValueError(f"window must be {2 * GRAM} or more")
    docs = docs.select(F.col(id_col).cast("long").alias("own"), F.col(text_col).alias("text"))
    marked = repeats(docs, _units, _solver(window), window, GRAM, "pfp").drop("id")
    return marked.mapInArrow(_kept, "own long, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed("own", id_col)


def op9_pfp(spark, sf_dir: str) -> DataFrame:
    out = remove_repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
