"""Benchmark decontamination by template canonicalisation.

Words lose the punctuation around them and are folded to lower case; numbers, units behind them and names (capitalised inside
a sentence) become typed placeholders. Windows of ``WINDOW`` such tokens of the documents are looked up among those of the
benchmark by hash; items of fewer than 2 * WINDOW + 1 tokens, where one changed word could hit every window, have windows of 3 or 4
tokens. Hits that follow one another on one diagonal (the same shift between document and item) make a run; runs of a document
and item are chained in order, over shifts that differ by at most ``SLACK``, so that inserted, deleted and changed words cost only
what no window covers. The item is found where a chain covers at least ``COVERAGE`` of its tokens (``needed`` has more for short items)
and its slots are consistent: each filler of the item stands for one filler of the document wherever it returns, so that a question
with other numbers or names is caught, and a chance meeting of templates isn't. A slot at the inner border of a run isn't held
to that, as its filler may go on beyond the border ("Anna Maria" for "Anna").

Items of fewer than ``WINDOW`` tokens have to be found with their own fillers, as one window: a template of a few words, or of a number
alone, would be met in any text.

The benchmark's window hashes are broadcast while there are at most ``BROADCAST`` of them, else a bitmap of 8 MB; hits are joined by hash.

Defined results: null and empty texts hold nothing; null and empty items are never found; rows without an id and rows that repeat one are
documents of their own, found each; items are told apart by their texts too, and may lack an id; an empty table (documents or benchmark)
gives an empty result; other columns are ignored. Names in a row are one slot.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import KEY, Scratch, bytes_of, joined, keyed, lists, mix, pieces, prepare, span_hashes, words

WINDOW, COVERAGE, BROADCAST, SLACK = 8, 0.5, 2_000_000, 8
NUMBER, UNIT, NAME = np.uint64(1), np.uint64(2), np.uint64(3)
_EDGE = np.zeros(256, bool)
_EDGE[list(b".,;:!?\"'()[]{}<>-_*#&%$/\\|")] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
#: Units that may follow a number.
UNITS = "mm cm m km in ft yd mi mg g kg t lb oz ml l s sec min h hr hours hour minutes minute seconds second days day weeks week months month years year percent dollars dollar euros euro cents cent kmh mph hz khz mhz ghz w kw v a c f k meters metres meter metre kilometers kilometres miles mile grams gram kilograms liters litres liter litre".split()


def _unit_hashes() -> np.ndarray:
    raw = [u.encode() for u in UNITS]
    ends = np.cumsum([len(u) for u in raw])
    return np.sort(span_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(u) for u in raw], ends, True))


def templates(data: np.ndarray, offsets: np.ndarray):
    """Tokens of all texts: template hash, slot type (0: none), filler hash, and the n + 1 borders."""
    starts, ends, _, border = words(data, offsets)
    raw_start, raw_end = starts.copy(), ends.copy()
    if len(starts):  # punctuation around a word: from its first to its last byte that is none
        solid = np.append(np.flatnonzero(~_EDGE[data]), len(data))
        first = np.searchsorted(solid, starts)
        last = np.searchsorted(solid, ends) - 1
        some = (solid[first] < ends) & (last >= first)
        starts, ends = np.where(some, solid[first], ends), np.where(some, solid[np.maximum(last, 0)] + 1, ends)
    keep = starts < ends
    kept = np.concatenate([[0], np.cumsum(keep)])
    border = kept[border]
    starts, ends, raw_start, raw_end = starts[keep], ends[keep], raw_start[keep], raw_end[keep]
    n = len(starts)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, np.uint64), border
    value = span_hashes(data, starts, ends, True)
    begins = np.zeros(n, bool)
    begins[border[:-1][np.diff(border) > 0]] = True
    stop = np.isin(data[raw_end - 1], list(b".!?:")) | (data[np.minimum(raw_end, len(data) - 1)] == 10)
    begins[1:] |= stop[:-1]
    first, second = data[starts], data[np.minimum(starts + 1, len(data) - 1)]
    upper = ((first >= 65) & (first <= 90)) | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    alphas = np.concatenate([[0], np.cumsum(_ALPHA[data])])
    number = (digits[ends] > digits[starts]) & (alphas[ends] == alphas[starts])
    slot = np.zeros(n, np.uint8)
    slot[upper & ~begins] = 3
    slot[number] = 1
    units = _unit_hashes()
    at = np.minimum(np.searchsorted(units, value), len(units) - 1)
    unit = units[at] == value
    unit[1:] &= number[:-1]
    unit[0] = False
    slot[unit] = 2
    # names in a row, with nothing but spaces between them, are one
    more = np.zeros(n, bool)
    more[1:] = (slot[1:] == 3) & (slot[:-1] == 3) & (ends[:-1] == raw_end[:-1]) & (starts[1:] == raw_start[1:]) & ~begins[1:]
    if more.any():
        keep, at = np.flatnonzero(~more), np.arange(n)
        place = (at - np.maximum.accumulate(np.where(more, 0, at))).astype(np.uint64)
        long = np.diff(np.append(keep, n)) > 1
        value[keep[long]] = np.add.reduceat(joined(place, value), keep)[long]
        border = np.searchsorted(keep, border)
        value, slot = value[keep], slot[keep]
    return np.where(slot > 0, slot.astype(np.uint64), value), slot, value, border


def window_of(n: np.ndarray) -> np.ndarray:
    """Window size of items with n tokens."""
    return np.select([n < WINDOW, n < WINDOW + 4, n <= 2 * WINDOW], [n, 3, 4], WINDOW)


def needed(n: int, coverage: float = COVERAGE) -> int:
    """Tokens of an item of n that a chain must cover; any single edit leaves as many."""
    return n if n < WINDOW else max(math.ceil(n * coverage), min(n - 3, WINDOW))


class Known:
    """The benchmark's window hashes, for broadcast: all of them up to a number, else a bitmap of a fixed size that knows each and takes some
    others for known too (the join by hash tells them apart)."""

    BITS = 26

    def __init__(self, keys: DataFrame, most: int):
        self.all = self.words = None
        if keys.limit(most + 1).count() <= most:
            self.all = np.sort(keys.toArrow()["h"].to_numpy().view(np.uint64))
            return
        place = F.col("h").bitwiseAND((1 << self.BITS) - 1)
        rows = keys.select(F.shiftright(place, 6).alias("word"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit"))
        rows = rows.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # 2 ** 20 rows of 16 bytes at most
        self.words = np.zeros(1 << (self.BITS - 6), np.uint64)
        self.words[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)

    def has(self, h: np.ndarray) -> np.ndarray:
        if self.words is not None:
            return (self.words[(h & np.uint64((1 << self.BITS) - 1)) >> np.uint64(6)] >> (h & np.uint64(63))) & np.uint64(1) > 0
        if not len(self.all):
            return np.zeros(len(h), bool)
        return self.all[np.minimum(np.searchsorted(self.all, h), len(self.all) - 1)] == h


def _windows(shared, sizes: list[int]):
    """(h, id, own, pos, size, n, v): the windows of the items, each of its item's size; or, of documents, those of every size in ``sizes`` that
    ``shared`` knows. v: filler hashes, 0 outside slots; n: the text's tokens."""

    def run(batches):
        for part in pieces(batches, 1 << 20):
            token, slot, value, border = templates(*bytes_of(part.column("text")))
            count = np.diff(border)
            text = np.repeat(np.arange(part.num_rows), count)
            at = np.arange(len(token)) - border[:-1][text]
            filler = np.where(slot > 0, value | np.uint64(1), np.uint64(0))
            own = np.repeat(window_of(count), count) if shared is None else None
            for size in sizes if own is None else np.unique(own).tolist():
                ok = at + size <= count[text]
                pos = np.flatnonzero(ok if own is None else ok & (own == size))
                h = np.zeros(len(pos), np.uint64)
                for i in range(size):
                    h = mix(h * np.uint64(0x9E3779B97F4A7C15) + token[pos + i])
                if shared is not None:
                    some = shared.value.has(h)
                    pos, h = pos[some], h[some]
                v = np.zeros((len(pos), WINDOW), np.uint64)
                for i in range(size):
                    v[:, i] = filler[pos + i]
                row = pa.array(text[pos])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), part.column("id").take(row), part.column("own").take(row), pa.array(at[pos], pa.int64()), pa.array(np.full(len(pos), size, np.int32)), pa.array(count[text[pos]], pa.int64()), lists(v.ravel().view(np.int64), np.arange(len(pos) + 1) * WINDOW, pa.int64())],
                    ["h", "id", "own", "pos", "size", "n", "v"],
                )

    return run


_ROW = "h long, id long, own long, pos long, size int, n long, v array<long>"


def runs(pos: np.ndarray, ipos: np.ndarray, size: int):
    """Runs of hits: (item start, item end, document start, hit numbers) of hits on one diagonal that overlap or touch."""
    order = np.lexsort((ipos, pos - ipos))
    shift, at = (pos - ipos)[order], ipos[order]
    cut = np.flatnonzero((np.diff(shift) != 0) | (np.diff(at) > size)) + 1
    return [(int(ipos[g[0]]), int(ipos[g[-1]]) + size, int(pos[g[0]]), g) for g in np.split(order, cut)]


def chain(found: list, n: int) -> list[list[int]]:
    """For each run the best chain that ends with it, as numbers of runs: later runs begin and end later in item and document."""
    order = sorted(range(len(found)), key=lambda r: (found[r][2], found[r][0]))
    score, before, first = {}, {}, 0
    for x, r in enumerate(order):
        a, b, d, _ = found[r]
        score[r], before[r] = b - a, None
        while d - found[order[first]][2] > 2 * n + SLACK:  # it can't be within the item and SLACK
            first += 1
        for q in order[first:x]:
            a2, b2, d2, _ = found[q]
            if a2 < a and b2 < b and d2 < d and d2 + b2 - a2 < d + b - a and abs((d - a) - (d2 - a2)) <= SLACK:
                gain = min(b - max(a, b2), d + b - a - max(d, d2 + b2 - a2))
                if score[q] + gain > score[r]:
                    score[r], before[r] = score[q] + gain, q
    out = []
    for r in sorted(score, key=lambda r: (-score[r], r)):
        path = [r]
        while before[path[-1]] is not None:
            path.append(before[path[-1]])
        out.append(path[::-1])
    return out


def settle(pos, ipos, v, iv, size: int, n: int, coverage: float = COVERAGE):
    """(covered tokens, matched windows, literal) of the best consistent chain of one document and item, or None.

    pos, ipos: places of the hits; v, iv: their fillers, WINDOW each."""
    found, best, least = runs(pos, ipos, size), None, needed(n, coverage)
    ways = chain(found, n)
    diagonals: dict[int, list[int]] = {}
    for r, (a, _, d, _) in enumerate(found):
        diagonals.setdefault(d - a, []).append(r)
    for path in [*ways, *diagonals.values(), *([r] for r in range(len(found)))]:
        covered, end, dend = 0, 0, -1
        for r in path:
            a, b, d, _ = found[r]
            covered += max(0, min(b - max(a, end), d + b - a - max(d, dend)))
            end, dend = max(end, b), max(dend, d + b - a)
        if covered < least or best and covered <= best[0]:
            continue
        own: dict[int, int] = {}
        good, literal, matched = True, True, set()
        for r in path:
            a, b, d, g = found[r]
            soft = {a if a > 0 else -1, b - 1 if b < n else -1}
            matched.update(ipos[g].tolist())
            for x in g.tolist():
                for i in range(size):
                    theirs, ours = iv[x * WINDOW + i], v[x * WINDOW + i]
                    if theirs:
                        literal &= bool(theirs == ours)
                        if int(ipos[x]) + i not in soft:
                            good &= own.setdefault(int(theirs), int(ours)) == int(ours)
        if good and (literal or n >= WINDOW):  # a short template alone says little
            best = (covered, len(matched), literal)
    return best


def _chained(coverage: float):
    def run(batches):
        for batch in batches:
            rows = []
            cells = [batch.column(c) for c in ("pos", "ipos", "v", "iv")]
            for x, (i, own, item, size, n, windows) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("id", "own", "item", "size", "n", "windows")))):
                pos, ipos, v, iv = (c[x].values.to_numpy(zero_copy_only=False) for c in cells)
                best = settle(pos, ipos, v, iv, size, n, coverage)
                if best:
                    rows.append((i, own, item, best[1], windows, best[2]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["id", "own", "item", "matched", "windows", "literal"])

    return run


def _found(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, item_col: str, item_text: str, coverage: float, broadcast: int) -> DataFrame:
    """docs (id: the row's number, own: its own id, text) -> (id, own, item, matched, windows, literal)."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("own"), F.col(item_text).alias("text")).dropDuplicates(["own", "text"])
    item = scratch.save(keyed(items, scratch, "item-rows").withColumnRenamed(KEY, "id").mapInArrow(_windows(None, []), _ROW), "items")
    sizes = sorted(r["size"] for r in item.select("size").distinct().collect())  # WINDOW at most
    known = spark.sparkContext.broadcast(Known(item.select("h").distinct(), broadcast))
    found = scratch.save(docs.mapInArrow(_windows(known, sizes), _ROW).drop("n"), "found")
    totals = item.groupBy("id", "own", "size", "n").agg(F.count("*").alias("windows")).select(F.col("id").alias("number"), F.col("own").alias("item"), "n", "windows")
    item = item.select("h", F.col("id").alias("number"), F.col("pos").alias("ipos"), "size", F.col("v").alias("iv"))
    met = found.join(item, ["h", "size"]).select("id", "own", "number", "size", F.struct("pos", "ipos", "v", "iv").alias("hit"))
    met = met.groupBy("id", "own", "number", "size").agg(F.sort_array(F.collect_set("hit")).alias("hits"), F.count_distinct("hit.ipos").alias("k"))
    met = met.join(totals, "number").where(F.col("k") * F.col("size") >= F.col("n") * coverage)
    met = met.select("id", "own", "item", "size", "n", "windows", "hits.pos", "hits.ipos", F.flatten("hits.v").alias("v"), F.flatten("hits.iv").alias("iv"))
    return met.mapInArrow(_chained(coverage), "id long, own long, item long, matched long, windows long, literal boolean")


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", coverage: float = COVERAGE, broadcast: int = BROADCAST
) -> DataFrame:
    """(id, item, matched, windows, literal) of each document and benchmark item that it holds. matched: windows of the item in the
    chain; literal: with its own fillers."""
    prepare(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("id"), F.col(id_col).cast("long").alias("own"), F.col(text_col).alias("text"))  # read once
    found = _found(rows, benchmark, Scratch(docs.sparkSession, "decontaminate"), item_col, item_text, coverage, broadcast)
    return found.select(F.col("own").alias(id_col), F.col("item").alias(item_col), "matched", "windows", "literal")


def without_contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", coverage: float = COVERAGE, broadcast: int = BROADCAST
) -> DataFrame:
    """The rows of docs, all columns, that hold no benchmark item."""
    prepare(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "decontaminate")
    held = keyed(docs, scratch)
    rows = held.select(F.col(KEY).alias("id"), F.col(id_col).cast("long").alias("own"), F.col(text_col).alias("text"))
    found = scratch.save(_found(rows, benchmark, scratch, item_col, item_text, coverage, broadcast).select(F.col("id").alias(KEY)).distinct(), "out")
    return held.join(found, KEY, "left_anti").select(*[f"`{c}`" for c in docs.columns])


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
