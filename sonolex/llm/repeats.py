"""Finds every window of W units (words or bytes) that starts at two places or more of a corpus.

A window is owned by an anchor: the leftmost smallest hash of the grams inside it (winnowing). Equal windows have their
anchor at the same offset, so they meet under the anchor's hash, and anchors whose hash is unique are dropped by a count
before any text moves. What is left is sent as slices of text, one for an anchor and all windows it owns, to groups of
bounded size, where the operator's own method (suffix trees, prefix-free parsing) finds the repeats.

* Rows are numbered first and told apart by their number alone. Texts with one unit sequence form a class. If it has two members,
  all their windows are repeats; the first stands for it against the rest.
* An anchor that more than ``HOT`` slices share isn't gathered: its slices are keyed by longer prefixes. First equal
  slices that are cut together settle each other, and one of each kind goes on with their number, so a passage in very many
  texts is shuffled once for a batch and not once for a text. What goes on is counted by kind, which settles all but one of
  each; those that are left are cut by how much stands before the anchor, twice and finer the second time (``_cores``), and the
  windows of parts that share their core are counted by their own hash, again first among those that meet in a batch.
* Groups are read in hash order and solved in parts of ``PART`` bytes; a group is never cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import KEY, Scratch, among, bytes_of, doubled, keyed, lists, mix, pieces, prepare, spread

HOT, PART, FINE = 2000, 2 << 20, 8
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _sliding(x: np.ndarray, n: int, f) -> np.ndarray:
    """f over x[i : i + n] for every i, by doubling; the tail is undefined."""
    have, out = 1, x
    while have * 2 <= n:
        nxt = out.copy()
        f(out[:-have], out[have:], out=nxt[:-have])
        out, have = nxt, have * 2
    if have < n:
        nxt = out.copy()
        f(out[: -(n - have)], out[n - have :], out=nxt[: -(n - have)])
        out = nxt
    return out


def anchors(grams: np.ndarray, border: np.ndarray, window: int, gram: int):
    """(anchor position, first window, windows owned, text) of every anchor.

    grams: a hash for each unit, of the gram that starts there (one beyond its text's end is never used).
    """
    n, many = len(grams), np.diff(border)
    empty = np.zeros(0, np.int64)
    if n < window or not (many >= window).any():
        return empty, empty, empty, empty
    per, text = window - gram + 1, np.repeat(np.arange(len(many)), many)
    valid = np.zeros(n, bool)
    valid[: n - window + 1] = text[: n - window + 1] == text[window - 1 :]
    least = _sliding(grams, per, np.minimum)
    # a position is an anchor if it is the least of some window, that is if the largest least over it is its own
    held = np.where(valid, least, np.uint64(0))
    most = np.zeros(n, np.uint64)
    back = _sliding(np.concatenate([np.zeros(per - 1, np.uint64), held]), per, np.maximum)
    most[:] = back[:n]
    chosen = (most == grams) & (most > 0)
    where = np.flatnonzero(chosen)
    starts = np.flatnonzero(valid)
    at = (np.cumsum(chosen) - chosen)[starts]
    wrong = np.flatnonzero(grams[where[at]] != least[starts])
    while len(wrong):
        at[wrong] += 1
        wrong = wrong[grams[where[at[wrong]]] != least[starts[wrong]]]
    owner = where[at]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    return owner[first], starts[first], np.diff(np.append(first, len(owner))), text[owner[first]]


def _scan(units, window: int, gram: int):
    """units(data, offsets) -> (a number for each unit: a word's hash or a byte, hash of each gram, byte starts, byte ends, borders)."""

    def run(batches):
        for part in pieces(batches, 1 << 20):
            own, grams, _, _, border = units(*bytes_of(part.column("text")))
            n, many = part.num_rows, np.diff(border)
            owner, first, count, text = anchors(grams, border, window, gram)
            raw, width = memoryview(np.ascontiguousarray(own)).cast("B"), own.itemsize
            prints = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[width * a : width * b]) for a, b in zip(border[:-1].tolist(), border[1:].tolist())]), np.int64).reshape(n, 2)
            edge = np.searchsorted(text, np.arange(n + 1))
            base = border[:-1][text]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id"),
                    pa.array(many, pa.int64()),
                    *(pa.array(np.ascontiguousarray(prints[:, i])) for i in (0, 1)),
                    lists(grams[owner].view(np.int64), edge, pa.int64()),
                    lists(first - base, edge, pa.int32()),
                    lists(count, edge, pa.int32()),
                ],
                ["id", "n", "f1", "f2", "h", "lo", "cnt"],
            )

    return run


SCAN = "id long, n long, f1 long, f2 long, h array<long>, lo array<int>, cnt array<int>"


def _slices(units, window: int):
    """Text slices of the shared anchors, with a hash of the slice.

    copies: 1, but for equal hot slices of a batch of texts: how many they are in the first, 0 and no body in the others.
    """

    def run(batches):
        for part in pieces(batches, 1 << 20):
            data, offsets = bytes_of(part.column("text"))
            own, _, starts, ends, border = units(data, offsets)
            found = part.column("at")
            edge = found.offsets.to_numpy()
            take = slice(edge[0], edge[-1])
            h, lo, cnt, hot = (found.values.field(c).to_numpy(zero_copy_only=False)[take] for c in ("h", "lo", "cnt", "hot"))
            text = np.repeat(np.arange(part.num_rows), np.diff(edge))
            unit = border[:-1][text] + lo
            raw, plain, width = data.tobytes(), memoryview(np.ascontiguousarray(own)).cast("B"), own.itemsize
            slice_hash, copies, warm = np.zeros(len(h), np.uint64), np.ones(len(h), np.int32), np.flatnonzero(hot)
            for i, a, b in zip(warm.tolist(), unit[warm].tolist(), (unit + cnt + window - 1)[warm].tolist()):
                slice_hash[i] = xxhash.xxh3_64_intdigest(plain[width * a : width * b])
            _, first, many = np.unique(slice_hash[warm] ^ mix(h[warm].view(np.uint64) + cnt[warm].astype(np.uint64)), return_index=True, return_counts=True)
            copies[warm] = 0
            copies[warm[first]] = many
            upto = np.where(copies > 0, ends[unit + cnt + window - 2], starts[unit])
            body = [raw[a:b] for a, b in zip(starts[unit].tolist(), upto.tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(h, pa.int64()),
                    pa.array(part.column("id").to_numpy()[text], pa.int64()),
                    pa.array(lo, pa.int32()),
                    pa.array(cnt, pa.int32()),
                    pa.array(body, pa.binary()),
                    pa.array(slice_hash.view(np.int64)),
                    pa.array(hot, pa.bool_()),
                    pa.array(copies, pa.int32()),
                ],
                ["h", "id", "lo", "cnt", "body", "sh", "hot", "copies"],
            )

    return run


def _cores(units, window: int, gram: int, width: int = 0):
    """Cuts a slice's windows by how far before the anchor they begin, 0, 1, 2 to 3, 4 to 7 and so on, or by every ``width`` units;
    a part's key is the hash of the units that all its windows share, a longer prefix than the anchor."""

    def run(batches):
        for part in pieces(batches, 1 << 20, "body"):
            data, offsets = bytes_of(part.column("body"))
            own, grams, starts, ends, border = units(data, offsets)
            lo, cnt, raw, rows = part.column("lo").to_pylist(), part.column("cnt").to_pylist(), data.tobytes(), []
            plain, wide = memoryview(np.ascontiguousarray(own)).cast("B"), own.itemsize
            for i, at in enumerate(border[:-1].tolist()):
                p = int(np.argmin(grams[at : at + window - gram + 1]))
                a, b = 0, width or 1
                while a <= p:
                    first, last = max(0, p - b + 1), min(cnt[i] - 1, p - a)  # windows whose anchor stands a to b - 1 units in
                    if first <= last:
                        x, y = at + p - a, at + p - b + 1 + window
                        rows.append((x, y, b, i, lo[i] + first, last - first + 1, raw[starts[at + first] : ends[at + last + window - 1]]))
                    a, b = b, b + width if width else 2 * b
            if not rows:
                continue
            key = np.array([xxhash.xxh3_64_intdigest(plain[wide * x : wide * y], b) for x, y, b, *_ in rows], np.uint64)
            take = pa.array([r[3] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), part.column("id").take(take), pa.array([r[4] for r in rows], pa.int32()), pa.array([r[5] for r in rows], pa.int32()), pa.array([r[6] for r in rows], pa.binary()), part.column("many").take(take)],
                ["core", "id", "lo", "cnt", "body", "many"],
            )

    return run


def _windows(units, window: int):
    """(w, id, lo, hi, copies): windows that are alone in a batch of slices, with w, their hash, and copies 1; each kind that isn't,
    once, with copies 2; and the spans that the windows of such kinds cover, with copies 0. The windows of a slice that is
    repeated as a whole (many) are settled: they count as 2 and cover nothing."""

    def run(batches):
        for part in pieces(batches, 1 << 20, "body"):
            data, offsets = bytes_of(part.column("body"))
            own, _, _, _, border = units(data, offsets)
            cnt = part.column("cnt").to_numpy()
            step = np.arange(cnt.sum()) - np.repeat(np.cumsum(cnt) - cnt, cnt)
            s = np.repeat(border[:-1], cnt) + step
            key = doubled(own.astype(np.uint64), window)[s]
            ids, lo, settled = (np.repeat(part.column(c).to_numpy(zero_copy_only=False), cnt) for c in ("id", "lo", "many"))
            lo, settled = lo.astype(np.int64) + step, settled.astype(bool)
            kind, first, which, many = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            weight = np.minimum(many + np.bincount(which, settled, len(kind)).astype(np.int64), 2)
            hit = np.flatnonzero((many[which] > 1) & ~settled)
            new = np.ones(len(hit), bool)
            new[1:] = (hit[1:] != hit[:-1] + 1) | (step[hit[1:]] == 0)
            begin = np.flatnonzero(new)
            a, b = hit[begin], hit[np.append(begin[1:], len(hit)) - 1] if len(hit) else hit
            zero = np.zeros(len(a), np.int64)
            at = np.concatenate([first, a])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([kind.view(np.int64), zero])),
                    pa.array(ids[at], pa.int64()),
                    pa.array(lo[at], pa.int32()),
                    pa.array(np.concatenate([lo[first], lo[b]]) + window, pa.int32()),
                    pa.array(np.concatenate([weight, zero]), pa.int32()),
                ],
                ["w", "id", "lo", "hi", "copies"],
            )

    return run


def _solve(solver, window: int):
    """Rows in the order of h -> (id, lo, hi) spans of units that repeated windows cover."""

    def parts(batches):
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            h = batch.column("h").to_numpy()
            cut = np.flatnonzero(h[1:] != h[:-1]) + 1
            length = np.cumsum(np.diff(bytes_of(batch.column("body"))[1]))
            done = 0
            if held and held[-1].column("h")[-1].as_py() != h[0] and size >= PART:
                yield held
                held, size = [], 0
            for c in cut:
                if size + length[c - 1] - (length[done - 1] if done else 0) >= PART:
                    held.append(batch.slice(done, c - done))
                    yield held
                    held, size, done = [], 0, c
            held.append(batch.slice(done))
            size += length[-1] - (length[done - 1] if done else 0)
        if held:
            yield held

    def run(batches):
        for held in parts(batches):
            table = pa.Table.from_batches(held).combine_chunks()
            data, offsets = bytes_of(table["body"])
            h, ids, lo, cnt = (table[c].to_numpy() for c in ("h", "id", "lo", "cnt"))
            many = solver(data, offsets, cnt)  # for each window, slice by slice: does it start elsewhere?
            row = np.repeat(np.arange(len(cnt)), cnt)
            start = np.arange(len(row)) - np.repeat(np.cumsum(cnt) - cnt, cnt)
            hit = np.flatnonzero(many)
            new = np.ones(len(hit), bool)
            new[1:] = (hit[1:] != hit[:-1] + 1) | (row[hit[1:]] != row[hit[:-1]])
            a = np.flatnonzero(new)
            b = np.append(a[1:], len(hit)) - 1 if len(a) else a
            who = row[hit[a]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[who], pa.int64()), pa.array(lo[who] + start[hit[a]], pa.int32()), pa.array(lo[who] + start[hit[b]] + window, pa.int32())], ["id", "lo", "hi"]
            )

    return run


def repeats(docs: DataFrame, units, solver, window: int, gram: int, tag: str) -> DataFrame:
    """docs (text, more) -> the same rows with (whole, spans): whether every window is a repeat, else the spans of units to remove."""
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark, tag)
    carried = keyed(docs, scratch).withColumnRenamed(KEY, "id")
    docs = carried.select("id", "text")
    scan = scratch.save(docs.mapInArrow(_scan(units, window, gram), SCAN), "scan")
    classes = scan.where(F.col("n") >= window).groupBy("n", "f1", "f2").agg(F.count("*").alias("many"), F.min("id").alias("rep"))
    classes = scratch.save(classes, "classes")
    copied = scan.select("id", "n", "f1", "f2").join(classes.where("many > 1").select("n", "f1", "f2"), ["n", "f1", "f2"], "left_semi")
    copied = scratch.save(copied.select("id"), "copied")
    reps = scan.select("id", "h", "lo", "cnt").join(classes.select(F.col("rep").alias("id")), "id", "left_semi")
    rows = reps.select("id", F.explode(F.arrays_zip("h", "lo", "cnt")).alias("a")).select("id", "a.*")
    rows = scratch.save(rows, "rows")
    scratch.drop("scan", "classes")
    counts = rows.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h", (F.col("c") > HOT).alias("hot"))
    counts = scratch.save(counts, "counts")  # so that Spark can split the rows of a hot anchor
    shared = rows.join(counts, "h").groupBy("id").agg(F.collect_list(F.struct("h", "lo", "cnt", "hot")).alias("at"))
    cut = docs.join(shared, "id").select("id", "text", F.expr("array_sort(at, (x, y) -> x.lo - y.lo)").alias("at"))
    slices = scratch.save(cut.mapInArrow(_slices(units, window), "h long, id long, lo int, cnt int, body binary, sh long, hot boolean, copies int"), "slices")
    scratch.drop("rows", "counts")
    cold = spread(slices.where("not hot").drop("sh", "hot", "copies"), "h").sortWithinPartitions("h").mapInArrow(_solve(solver, window), "id long, lo int, hi int")
    going = slices.where("hot and copies > 0")
    kinds = going.groupBy("h", "sh", "cnt").agg(F.sum("copies").alias("c"), F.min(F.struct("id", "lo")).alias("first"))
    kinds = scratch.save(kinds, "kinds")
    hot = scratch.save(going.join(kinds, ["h", "sh", "cnt"]), "hot")
    alike = slices.where("hot and copies = 0").select("id", "lo", "cnt").unionByName(hot.where("c > 1").select("id", "lo", "cnt"))
    alike = alike.select("id", "lo", (F.col("lo") + F.col("cnt") + (window - 1)).alias("hi"))
    single = hot.where("first = struct(id, lo)").select("id", "lo", "cnt", "body", (F.col("c") > 1).alias("many"))
    for width in (0, FINE):
        cut = single.mapInArrow(_cores(units, window, gram, width), "core long, id long, lo int, cnt int, body binary, many boolean")
        single = scratch.save(cut, f"cores{width}")
        shared = single.groupBy("core").agg(F.count("*").alias("c")).where("c > 1").select("core")
        # equal windows share a core: a join by shuffle brings them together, so most settle in one batch
        single = single.join(scratch.save(shared, f"shared{width}").hint("merge"), "core").drop("core")
    single = scratch.save(single.mapInArrow(_windows(units, window), "w long, id long, lo int, hi int, copies int"), "windows")
    again = single.where("copies > 0").groupBy("w").agg(F.sum("copies").alias("c")).where("c > 1").select("w")
    found = single.where("copies = 1").join(again, "w").select("id", "lo", "hi")
    hot = alike.unionByName(found).unionByName(single.where("copies = 0").select("id", "lo", "hi"))
    spans = scratch.save(cold.unionByName(hot), "spans")
    scratch.drop("slices", "kinds", "hot", "cores0", f"cores{FINE}", "shared0", f"shared{FINE}", "windows")
    marks = spans.groupBy("id").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")).withColumn("whole", F.lit(False))
    marks = marks.join(copied, "id", "left_anti")
    marks = scratch.save(marks.unionByName(copied.select("id", F.lit(None).cast("array<struct<lo:int,hi:int>>").alias("spans"), F.lit(True).alias("whole"))), "marks")
    scratch.drop("spans", "copied")
    # texts that lose nothing aren't shuffled
    cut, clean = among(carried, marks.select("id"), scratch, "marked", "id")
    clean = clean.withColumn("spans", F.lit(None).cast(marks.schema["spans"].dataType)).withColumn("whole", F.lit(False))
    return cut.join(marks, "id").unionByName(clean)


def removed_units(whole: np.ndarray, spans, border: np.ndarray) -> np.ndarray:
    """A flag for each unit of a batch: does a repeated window cover it?"""
    n = int(border[-1])
    delta = np.zeros(n + 1, np.int32)
    edge = spans.offsets.to_numpy()
    flat = spans.values
    take = slice(edge[0], edge[-1])
    lo, hi = (flat.field(c).to_numpy(zero_copy_only=False)[take] for c in ("lo", "hi"))
    base = border[:-1][np.repeat(np.arange(len(edge) - 1), np.diff(edge))]
    np.add.at(delta, base + lo, 1)
    np.add.at(delta, base + hi, -1)
    out = np.cumsum(delta[:-1]) > 0
    for i in np.flatnonzero(whole):
        out[border[i] : border[i + 1]] = True
    return out
