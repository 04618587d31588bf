"""Best-fit-decreasing packing of documents into token sequences.

Best fit decreasing depends on lengths alone, and a length is at most the capacity. So the plan is made from the histogram of
lengths (``capacity`` rows, whatever the corpus) on the driver: a segment tree over remaining capacities finds the tightest open
bin in logarithmic time, and the bins of equal remainder take all documents of a length in one step, with the result of going
document by document. The plan says which ranks of a length go to which bins; documents get their rank among those of their
length in parallel, from salted counts, so a length that a third of all documents have is no hot key.

Defined results: null and empty texts have the end id alone; longer texts than the capacity are cut into full pieces behind a
first one that may be shorter; ties (equal lengths) go by id within a salt; repeated rows of one id are packed each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import ARROW_BATCH_BYTES, Scratch, pieces, prepare
from .tokens import END, default_tokenizer, encoder

CAPACITY, GROUP = 2048, 50_000


class Remainders:
    """Segment tree over remaining capacities 0 .. capacity; finds the least one, of n or more, that an open bin has."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.bins = [0] * (2 * self.size)

    def add(self, remainder: int, n: int) -> None:
        i = remainder + self.size
        while i:
            self.bins[i] += n
            i >>= 1

    def tightest(self, n: int) -> int | None:
        i = n + self.size
        if self.bins[i]:
            return n
        while i > 1:
            if not i & 1 and self.bins[i + 1]:  # a right neighbour holds larger remainders
                i += 1
                while i < self.size:
                    i = 2 * i if self.bins[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, from, to, bin, each, offset): rank r of a length goes to bin + (r - from) // each, there to
    offset + (r - from) % each * length."""
    tree, open_, rows, bins = Remainders(capacity), {}, [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0

        def put(first: int, n: int, each: int, remainder: int) -> None:
            nonlocal rank
            rows.append((length, rank, rank + n * each, first, each, capacity - remainder))
            rank += n * each
            if rest := remainder - each * length:
                open_.setdefault(rest, []).append((first, n))
                tree.add(rest, n)

        while left:
            remainder = tree.tightest(length)
            if remainder is None:
                remainder, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = open_[remainder].pop()
                tree.add(remainder, -n)
            each = remainder // length
            full = min(n, left // each)
            if full:
                put(first, full, each, remainder)
                left -= full * each
            if full < n:
                first, n = first + full, n - full
                if left:  # fewer than one bin takes
                    put(first, 1, left, remainder)
                    left, first, n = 0, first + 1, n - 1
                if n:
                    open_.setdefault(remainder, []).append((first, n))
                    tree.add(remainder, n)
    return rows


def _cut(path: str, capacity: int):
    def run(batches):
        encode = encoder(path)
        for part in pieces(batches, ARROW_BATCH_BYTES):
            out: tuple[list, ...] = ([], [], [], [], [])
            all_ids, borders = encode.column(part.column("text"), END)
            raw, borders = memoryview(all_ids.astype("<u4").tobytes()), borders.tolist()
            for doc, low, high in zip(part.column("id").to_pylist(), borders, borders[1:]):
                ids, n = raw[4 * low : 4 * high], high - low
                at = [0, *range((n - 1) % capacity + 1, n, capacity), n]
                for k, (a, b) in enumerate(zip(at, at[1:])):
                    for column, value in zip(out, (doc, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b]))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["id", "piece", "start", "length", "ids_crc32"]
            )

    return run


def pieces_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every document's token ids with the end id."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(_cut(tokenizer or default_tokenizer(), capacity), "id long, piece int, start long, length long, ids_crc32 long")


def pack(items: DataFrame, scratch: Scratch, capacity: int = CAPACITY) -> DataFrame:
    """items (id, piece, length, ...) -> the same rows with (sequence_id, offset). items must be stored: they are read twice."""
    spark = items.sparkSession
    histogram = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if histogram and not 0 < min(histogram) <= max(histogram) <= capacity:
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    salts = spark.createDataFrame([(k, -(-n // GROUP)) for k, n in histogram.items()], "length long, salts long")
    salted = items.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("id", "piece"), "salts")).drop("salts")
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    counts = scratch.save(counts.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before")), "counts")
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("id", "piece")) - 1
    ranked = salted.withColumn("k", rank).join(counts, ["length", "salt"]).withColumn("rank", F.col("k") + F.col("before")).drop("k", "before", "salt")
    steps = spark.createDataFrame(plan(histogram, capacity), "length long, a long, b long, first long, each long, base long")  # bounded by the capacity
    placed = ranked.join(F.broadcast(steps), "length").where("a <= rank and rank < b")
    where = placed.withColumn("sequence_id", F.expr("first + (rank - a) div each")).withColumn("offset", F.expr("base + (rank - a) % each * length"))
    return where.drop("rank", "a", "b", "first", "each", "base")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset): every piece's place."""
    scratch = Scratch(docs.sparkSession, "packing")
    items = scratch.save(pieces_of(docs, id_col, text_col, tokenizer, capacity), "items")
    out = pack(items, scratch, capacity)
    return out.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
