"""Shared plumbing: tables, shared storage, byte-level word scanning."""

from __future__ import annotations

import atexit
import ctypes
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

ARROW_BATCH_BYTES = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Bounds the Arrow batches by bytes: a batch of very long texts must fit a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see. There is no other: a local one would be lost with its machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and spark.sparkContext.master.split("[")[0] == "local":  # one machine: its temporary folder is shared
        found = "file:///tmp/sonolex-shared"
    if not found:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found.rstrip("/")


class Scratch:
    """Tables written in the shared folder during one operator call.

    Writing cuts the lineage: a lost executor costs the tasks of one stage, not the job.
    ``drop`` frees a table that nothing reads any more; the rest goes at exit.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/sonolex/{tag}-{uuid.uuid4().hex}"
        atexit.register(self._remove, self.root)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{name}")
        del df
        return self.spark.read.parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            self._remove(f"{self.root}/{name}")

    def _remove(self, path: str) -> None:
        try:
            jvm = self.spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is gone, and with it the need
            pass


KEY = "__row"


def keyed(docs: DataFrame, scratch: Scratch, name: str = "keyed") -> DataFrame:
    """docs with a number for each row, stored, so that every later read finds the same. Rows are told apart by it alone: ids may
    be null or repeat."""
    return scratch.save(docs.withColumn(KEY, F.monotonically_increasing_id()), name)


#: Bitmaps (4 kB each) that are broadcast.
BITMAPS = 1 << 14


def among(rows: DataFrame, ids: DataFrame, scratch: Scratch, name: str, key: str = KEY) -> tuple[DataFrame, DataFrame]:
    """rows whose number (``keyed``) is among ``ids``, and the others; a null number is among the others.

    Rows carry texts, so they aren't shuffled: a partition's numbers are consecutive, and a bitmap holds 32,768 of them. Up to ``BITMAPS``
    bitmaps are broadcast; for more the rows are joined with ``ids``."""
    place = F.col(key) + 1
    bits = ids.select(F.bitmap_bucket_number(place).alias("__bucket"), F.bitmap_bit_position(place).alias("__place"))
    bits = scratch.save(bits.repartition("__bucket").groupBy("__bucket").agg(F.bitmap_construct_agg("__place").alias("__bits")), name)
    if bits.count() > BITMAPS:
        return rows.join(ids, key, "left_semi"), rows.join(ids, key, "left_anti")
    bit = f"shiftright(cast(conv(hex(substring(__bits, cast(bitmap_bit_position(`{key}` + 1) div 8 + 1 as int), 1)), 16, 10) as int), cast(bitmap_bit_position(`{key}` + 1) % 8 as int)) & 1"
    held = rows.join(F.broadcast(bits), F.bitmap_bucket_number(place) == F.col("__bucket"), "left").withColumn("__bit", F.expr(f"coalesce({bit}, 0)"))
    return tuple(held.where(F.col("__bit") == x).select(*[f"`{c}`" for c in rows.columns]) for x in (1, 0))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n + 1 offsets; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def pieces(batches, limit: int = 2 << 20, column: str = "text"):
    """Cuts record batches at row borders into parts of about ``limit`` text bytes (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = bytes_of(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end
    release()


def release() -> None:
    """Gives freed memory back at a task's end: Python workers are kept for later stages, beside a grown JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def hold() -> None:
    """Keeps freed memory for the next arrays, up to 128 MB, until ``release``: new pages for each array of a few MB cost a quarter of the time."""
    try:
        mallopt = ctypes.CDLL("libc.so.6").mallopt
        mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD, its highest value
        mallopt(-1, 128 << 20)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):  # another C library
        pass


_RNG = np.random.default_rng(20240229)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: A random number for each byte at each of the first places of a span; the first is for bytes as they are, the second folds A to Z.
_PLACES = 32
_TABLES = _RNG.integers(0, 1 << 64, (2, _PLACES, 256), dtype=np.uint64)
_TABLES[1] = _TABLES[0]
_TABLES[1][:, 65:91] = _TABLES[0][:, 97:123]
_TABLES = _TABLES.reshape(2, -1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """64-bit hashes of byte spans: a sum over the places of a random number for (place, byte).

    (Tabulation: no algebra ties the places to each other, as it does in polynomials modulo a power of two.)"""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    total = int(size.sum())
    skip = np.cumsum(size) - size
    place = np.arange(total) - np.repeat(skip, size)
    at = place + np.repeat(starts, size)
    byte = data[at]
    near = place < _PLACES
    table = _TABLES[int(fold)]
    if near.all():
        value = table[(place << 8) | byte]
    else:
        value = np.empty(total, np.uint64)
        value[near] = table[(place[near] << 8) | byte[near]]
        far = ~near
        value[far] = mix(mix(place[far].astype(np.uint64) * _STEP) + table[byte[far]])
    sums = np.zeros(total + 1, np.uint64)
    np.cumsum(value, out=sums[1:])
    return mix(sums[skip + size] - sums[skip] + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray, fold: bool = False):
    """Words ``[^\\x20\\x09-\\x0D]+`` of every text: starts, ends, hashes and the n + 1 borders of the texts in them."""
    space = _SPACE[data]
    solid = np.zeros(len(data) + 2, np.int8)
    solid[1:-1] = ~space
    first = solid[1:-1].astype(bool) & (solid[:-2] == 0)
    last = solid[1:-1].astype(bool) & (solid[2:] == 0)
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] = ~space[inner]
    last[inner - 1] = ~space[inner - 1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, span_hashes(data, starts, ends, fold), np.searchsorted(starts, offsets)


def windowed(values: np.ndarray, n: int) -> np.ndarray:
    """Order-dependent 64-bit hashes of every n consecutive values (len - n + 1 of them)."""
    if len(values) < n:
        return np.zeros(0, np.uint64)
    out = mix(values[: len(values) - n + 1])
    for i in range(1, n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + values[i : len(values) - n + 1 + i])
    return out


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of pairs."""
    x = a * _STEP + b
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def doubled(values: np.ndarray, n: int) -> np.ndarray:
    """Order-dependent 64-bit hashes of every n consecutive values, by doubling (len - n + 1 of them)."""
    if len(values) < n:
        return np.zeros(0, np.uint64)
    out, have = mix(values), 1
    while have < n:
        step = min(have, n - have)
        out, have = joined(out[: len(out) - step], out[step:]), have + step
    return out


def lists(values: np.ndarray, offsets, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.asarray(offsets, np.int32)), pa.array(values, kind))


def spread(df: DataFrame, *keys, n: int | None = None) -> DataFrame:
    """Deals rows by key (or evenly) over the session's shuffle partitions."""
    count = n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(count, *[F.col(k) if isinstance(k, str) else k for k in keys])
