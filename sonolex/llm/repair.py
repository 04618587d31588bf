"""Token-id files compressed with Re-Pair, one grammar for each shard, with random access to documents.

A shard holds consecutive documents in the order of their ids. Pairs of neighbouring ids are counted over the whole shard; frequent ones
become nonterminals wherever no more frequent one overlaps with them, all at once; and this is repeated on what comes out until no
pair occurs ``LEAST`` times (a rule takes three numbers). Pairs never cross documents, so a
document is a run of symbols and can be decoded alone; the rules keep their expansion lengths, so a position inside it is
found without decoding what stands before.

Format of a shard (little-endian): magic ``RPR1``; five uint32: first nonterminal, rules, symbols, documents, reserved; then
rule pairs (uint32 x 2 each), expansion lengths (uint32), symbols (uint32), document ids (int64), symbol borders of the documents
(uint32, one more than documents). Shards travel as binary values of a Parquet table, so any store that Spark writes will do and
a lost executor's shards are written again.

Defined results: null and empty texts have the end id alone; repeated ids are kept, in any order among them; rows without an id
come first, with the smallest id possible; an empty table gives an empty file; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import ARROW_BATCH_BYTES, Scratch, hold, pieces, prepare, release
from .tokens import END, default_tokenizer, encoder

SHARD, LEAST, SLOTS = 1 << 20, 16, 1 << 18
NO_ID = -(1 << 63)
#: Rows of 16 bytes that are broadcast at most; one for a shard, so for about two terabytes of text.
MOST_SENT = 500_000
#: What is known of a symbol's place: it ends its document; the pair that it begins may be frequent (others stay rare, as old pairs only get fewer).
_LAST, _OPEN = np.uint8(1), np.uint8(2)


def _places_in(found: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Where each pair stands among ``found`` (sorted), or -1. A table of slots knows one pair a slot; the few others are searched for."""
    slot = lambda x: ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - SLOTS.bit_length())).view(np.int64)
    table, own = np.full(SLOTS, -1, np.int32), slot(found)
    table[own] = np.arange(len(found), dtype=np.int32)
    at = slot(pairs)
    out = table[at].astype(np.int64)
    out[found[out] != pairs] = -1
    lost = np.flatnonzero(table[own] != np.arange(len(found)))
    if len(lost):
        shared = np.zeros(SLOTS, bool)
        shared[own[lost]] = True
        again = np.flatnonzero(shared[at] & (out < 0))
        near = lost[np.minimum(np.searchsorted(found[lost], pairs[again]), len(lost) - 1)]
        out[again] = np.where(found[near] == pairs[again], near, -1)
    return out


def _frequent(pair: np.ndarray, odd: np.ndarray, least: int, symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs that occur ``least`` times or more (sorted), how often they do, and where each of ``pair`` stands among them, or -1.
    What is odd isn't counted. symbols: all are smaller.

    Where a pair and its place fit 64 bits, they are sorted together, and what is found leads back to the places; else the pairs are sorted
    alone and looked up."""
    wide, far = max(symbols - 1, 1).bit_length(), len(pair).bit_length()
    packed = 2 * wide + far <= 64
    free = np.flatnonzero(~odd) if odd.any() else None
    ordered = pair.copy() if free is None else pair[free]
    if packed:
        low = ordered & np.uint64(0xFFFFFFFF)
        ordered >>= np.uint64(32)
        ordered <<= np.uint64(wide)
        ordered |= low
        ordered <<= np.uint64(far)
        ordered |= np.arange(len(pair), dtype=np.uint64) if free is None else free.view(np.uint64)
    ordered.sort()
    value = ordered >> np.uint64(far) if packed else ordered
    edge = np.concatenate([[0], np.flatnonzero(value[1:] != value[:-1]) + 1, [len(value)]])
    many = np.diff(edge)
    some = many >= least
    found = value[edge[:-1][some]]
    if not len(found) or not packed:
        return found, many[some], _places_in(found, pair) if len(found) else np.full(len(pair), -1)
    name = np.full(len(pair), -1, np.int32)
    own = (ordered[np.repeat(some, many)] & np.uint64((1 << far) - 1)).view(np.int64)
    many = many[some]
    name[own] = np.repeat(np.arange(len(found), dtype=np.int32), many)
    left = np.flatnonzero(odd)
    name[left] = name[left - 1]  # the same pair
    return (found >> np.uint64(wide)) << np.uint64(32) | found & np.uint64((1 << wide) - 1), many, name


def compress(ids: np.ndarray, borders: np.ndarray, least: int = LEAST, rounds: int | None = None):
    """(symbols, borders, rules, expansion lengths, first nonterminal) of a shard's ids (uint32).

    A round counts the pairs (of pairs that overlap with themselves, every second), and replaces each pair of ``least`` or more where no more
    frequent one overlaps with it. Rounds go on until no pair is left that occurs ``least`` times; rounds bounds them for tests."""
    seq = np.array(ids, np.uint32)
    first = nxt = int(seq.max()) + 1 if len(seq) else 0
    rules, sizes = [np.zeros((0, 2), np.uint32)], np.zeros(0, np.uint32)
    full = np.diff(borders) > 0  # an empty document has no symbols
    mark = np.full(len(seq), _OPEN, np.uint8)
    mark[borders[1:][full] - 1] |= _LAST
    while rounds is None or rounds > 0:
        rounds = rounds and rounds - 1
        at = np.flatnonzero(mark == _OPEN)
        if len(at) < least:
            break
        pair = np.ndarray(len(seq) - 1, "<u8", seq, strides=(4,))[at]  # the second id in the upper half
        again = np.flatnonzero(pair[1:] == pair[:-1])
        again = again[at[again + 1] == at[again] + 1] + 1  # aaa: the pair overlaps with itself
        odd = np.zeros(len(at), bool)
        if len(again):
            head = np.ones(len(again), bool)
            head[1:] = again[1:] != again[:-1] + 1
            odd[again] = (np.arange(len(again)) - np.maximum.accumulate(np.where(head, np.arange(len(again)), 0))) % 2 == 0
        found, many, name = _frequent(pair, odd, least, nxt)
        if not len(found):
            break
        rank = np.empty(len(found), np.int32)
        rank[np.lexsort((found, -many))] = np.arange(len(found), 0, -1)  # the most frequent has the highest
        hit = np.flatnonzero(name >= 0)
        at, name, odd = at[hit], name[hit], odd[hit]
        # runs of one pair that overlaps with itself count as one hit; it wins if what overlaps at its ends is less frequent
        value = rank[name]
        touch = np.zeros(len(at) + 1, bool)
        touch[1:-1] = at[1:] == at[:-1] + 1
        head = np.ones(len(at) + 1, bool)
        head[1:-1] = ~touch[1:-1] | (name[1:] != name[:-1])
        begin = np.flatnonzero(head[:-1])
        end = np.append(begin[1:], len(at)) - 1
        top = value[begin]
        win = ((~touch[begin]) | (value[begin - 1] < top)) & ((~touch[end + 1]) | (value[np.minimum(end + 1, len(at) - 1)] < top))
        chosen = (np.repeat(win, end - begin + 1) if len(begin) < len(at) else win) & ~odd
        used = np.bincount(name[chosen], minlength=len(found)) >= least  # a rule must pay; the most frequent pair's always does
        chosen &= used[name]
        put, kept = at[chosen], np.flatnonzero(used)
        number = np.cumsum(used) - 1
        new = np.stack([found[kept] & np.uint64(0xFFFFFFFF), found[kept] >> np.uint64(32)], 1).astype(np.uint32)
        known = np.append(sizes, np.uint32(1))
        long = known[np.where(new >= first, new.astype(np.int64) - first, len(sizes))].sum(1, dtype=np.uint32)
        rules.append(new)
        sizes = np.concatenate([sizes, long])
        seq[put] = (nxt + number[name[chosen]]).astype(np.uint32)
        nxt += len(kept)
        keep = np.ones(len(seq), bool)
        keep[put + 1] = False
        before = put[put > 0] - 1
        before = before - ~keep[before]  # the symbol before, if it was made of two just now
        mark &= _LAST
        mark[at] = _OPEN
        mark[put] = mark[put + 1] & _LAST | _OPEN
        mark[before] |= _OPEN
        seq, mark = seq[keep], mark[keep]
    edge = np.zeros(len(borders), np.int64)
    edge[:-1][full] = np.concatenate([[0], np.flatnonzero(mark & _LAST) + 1])[: full.sum()]  # a document begins where the one before ends
    edge[-1] = len(seq)
    edge = np.minimum.accumulate(np.where(np.append(full, True), edge, len(seq))[::-1])[::-1]
    return seq, edge, np.concatenate(rules), sizes, first


def _unfold(seq: np.ndarray, rules: np.ndarray, first: int) -> np.ndarray:
    """The ids that symbols stand for, one level of rules after the other."""
    while True:
        big = seq >= first
        if not len(rules) or not big.any():
            return seq
        n = np.where(big, 2, 1)
        at = np.cumsum(n) - n
        out = np.empty(int(n.sum()), np.uint32)
        out[at[~big]] = seq[~big]
        pair = rules[seq[big].astype(np.int64) - first]
        out[at[big]], out[at[big] + 1] = pair[:, 0], pair[:, 1]
        seq = out


def expand(symbols: np.ndarray, rules: np.ndarray, sizes: np.ndarray, first: int) -> np.ndarray:
    """The ids that symbols stand for."""
    return expand_all(symbols, rules, sizes, first)[0]


def expand_all(symbols: np.ndarray, rules: np.ndarray, sizes: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids that symbols stand for, and where each symbol's begin (one more than symbols). Many symbols are taken from a table
    of all rules' ids."""
    if len(symbols) < 4 * len(rules) + first:
        long = np.ones(len(symbols), np.int64)
        big = symbols >= first
        long[big] = sizes[symbols[big].astype(np.int64) - first]
        return _unfold(symbols, rules, first), np.concatenate([[0], np.cumsum(long)])
    ids = np.concatenate([np.arange(first, dtype=np.uint32), _unfold(np.arange(first, first + len(rules), dtype=np.uint32), rules, first)])
    upto = np.concatenate([np.arange(first, dtype=np.int64), first + np.cumsum(np.concatenate([[0], sizes.astype(np.int64)]))])
    taken = pa.LargeListArray.from_arrays(pa.array(upto), pa.array(ids)).take(pa.array(symbols))
    return taken.flatten().to_numpy(), taken.offsets.to_numpy()


def pack_shard(docs: np.ndarray, ids: np.ndarray, borders: np.ndarray) -> bytes:
    seq, edge, rules, sizes, first = compress(ids, borders)
    head = np.array([first, len(rules), len(seq), len(docs), 0], "<u4")
    return b"RPR1" + b"".join(x.tobytes() for x in (head, rules.astype("<u4"), sizes.astype("<u4"), seq.astype("<u4"), docs.astype("<i8"), edge.astype("<u4")))


class Shard:
    """A shard's parts, without decoding."""

    def __init__(self, raw: bytes):
        if raw[:4] != b"RPR1":
            raise ValueError("not a shard")
        head = np.frombuffer(raw, "<u4", 5, 4)
        self.first, n_rules, n_symbols, n_docs, _ = map(int, head)
        at = 24

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        self.rules = take("<u4", 2 * n_rules).reshape(-1, 2)
        self.sizes, self.symbols, self.docs, self.edge = take("<u4", n_rules), take("<u4", n_symbols), take("<i8", n_docs), take("<u4", n_docs + 1)

    def lengths(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), np.int64)
        big = symbols >= self.first
        if len(self.sizes):
            out[big] = self.sizes[symbols[big].astype(np.int64) - self.first]
        return out

    def document(self, i: int, start: int = 0, end: int | None = None) -> np.ndarray:
        """Ids [start, end) of the i-th document; only the symbols that hold them are expanded."""
        own = self.symbols[self.edge[i] : self.edge[i + 1]]
        upto = np.cumsum(self.lengths(own))
        if not len(own):
            return np.zeros(0, np.uint32)
        end = int(upto[-1]) if end is None else min(end, int(upto[-1]))
        a, b = np.searchsorted(upto, start, "right"), np.searchsorted(upto, end, "left") + 1
        skip = int(upto[a - 1]) if a else 0
        return expand(own[a:b], self.rules, self.sizes, self.first)[start - skip : end - skip]

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        ids, upto = expand_all(self.symbols, self.rules, self.sizes, self.first)
        return ids, upto[self.edge]


SHARDS = "part int, seq int, n_docs long, n_tokens long, first_doc long, last_doc long, body binary"


def _write(path: str, shard: int):
    def run(batches):
        encode, part, seq = encoder(path), TaskContext.get().partitionId(), 0
        docs, held, total = [], [], 0
        hold()

        def flush():
            borders = np.concatenate([[0], np.cumsum([len(h) for h in held])])
            body = pack_shard(np.array(docs, np.int64), np.concatenate(held), borders)
            row = [[part], [seq], [len(docs)], [int(borders[-1])], [docs[0]], [docs[-1]], [body]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], ["part", "seq", "n_docs", "n_tokens", "first_doc", "last_doc", "body"])

        for piece in pieces(batches, ARROW_BATCH_BYTES):
            ids, borders = encode.column(piece.column("text"), END)
            borders = borders.tolist()
            for doc, low, high in zip(piece.column("id").to_pylist(), borders, borders[1:]):
                docs.append(doc)
                held.append(ids[low:high])
                total += high - low
                if total >= shard:
                    yield flush()
                    seq, docs, held, total = seq + 1, [], [], 0
        if docs:
            yield flush()
        release()

    return run


def write_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, shard: int = SHARD) -> None:
    """Encodes every text and writes the shards, in ascending order of the ids over (part, seq)."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.repartitionByRange(n, "id").sortWithinPartitions("id")
    ordered.mapInArrow(_write(tokenizer or default_tokenizer(), shard), SHARDS).write.mode("overwrite").option("compression", "zstd").parquet(path)


def _read(batches):
    for batch in batches:
        for base, body in zip(batch.column("base").to_pylist(), batch.column("body").to_pylist()):
            shard = Shard(body)
            ids, edge = shard.all()
            raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard.docs), pa.array(edge[:-1] + base, pa.int64()), pa.array(np.diff(edge), pa.int64()), pa.array(crc, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"]
            )


def read_ids(spark, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the shards' own bytes."""
    shards = spark.read.parquet(path)
    upto = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row for a shard, without its bytes, and one for a part
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).select("part", upto(Window.orderBy("part")).alias("low"))
    bases = shards.select("part", "seq", upto(Window.partitionBy("part").orderBy("seq")).alias("inside")).join(parts, "part").select("part", "seq", (F.col("low") + F.col("inside")).alias("base"))
    if shards.count() <= MOST_SENT:  # else a shuffle, of the shards' bytes too
        bases = F.broadcast(bases)
    rows = shards.select("part", "seq", "body").join(bases, ["part", "seq"]).select("base", "body")
    out = rows.mapInArrow(_read, "id long, start long, n_tokens long, ids_crc32 long")
    return out.select(F.when(F.col("id") != NO_ID, F.col("id")).alias(id_col), "start", "n_tokens", "ids_crc32")


def op7_repair(spark, sf_dir: str) -> DataFrame:
    path = f"{Scratch(spark, 'repair').root}/ids"
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_ids(spark, path)
