"""MinHash near-duplicate detection with tensored banding.

Two small collections of ``tables`` half keys are made from ``2 * tables * half`` minhashes; the keys
of the hash tables are all pairs (i, j) of a half key of each, ``tables ** 2`` tables of ``2 * half``
minhashes for the price of a square root of that (Andoni & Indyk's tensoring). A pair of similarity s
meets unless it misses all half keys of either collection: at most ``2 * (1 - s ** half) ** tables``,
0.0005 at 0.8 and 1e-5 at 0.85 with the defaults. ``half`` has to grow with the logarithm of the corpus
to keep chance meetings rare; it is a parameter and never chosen from the data.

What meets is confirmed on the full shingle sets:

1. Rows are numbered and told apart by their number. Texts with one shingle set form a class (its first row
   stands for all), so copies cost a partial aggregation.
2. A half key that one class alone has can't be shared, so only shared half keys of both collections are
   paired. The centre of a table key is its first class; a class is compared with the smallest of its
   centres, one pair a class however many share a key.
3. Confirmed links are contracted to components. Components that still share a table key make up a cluster.
   The classes of a cluster that is larger than a block are dealt to blocks at random, all pairs of a block are
   compared and what links is contracted, again and again as long as that halves the classes outside the largest
   components. Every class that is still outside its cluster's largest component is compared with the whole
   cluster, in blocks; so no link among what meets is lost, although no group is expanded into all of its pairs.
   A block gives a spanning forest of its links, fewer rows than it has classes.

Defined results: null texts and texts without words have no shingles, link with nothing and are their own
component; a text with fewer words than a shingle has one shingle, the whole sequence; an empty table gives an
empty result; columns besides id and text are ignored, whatever their names. Every row counts as a document, with one
row out for each: rows that repeat an id, with one text or several, are compared like any others, and so are rows without an
id. A component is named by its smallest id; one of rows without an id alone has none (null).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import KEY, Scratch, among, bytes_of, keyed, lists, mix, pieces, prepare, spread, windowed, words
from .components import connected_components

SHINGLE, THRESHOLD, TABLES, HALF = 5, 80, 16, 4


def shingle_sets(column, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingles of all texts, and the n + 1 borders."""
    data, at = bytes_of(column)
    _, _, hashed, border = words(data, at, fold=True)
    n, count = len(at) - 1, np.diff(border)
    grams = windowed(hashed, shingle)
    doc = np.repeat(np.arange(n), count)
    whole = np.flatnonzero(doc[: len(grams)] == doc[shingle - 1 :]) if len(grams) else np.zeros(0, np.int64)
    values, owner = grams[whole], doc[whole]
    short = np.flatnonzero((count > 0) & (count < shingle))
    if len(short):
        extra = []
        for i in short:
            w = hashed[border[i] : border[i + 1]]
            extra.append(windowed(w, len(w))[0] ^ np.uint64(len(w)))
        values, owner = np.concatenate([values, np.array(extra, np.uint64)]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        values, owner = values[order], owner[order]
    edge = np.searchsorted(owner, np.arange(n + 1))
    out = values.copy()
    for i in range(n):
        out[edge[i] : edge[i + 1]].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    return out[keep], np.searchsorted(owner[keep], np.arange(n + 1))


def _sketches(shingle: int, tables: int, half: int):
    rng = np.random.default_rng(7)
    k = 2 * tables * half
    mul = rng.integers(0, 1 << 62, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    xor = rng.integers(0, 1 << 63, k, dtype=np.uint64)

    def run(batches):
        for part in pieces(batches):
            values, edge = shingle_sets(part.column("text"), shingle)
            count = np.diff(edge)
            full = np.flatnonzero(count)
            n = part.num_rows
            keys = np.zeros((n, 2 * tables), np.uint64)
            prints = np.zeros((n, 2), np.uint64)
            if len(full):
                at = edge[:-1][full]
                prints[full, 0] = np.add.reduceat(mix(values), at) + count[full].astype(np.uint64)
                prints[full, 1] = np.bitwise_xor.reduceat(mix(values ^ np.uint64(0xA5A5A5A55A5A5A5A)), at)
                for t in range(2 * tables):
                    key = np.full(len(full), np.uint64(t))
                    for h in range(t * half, (t + 1) * half):
                        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat((values ^ xor[h]) * mul[h], at))
                    keys[full, t] = key
            row = np.arange(n + 1) * tables
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id"),
                    part.column("own"),
                    pa.array(count, pa.int64()),
                    pa.array(prints[:, 0].view(np.int64)),
                    pa.array(prints[:, 1].view(np.int64)),
                    lists(np.ascontiguousarray(keys[:, :tables]).ravel().view(np.int64), row, pa.int64()),
                    lists(np.ascontiguousarray(keys[:, tables:]).ravel().view(np.int64), row, pa.int64()),
                ],
                ["id", "own", "n", "f1", "f2", "a", "b"],
            )

    return run


def _sets(shingle: int):
    def run(batches):
        for part in pieces(batches):
            values, edge = shingle_sets(part.column("text"), shingle)
            yield pa.RecordBatch.from_arrays([part.column("id"), lists(values.view(np.int64), edge, pa.int64())], ["id", "s"])

    return run


def _shared(reps: DataFrame, side: str) -> DataFrame:
    """The half keys that two classes or more have, gathered again by class."""
    rows = reps.select("id", F.explode(side).alias("k"))
    many = rows.groupBy("k").agg(F.count("*").alias("c")).where("c > 1").select("k")
    return rows.join(many, "k").groupBy("id").agg(F.collect_list("k").alias(side))  # ``tables`` keys at most


def _linked(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Those pairs (u, v) of which 100 * intersection >= threshold * union on full sets."""
    left = sets.select(F.col("id").alias("u"), F.col("s").alias("su"))
    right = sets.select(F.col("id").alias("v"), F.col("s").alias("sv"))
    both = pairs.join(left, "u").join(right, "v")
    small, large = F.least(F.size("su"), F.size("sv")), F.greatest(F.size("su"), F.size("sv"))
    common = F.when(small * 100 >= large * threshold, F.size(F.array_intersect("su", "sv"))).otherwise(0)
    return both.select("u", "v", common.alias("c"), (small + large).alias("t")).where(f"c > 0 and 100 * c >= {threshold} * (t - c)").select("u", "v")


def _across(threshold: int):
    """Links between components that join all that a block's comparisons join: one less than the components that meet in them."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ask = table["q"].to_numpy(zero_copy_only=False)
        ids, comp = table["id"].to_numpy(), table["comp"].to_numpy().copy()
        lists_ = table["s"].chunk(0) if table.num_rows else pa.array([], pa.list_(pa.int64()))
        edge = lists_.offsets.to_numpy()
        flat = lists_.values.to_numpy()
        size = np.diff(edge)
        owner = np.repeat(np.arange(len(ids)), size)
        held = flat[edge[0] : edge[-1]][~ask[owner]]
        owner = owner[~ask[owner]]
        order = np.argsort(held, kind="stable")
        held, owner = held[order], owner[order]
        us, vs = [], []
        for i in np.flatnonzero(ask):
            s = flat[edge[i] : edge[i + 1]]
            lo, hi = np.searchsorted(held, s, "left"), np.searchsorted(held, s, "right")
            n = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            common = np.bincount(owner[at], minlength=len(ids))
            ok = np.flatnonzero((common > 0) & (comp != comp[i]) & (100 * common >= threshold * (len(s) + size - common)))
            new, at = np.unique(comp[ok], return_index=True)
            ok = ok[at]  # one link to a component joins it
            comp[np.isin(comp, new)] = comp[i]
            us += np.maximum(ids[i], ids[ok]).tolist()
            vs += np.minimum(ids[i], ids[ok]).tolist()
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return run


BLOCK = 512


def _clusters(left: DataFrame, scratch: Scratch, turn: int) -> tuple[DataFrame, DataFrame]:
    """Components that share a table key make up a cluster: (g, id, comp) of its classes, (g, top: its largest component, nm, nq: blocks of ``BLOCK`` that
    its classes and those outside ``top`` fill, outside: their number)."""
    edges = left.where("comp <> top").select(F.col("comp").alias("u"), F.col("top").alias("v"))
    clusters = scratch.save(connected_components(edges, scratch, f"clusters{turn}"), f"clusters{turn}")
    member = left.select("id", "comp").distinct().join(clusters.withColumnRenamed("node", "comp"), "comp").withColumnRenamed("component", "g")
    member = scratch.save(member, f"member{turn}")
    sizes = member.groupBy("g", "comp").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("g").agg(F.max(F.struct("n", "comp")).alias("most"), F.sum("n").alias("n"))
    outside = F.col("n") - F.col("most.n")
    sizes = sizes.select("g", F.col("most.comp").alias("top"), F.ceil(F.col("n") / BLOCK).alias("nm"), F.ceil(outside / BLOCK).alias("nq"), outside.alias("outside"))
    return member, scratch.save(sizes, f"sizes{turn}")


def _compared(rows: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """rows (g, i, j, id, comp, q): links between the components of a block (g, i, j), whose rows with ``q`` are compared with those without."""
    return rows.join(sets, "id").groupBy("g", "i", "j").applyInArrow(_across(threshold), "u long, v long").distinct()


def _dealt(member: DataFrame, sizes: DataFrame, turn: int) -> DataFrame:
    """Every class of a cluster in one block, dealt anew each turn; those outside the largest component ask the others of their block."""
    rows = member.join(sizes, "g").withColumn("i", F.pmod(F.xxhash64("id", F.lit(1000 + turn)), F.col("nm")))
    rows = rows.withColumn("q", F.explode(F.when(F.col("comp") != F.col("top"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    return rows.select("g", "i", F.lit(0).alias("j"), "id", "comp", "q")


def _crossed(member: DataFrame, sizes: DataFrame) -> DataFrame:
    """All classes of a cluster against those outside its largest component, in blocks of ``BLOCK`` by ``BLOCK`` classes.

    So each pair of classes from different components is looked at: at least one of the two is outside the largest.
    """
    rows = member.join(sizes, "g").withColumn("h", F.xxhash64("id", F.lit(17)))
    part = lambda n: F.pmod("h", F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    m = rows.select("g", part("nm").alias("i"), every("nq").alias("j"), "id", "comp", F.lit(False).alias("q"))
    q = rows.where("comp <> top").select("g", every("nm").alias("i"), part("nq").alias("j"), "id", "comp", F.lit(True).alias("q"))
    return m.unionByName(q)


def _rest(met: DataFrame, sets: DataFrame, links: DataFrame, comps: DataFrame, scratch: Scratch, threshold: int) -> DataFrame:
    """comps, joined by the links among what meets (met: key, id) that the comparison with centres didn't find."""
    turn, before, all_ = 0, None, False
    while not all_:
        crowd = met.join(comps.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp"))
        mixed = crowd.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key")
        mixed = mixed.agg(F.max(F.struct("n", "comp"))["comp"].alias("top"), F.count("*").alias("comps")).where("comps > 1")
        left = scratch.save(crowd.join(mixed.select("key", "top"), "key"), f"left{turn}")
        if left.isEmpty():
            break
        member, sizes = _clusters(left, scratch, turn)
        wide = sizes.where("nq > 1")
        outside = wide.agg(F.sum("outside")).first()[0] or 0
        all_ = not outside or before is not None and 2 * outside > before
        before = outside
        rows = _crossed(member, sizes) if all_ else _dealt(member, wide, turn)
        links = scratch.save(links.unionByName(_compared(rows, sets, threshold)), f"links{turn}")
        comps = scratch.save(connected_components(links, scratch, f"cc{turn}"), f"comps{turn}")
        scratch.drop(f"left{turn}", f"member{turn}", f"clusters{turn}", f"links{turn - 1}")
        turn += 1
    return comps


def _found(rows: DataFrame, scratch: Scratch, shingle: int, threshold: int, tables: int, half: int) -> tuple[DataFrame, DataFrame]:
    """rows (id: the row's number, own: its own id, text) -> (sketch (id, own, n, f1, f2), classes (n, f1, f2, component: a row's number))."""
    sketch = scratch.save(rows.mapInArrow(_sketches(shingle, tables, half), "id long, own long, n long, f1 long, f2 long, a array<long>, b array<long>"), "sketch")
    classes = scratch.save(sketch.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("id").alias("rep")), "classes")
    reps = scratch.save(sketch.join(classes.select(F.col("rep").alias("id")), "id").select("id", "a", "b"), "reps")
    met = _shared(reps, "a").join(_shared(reps, "b"), "id")
    keys = met.select("id", F.explode("a").alias("x"), "b").select("id", "x", F.explode("b").alias("y")).select("id", F.xxhash64("x", "y").alias("key"))
    keys = scratch.save(keys, "rows")
    tops = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("c")).where("n > 1").select("key", "c")
    met = scratch.save(keys.join(tops, "key"), "met")
    pairs = met.groupBy(F.col("id").alias("u")).agg(F.min("c").alias("v")).where("u <> v")
    pairs = scratch.save(pairs, "pairs")
    sets = spread(among(rows, met.select("id").distinct(), scratch, "asked", "id")[0])
    sets = scratch.save(sets.mapInArrow(_sets(shingle), "id long, s array<long>"), "sets")
    links = scratch.save(_linked(pairs, sets, threshold), "links")
    comps = scratch.save(connected_components(links, scratch), "comps")

    comps = _rest(met, sets, links, comps, scratch, threshold)
    found = classes.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("n", "f1", "f2", F.coalesce("component", "rep").alias("component"))
    found = scratch.save(found, "found")  # so that Spark can split the rows of a class that many copies share
    scratch.drop("reps", "rows", "met", "pairs", "sets", "links")
    return sketch.drop("a", "b"), found


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD, tables: int = TABLES, half: int = HALF
) -> DataFrame:
    """(id, n_shingles, component): the smallest id reachable over links of ``threshold`` percent similarity or more."""
    prepare(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "minhash")
    docs = keyed(docs.select(F.col(id_col).cast("long").alias("own"), F.col(text_col).alias("text")), scratch)
    rows, found = _found(docs.withColumnRenamed(KEY, "id"), scratch, shingle, threshold, tables, half)
    # the smallest id of each class, then of each component
    least = rows.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("own").alias("least")).join(found, ["n", "f1", "f2"])
    least = scratch.save(least, "least")
    names = least.groupBy("component").agg(F.min("least").alias("name"))
    least = scratch.save(least.join(names, "component").select("n", "f1", "f2", "name"), "names")  # so that Spark can split a class of many copies
    out = rows.join(least, ["n", "f1", "f2"], "left")
    return out.select(F.col("own").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("name")).otherwise(F.col("own")).alias("component"))


def without_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD, tables: int = TABLES, half: int = HALF
) -> DataFrame:
    """The rows of docs, all columns, without all but one of each component: the row with the smallest id (rows without one come last,
    the first of equal rows stays). Rows without words all stay."""
    prepare(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "minhash")
    held = keyed(docs, scratch)
    rows = held.select(F.col(KEY).alias("id"), F.col(id_col).cast("long").alias("own"), F.col(text_col).alias("text"))
    sketch, found = _found(rows, scratch, shingle, threshold, tables, half)
    first = F.min(F.struct(F.col("own").isNull().alias("none"), "own", "id"))
    least = scratch.save(sketch.where("n > 0").groupBy("n", "f1", "f2").agg(first.alias("f")).join(found, ["n", "f1", "f2"]), "least")
    stay = least.groupBy("component").agg(F.min("f").alias("f")).select(F.col("f.id").alias(KEY))
    stay = scratch.save(stay.unionByName(sketch.where("n = 0").select(F.col("id").alias(KEY))), "stay")
    return among(held, stay, scratch, "staying")[0].select(*[f"`{c}`" for c in docs.columns])


def op2_minhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = near_duplicates(docs, shingle=2, threshold=80)
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), (F.col("doc_id") == F.col("component")).alias("kept"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) = 1 THEN [ws[1]]
    ELSE [ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))] END) AS g
  FROM w WHERE ws IS NOT NULL
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)
), links AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM c LEFT JOIN n USING (doc_id)
"""
