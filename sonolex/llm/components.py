"""Connected components of an edge table: forests of chunks, then one task or rounds of large-star and small-star.

Each task first replaces its edges, chunk by chunk, by a star for each component of the chunk: no shuffle, and fewer rows than the
chunk has nodes. Up to ``SMALL`` edges are then solved by one task, whose memory that bounds. More of them go through alternating
rounds (Kiveris et al., "Connected Components in MapReduce and Beyond") until the components are known or ``SMALL`` edges are left.
In a round, neighbourhoods are only ever reduced to their minimum, so a vertex with a third of all edges costs a partial
aggregation and a join that Spark can split, never a collected list. Every round is written to the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, release

#: Edges that one task solves (16 MB, and a few times that while it sorts them); edges of a chunk.
SMALL, CHUNK = 1 << 20, 1 << 18


def _least(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (u, v), sorted, and the smallest that each reaches.

    Roots hook on to their smallest neighbour, then all point at their root; two turns halve the roots that have neighbours."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        a, b = root[a], root[b]
        apart = a != b
        if not apart.any():
            return nodes, nodes[root]
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != (up := root[root])).any():
            root = up


def _edges(batches, most: int | None):
    """Arrays (u, v) of the batches, of about ``most`` edges or all at once."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if most and n >= most:
            yield [np.concatenate([x.column(c).to_numpy() for x in held]) for c in ("u", "v")]
            held, n = [], 0
    if n:
        yield [np.concatenate([x.column(c).to_numpy() for x in held]) for c in ("u", "v")]


def _stars(most: int):
    def run(batches):
        for u, v in _edges(batches, most):
            node, root = _least(u, v)
            leaf = node != root
            yield pa.RecordBatch.from_arrays([pa.array(node[leaf]), pa.array(root[leaf])], ["u", "v"])
        release()

    return run


def _solved(batches):
    for u, v in _edges(batches, None):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in _least(u, v)], ["node", "component"])
    release()


def connected_components(edges: DataFrame, scratch: Scratch, tag: str = "cc") -> DataFrame:
    """edges (u, v: long) -> (node, component): the smallest node reachable; nodes without edges don't appear.

    Nulls and self-loops are ignored, repeated edges count once, an empty table gives an empty one.
    """
    now = scratch.save(edges.where("u <> v").select("u", "v").mapInArrow(_stars(CHUNK), "u long, v long"), f"{tag}-0")
    n, mark, k = now.count(), None, 0
    while n > SMALL:
        # large star: every larger neighbour (and the vertex) links to the vertex's smallest neighbour
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = least.where("m < u").select("u", F.col("m").alias("v"))
        large = scratch.save(large.unionByName(own).where("u <> v").distinct(), f"{tag}-l{k}")
        # small star: the vertex and its smaller neighbours link to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        nxt = scratch.save(small.where("u <> v").distinct(), f"{tag}-{k + 1}")
        seen = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(f"{tag}-l{k}", f"{tag}-{k}")
        now, n, k = nxt, seen[0], k + 1
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    if n <= SMALL:
        return now.repartition(1).mapInArrow(_solved, "node long, component long")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    ).groupBy("node").agg(F.min("component").alias("component"))
