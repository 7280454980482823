"""Connected components over an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.llm._base import release, written

#: A node with more than one in so many edges is a hot one.
HOT = 1000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b"))).first())


def _with_lowest(edges: DataFrame, low: DataFrame, key: str, count: int) -> DataFrame:
    """edges joined with low (u, m, n) on key = u; the nodes of more than one in HOT edges, which are few, by a broadcast."""
    hot = F.col("n") > max(1, count // HOT)
    common = F.broadcast(low.where(hot).drop("n"))  # 2 * HOT rows at most: an edge has two ends
    on = F.col(key) == F.col("u")
    return edges.join(common, on).unionByName(edges.join(common.select("u"), on, "left_anti").join(low.where(~hot).drop("n"), on))


def _large_star(edges: DataFrame, count: int) -> DataFrame:
    """Every larger neighbour of u is linked to the smallest of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"), "n")
    return _with_lowest(both.where("b > a"), low, "a", count).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, count: int) -> DataFrame:
    """u (the larger end) and its smaller neighbours are linked to the smallest of them."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).withColumnRenamed("a", "u")
    joined = _with_lowest(edges, low, "a", count)
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))


def lowest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (a, b), sorted, and the smallest node that each of them reaches."""
    node, ends = np.unique(np.r_[a, b], return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(node))
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return node, node[root]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [[np.asarray(batch.column(k)) for k in (0, 1)] for batch in batches]
    if parts:
        node, component = lowest(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        for at in range(0, len(node), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)]) for x in (node, component)], names=["node", "component"])
    release()


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, small: int = 0) -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest node reachable.

    Self-loops and repeated edges are ignored, edges with a null end too. Each star is written to the shared
    folder, so its lineage is short; minima are taken map-side first, and hot nodes, of which there can be few, are
    joined by a broadcast. Rounds grow with the logarithm of the longest path. Up to `small` edges (counted; longs) take one task
    and no rounds.
    """
    now = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    now = written(now, "edges")
    seen = _state(now)
    if seen[0] <= small:
        return now.coalesce(1).mapInArrow(_in_one_task, "node long, component long")
    for _ in range(max_rounds):
        if not seen[0]:
            break
        now = written(_large_star(now, seen[0]).distinct(), "edges")
        now = written(_small_star(now, seen[0]).distinct(), "edges")
        state = _state(now)
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
