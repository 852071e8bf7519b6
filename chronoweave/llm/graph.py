"""Connected components of an edge table: stars of chunks of at most ``CHUNK`` edges, then alternating large and small stars.

The number of tasks follows the number of edges, which is known before.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.storage import materialise, release

CHUNK = 1 << 16


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the edges with the smallest node of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    above, x, y = np.arange(len(nodes)), at[: len(a)], at[len(a) :]
    while len(x):
        np.minimum.at(above, x, above[y])
        np.minimum.at(above, y, above[x])
        while (above != (up := above[above])).any():
            above = up
        x, y = above[x], above[y]
        x, y = x[x != y], y[x != y]
    return nodes, nodes[above]


def _chunk_batches(batches):
    """Edges to the smallest node within every chunk, the smallest node itself included."""
    held, n = [], 0

    def settle():
        a, b = (np.concatenate([np.asarray(x.column(c)) for x in held]) for c in "ab")
        for lo in range(0, len(a), CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in stars(a[lo : lo + CHUNK], b[lo : lo + CHUNK])], ["a", "b"])

    for batch in batches:
        if n + len(batch) > CHUNK and held:
            yield from settle()
            held, n = [], 0
        if len(batch):
            held.append(batch)
            n += len(batch)
    if held:
        yield from settle()


def _large(edges: DataFrame, scratch: list[DataFrame], tasks: int) -> DataFrame:
    """Every larger neighbour of a node goes to the smallest of the node and its neighbours; ``scratch`` gets what is written."""
    both = materialise(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(2 * tasks), "star")
    least = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).coalesce(tasks), "star_min")
    scratch += [both, least]
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame, scratch: list[DataFrame], tasks: int) -> DataFrame:
    """Edges point from larger to smaller; every neighbour of a node, and the node, goes to the smallest."""
    edges = materialise(edges.coalesce(tasks), "star")
    least = materialise(edges.groupBy("a").agg(F.min("b").alias("m")).coalesce(tasks), "star_min")
    scratch += [edges, least]
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of every node of the edges (a, b); longs, loops allowed."""
    edges = edges.where("a <> b").select("a", "b")
    n = edges.count()
    held = edges.coalesce(max(1, -(-n // CHUNK))).mapInArrow(_chunk_batches, "a long, b long")
    if n <= CHUNK:  # one chunk is the whole graph
        return held.select(F.col("a").alias("node"), F.col("b").alias("component"))
    current, seen = materialise(held.where("a <> b"), "edges"), None
    while True:
        mark = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or tuple(mark) == seen:
            break
        seen = tuple(mark)
        scratch = [current]
        tasks = max(1, -(-mark[0] // CHUNK))
        current = materialise(_small(_large(current, scratch, tasks), scratch, tasks).coalesce(tasks), "edges")
        release(*scratch)
    star = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return star.unionByName(star.select(F.col("component").alias("node"), "component")).distinct()
