"""Nearest neighbours by cosine with randomly rotated one-bit codes.

Unit vectors are turned by a seeded random rotation and kept as sign bits with one correction scalar, the
inner product of the unit vector with its code.  From packed bits and the scalar the cosine to a query
follows with a known error bound.  Per block of rows and block of queries the best estimates are scored
exactly, which gives a floor; every row whose upper bound reaches the floor is reranked exactly.  Rows and
queries meet as blocks: each block of queries is dealt to every group of row blocks.

The query set is stated by the caller.  Every row is coded; nothing is sampled.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite numbers take no part; a query meets
the rows of its own length, as there is no cosine between others; components of any size count, as vectors are
scaled by powers of two, which changes no score; ties go to the smaller vec_id; a query never meets rows of its own vec_id; repeated
rows stay separate candidates; fewer than k candidates give all of them; an empty table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.storage import materialise

EPSILON = 2.5  # width of the error bound in standard deviations of the estimate
FIRST = 32  # estimates scored exactly to get the floor
ROWS, QUERIES = 4096, 512  # rows and queries of a block


@lru_cache(maxsize=8)
def rotation(dim: int, seed: int) -> np.ndarray:
    """Random orthogonal matrix; the dimension is filled up to whole bytes."""
    wide = -(-dim // 8) * 8
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((wide, wide)))
    return q * np.sign(np.diag(r))


def vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that take part, and their vectors in double precision."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), -1))
    rows = np.flatnonzero(sizes == dim)
    flat = column.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    x = flat.reshape(len(rows), dim) if len(rows) else np.zeros((0, dim))
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    return rows[good], x[good]


def near_one(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that their largest component is near 1 and squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def encode(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits and correction scalars of the rows."""
    turned = unit(x) @ turn[: x.shape[1]]
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(1) / np.sqrt(turned.shape[1])


def estimate(bits: np.ndarray, scalars: np.ndarray, queries: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosine of every (query, row), and the half width of each row's bound."""
    wide = turn.shape[1]
    signs = (np.unpackbits(bits, axis=1, count=wide).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(wide))
    turned = (unit(queries) @ turn[: queries.shape[1]]).astype(np.float32)
    width = np.sqrt(np.maximum(1 - scalars**2, 0)) / scalars * EPSILON / np.sqrt(max(wide - 1, 1))
    return (turned @ signs.T) / scalars.astype(np.float32), width


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products summed in the order of the components, so that equal rows get equal scores."""
    return np.cumsum(a * b, axis=1)[:, -1]


def cosine(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return _dot(x, q[None]) / (np.sqrt(_dot(x, x)) * np.sqrt(_dot(q[None], q[None])))


def search_block(ids, x, bits, scalars, query_ids, queries, turn, k):
    """For every query its k best rows of the block: (query, row id, score)."""
    guess, width = estimate(bits, scalars, queries, turn)
    out = []
    for i, own in enumerate(query_ids):
        upper = np.where(ids == own, -np.inf, guess[i] + width)
        allowed = np.where(ids == own, -np.inf, guess[i])
        best = np.argpartition(-allowed, FIRST)[:FIRST] if len(ids) > FIRST else np.arange(len(ids))
        best = best[ids[best] != own]
        first = np.sort(cosine(x[best], queries[i]))[::-1]
        floor = first[k - 1] - 1e-9 if len(first) >= k else -np.inf
        at = np.flatnonzero((upper >= floor) & (ids != own))
        score = cosine(x[at], queries[i])
        order = np.lexsort((ids[at], -score))[:k]
        out.append((np.full(len(order), own), ids[at][order], score[order]))
    return [np.concatenate(c) for c in zip(*out)]


CODED = "dim int, block long, ids binary, vectors binary, bits binary, scalars binary"


def _code_batches(seed: int, size: int):
    def run(batches):
        block = TaskContext.get().partitionId() << 20
        for batch in batches:
            for lo in range(0, batch.num_rows, size):
                part = batch.slice(lo, size)
                lengths = np.asarray(pc.fill_null(pc.list_value_length(part.column("embedding")), 0))
                for dim in np.unique(lengths[lengths > 0]).tolist():
                    rows, x = vectors(part.column("embedding"), dim)
                    if not len(rows):
                        continue
                    x = near_one(x)
                    ids = np.asarray(part.column("vec_id").take(pa.array(rows)), np.int64)
                    blobs = [a.tobytes() for a in (ids, x, *encode(x, rotation(dim, seed)))]
                    cols = [pa.array([dim], pa.int32()), pa.array([block]), *(pa.array([b], pa.binary()) for b in blobs)]
                    yield pa.RecordBatch.from_arrays(cols, ["dim", "block", "ids", "vectors", "bits", "scalars"])
                    block += 1

    return run


def _search_batches(seed: int, k: int):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                raw = {c: batch.column(c)[i].as_buffer() for c in batch.schema.names if c not in ("block", "group", "dim")}
                dim = batch.column("dim")[i].as_py()
                ids, query_ids = np.frombuffer(raw["ids"], np.int64), np.frombuffer(raw["query_ids"], np.int64)
                x, queries = (np.frombuffer(raw[c]).reshape(-1, dim) for c in ("vectors", "queries"))
                bits = np.frombuffer(raw["bits"], np.uint8).reshape(len(ids), -1)
                own, found, score = search_block(ids, x, bits, np.frombuffer(raw["scalars"]), query_ids, queries, rotation(dim, seed), k)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(found), pa.array(score)], ["query_id", "vec_id", "score"])

    return run


def search(rows: DataFrame, is_query: Column, k: int = 5, seed: int = 5) -> DataFrame:
    """The k nearest rows of every query row: query_id, rank, vec_id, score."""
    spark = rows.sparkSession
    rows = rows.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    kind = "query_id long, vec_id long, score double"
    coded = materialise(rows.mapInArrow(_code_batches(seed, ROWS), CODED), "ann_rows")
    asked = rows.where(is_query).mapInArrow(_code_batches(seed, QUERIES), CODED)
    groups = int(spark.conf.get("spark.sql.shuffle.partitions"))
    left = coded.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))
    right = asked.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), "dim", F.col("ids").alias("query_ids"), F.col("vectors").alias("queries"))
    met = left.join(right, ["group", "dim"]).mapInArrow(_search_batches(seed, k), kind)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
