"""Mixing sources to target weights by fitting subset sums.

Documents are counted by (source, exact length).  Each source's target is met by whole passes over the
source and a part of one more pass.  The part is fitted on the counts: every length gives its
proportional share, and a bounded knapsack over the lengths left closes the gap.  The chosen number of
documents of each length is then taken by a seeded hash, in buckets of bounded size.  ``mix`` says what is
taken of every document, ``repeat`` gives the rows themselves as often as they are taken: of each source and
length the hash of the last document taken is found, so a row is decided where it lies.

Defined cases: a null text has size 0; documents of size 0 are never taken; sources are ordered by code
point with null last; a source without words has target 0; repeated rows are separate documents; rows
with equal hash are ordered by ``doc_id``; further columns are not looked at and may have any name; an empty
table gives an empty mix.  In ``repeat`` rows equal in doc_id, source and text are taken alike.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.llm import text as tx
from chronoweave.llm.sieve import free_name
from chronoweave.storage import materialise

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MAX_PASSES = 2
TABLE = 1 << 16  # words that the knapsack closes exactly
BUCKET = 256  # documents in a bucket of one source and length, about


def _count_words(batches):
    for batch in batches:
        n = [tx.counts_between(tx.word_spans(data, offsets)[0], offsets) for _, _, data, offsets in tx.slices(batch.column("text"))]
        size = np.concatenate(n).astype(np.int64) if n else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(size)], ["doc_id", "source", "size"])


def sizes(docs: DataFrame) -> DataFrame:
    cols = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))
    return cols.mapInArrow(_count_words, "doc_id long, source string, size long")


def knapsack(lengths: np.ndarray, left: np.ndarray, goal: int) -> tuple[np.ndarray, int]:
    """How many of each length to take so that their sum comes as near below ``goal`` as it can.

    Reachable sums are the bits of an integer; counts are split into powers of two.
    """
    take = np.zeros(len(lengths), np.int64)
    reach, mask, steps = 1, (1 << (goal + 1)) - 1, []
    for i in np.argsort(-lengths, kind="stable"):
        length, n, m = int(lengths[i]), int(left[i]), 1
        n = min(n, goal // length)
        while n > 0 and not reach >> goal & 1:
            m = min(m, n)
            steps.append((i, m, reach))
            reach |= (reach << (length * m)) & mask
            n, m = n - m, 2 * m
    at = best = reach.bit_length() - 1
    for i, m, before in reversed(steps):
        if not before >> at & 1:
            take[i] += m
            at -= int(lengths[i]) * m
    return take, best


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Documents to take of each length; their words sum to ``budget`` or as near below it as found."""
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    take = np.minimum(counts, np.floor(counts * (max(budget, 0) / max(total, 1))).astype(np.int64))
    for i in np.flatnonzero(take):  # rounding of very large counts must not overshoot
        if (over := int((lengths * take).sum()) - budget) <= 0:
            break
        take[i] -= min(int(take[i]), -(-over // int(lengths[i])))
    rest = budget - int((lengths * take).sum())
    for i in np.argsort(-lengths, kind="stable"):
        if rest <= TABLE:
            break
        more = min(int(counts[i] - take[i]), max(0, rest - TABLE // 2) // int(lengths[i]))
        take[i] += more
        rest -= more * int(lengths[i])
    more, _ = knapsack(lengths, counts - take, rest)
    return take + more


def _fit_source(group: pd.DataFrame) -> pd.DataFrame:
    passes, extra = int(group["passes"].iloc[0]), int(group["extra_words"].iloc[0])
    group = group.sort_values("size")
    return pd.DataFrame(
        {
            "source": group["source"],
            "size": group["size"],
            "n_docs": group["n_docs"],
            "passes": passes,
            "extra": fit_budget(group["size"].to_numpy(), group["n_docs"].to_numpy(), extra),
        }
    )


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """Target words of each source: shares by weight, cut at ``MAX_PASSES`` times the source, the excess
    dealt again by weight until nothing is above.

    The level at which sources are cut follows from running sums over the sources in the order of
    limit / weight; one row per source takes part.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (rank % len(weights) + 1).cast("int"))
    limit = (MAX_PASSES * F.col("source_size")).cast("double")
    rows = by.withColumn("weight", weight).withColumn("limit", limit)
    rows = rows.withColumn("ratio", F.col("limit") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    rows = rows.withColumn("goal", F.sum("source_size").over(everything) * F.lit(float(share)))
    left = F.col("goal") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left / F.sum("weight").over(after))
    # The level falls below the ratio at the first source that is not cut.
    level = F.min(F.when(F.col("level") < F.col("ratio"), F.struct("ratio", F.col("level")))).over(everything)
    target = F.when(level.isNull() | (F.col("ratio") < level["ratio"]), F.col("limit")).otherwise(level["level"] * F.col("weight"))
    return rows.select("source", "source_size", F.least(target, F.col("limit")).alias("target"))


def _plan(sized: DataFrame, weights, share: float) -> tuple[DataFrame, DataFrame]:
    """Targets of the sources with their whole passes, and the documents to take of each source and length."""
    goals = materialise(targets(sized, weights, share), "mix_targets")
    passes = F.least(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(MAX_PASSES)).cast("long")
    budget = goals.withColumn("passes", F.coalesce(passes, F.lit(0)))
    budget = budget.withColumn("extra_words", F.floor(F.col("target") - F.col("passes") * F.col("source_size")).cast("long"))
    counts = sized.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n_docs"))
    counts = counts.join(budget.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    kind = "source string, size long, n_docs long, passes long, extra long"
    return budget, materialise(counts.groupBy("source").applyInPandas(_fit_source, kind), "mix_plan")


def _bucket() -> F.Column:
    return F.pmod(F.col("h"), F.coalesce(F.ceil(F.col("n_docs") / BUCKET), F.lit(1)))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, seed: int = 11) -> DataFrame:
    """doc_id, source, size, source_size, target and taken words of every document."""
    sized = materialise(sizes(docs), "mix_sizes")
    budget, plan = _plan(sized, weights, share)
    goals = budget.drop("passes", "extra_words")
    p = plan.select(F.col("source").alias("p_source"), F.col("size").alias("p_size"), "n_docs", "passes", "extra")
    hashed = sized.join(p, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size")), "left").drop("p_source", "p_size")
    hashed = hashed.withColumn("h", F.xxhash64(F.lit(seed), "doc_id"))
    hashed = hashed.withColumn("bucket", _bucket())
    hashed = materialise(hashed, "mix_hashed")
    held = hashed.groupBy("source", "size", "bucket").agg(F.count(F.lit(1)).alias("in_bucket"))
    run = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(
        F.col("source").alias("b_source"), F.col("size").alias("b_size"), F.col("bucket").alias("b"), F.coalesce(F.sum("in_bucket").over(run), F.lit(0)).alias("earlier")
    )
    same = F.col("source").eqNullSafe(F.col("b_source")) & (F.col("size") == F.col("b_size")) & (F.col("bucket") == F.col("b"))
    ranked = hashed.join(held, same).drop("b_source", "b_size", "b")
    place = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("h", "doc_id"))
    picked = (F.col("earlier") + place <= F.coalesce("extra", F.lit(0))).cast("long")
    ranked = ranked.withColumn("copies", F.coalesce("passes", F.lit(0)) + picked)
    goals = goals.withColumnRenamed("source", "g_source")
    out = ranked.join(goals, F.col("source").eqNullSafe(F.col("g_source")))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def _size_batches(drop: bool, name: str):
    """Words of each row's text beside its columns, or in place of the text."""

    def run(batches):
        for batch in batches:
            n = [tx.counts_between(tx.word_spans(data, offsets)[0], offsets) for _, _, data, offsets in tx.slices(batch.column("text"))]
            size = pa.array(np.concatenate(n).astype(np.int64) if n else np.zeros(0, np.int64))
            names = [c for c in batch.schema.names if c != "text" or not drop]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), size], [*names, name])

    return run


def _last_taken(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """For each source and length of which a part is taken: bucket and hash of the last document of the part."""
    part = plan.where("extra > 0").select(F.col("source").alias("p_source"), F.col("size").alias("p_size"), "n_docs", "extra")
    same = F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size"))
    rows = materialise(sized.join(part, same).drop("p_source", "p_size").withColumn("bucket", _bucket()), "mix_part")
    held = rows.groupBy("source", "size", "bucket").agg(F.count(F.lit(1)).alias("n"), F.first("extra").alias("extra"))
    run = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("place", F.col("extra") - F.coalesce(F.sum("n").over(run), F.lit(0))).where("place between 1 and n")
    held = held.select(F.col("source").alias("b_source"), F.col("size").alias("b_size"), F.col("bucket").alias("b"), "place")
    same = F.col("source").eqNullSafe(F.col("b_source")) & (F.col("size") == F.col("b_size")) & (F.col("bucket") == F.col("b"))
    rows = rows.join(held, same).withColumn("r", F.row_number().over(Window.partitionBy("source", "size").orderBy("h")))
    return rows.where("r = place").select("source", "size", "n_docs", "bucket", "h")


def repeat(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, seed: int = 11) -> DataFrame:
    """The rows of ``docs``, with all their columns, as often as the mix takes them."""
    text, source = F.col("text").cast("string"), F.col("source").cast("string")
    h = F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), text)
    narrow = docs.select(h.alias("h"), source.alias("source"), text.alias("text"))
    sized = materialise(narrow.mapInArrow(_size_batches(True, "size"), "h long, source string, size long"), "mix_sizes")
    budget, plan = _plan(sized, weights, share)
    t = free_name(docs)
    last = materialise(_last_taken(sized, plan), "mix_last").select(*(F.col(c).alias(t + c) for c in ("source", "size", "n_docs", "bucket", "h")))
    passes = budget.select(F.col("source").alias(f"{t}of"), F.col("passes").alias(f"{t}passes"))
    rows = docs.mapInArrow(_size_batches(False, f"{t}words"), T.StructType([*docs.schema.fields, T.StructField(f"{t}words", T.LongType())]))
    rows = rows.where(F.col(f"{t}words") > 0).join(passes, source.eqNullSafe(F.col(f"{t}of")))
    rows = rows.join(last, source.eqNullSafe(F.col(f"{t}source")) & (F.col(f"{t}words") == F.col(f"{t}size")), "left")
    bucket = F.pmod(h, F.ceil(F.col(f"{t}n_docs") / BUCKET))
    more = (bucket < F.col(f"{t}bucket")) | ((bucket == F.col(f"{t}bucket")) & (h <= F.col(f"{t}h")))
    copies = (F.col(f"{t}passes") + F.coalesce(more.cast("long"), F.lit(0))).cast("int")
    times = F.when(copies > 0, F.sequence(F.lit(1), copies))
    return rows.withColumn(f"{t}copy", F.explode(times)).select(*(F.col(f"`{c}`") for c in docs.columns))
