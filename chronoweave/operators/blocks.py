"""Blocks as array rows, and ordered state carried from block to block."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.operators.series import Layout
from chronoweave.storage import materialise


def block_arrays(layout: Layout, columns: list[str], *, with_halo: bool = False) -> DataFrame:
    """One row per block: ``first_i`` and one array per column in series order.

    A block holds at most ``block_rows`` rows (plus the halo), so the arrays are bounded.
    """
    rows = layout.df if with_halo else layout.df.where("core")
    has_core = F.bool_or("core")
    packed = (
        rows.groupBy(*layout.block_key)
        .agg(F.array_sort(F.collect_list(F.struct("i", *columns))).alias("_a"), has_core.alias("_core"))
        .where("_core")
    )
    arrays = [F.col(f"_a.{c}").alias(c) for c in columns]
    return packed.select(*layout.block_key, F.element_at("_a", 1)["i"].alias("first_i"), *arrays)


def unpack(blocks: DataFrame, layout: Layout, arrays: dict[str, str], first: str | None = None) -> DataFrame:
    """Back to one row per sample: ``arrays`` maps array columns to output names.

    Arrays of core rows start at the first row of their block unless ``first`` names a column.
    """
    start = F.col("blk") * layout.block_rows if first is None else F.col(first)
    zipped = F.arrays_zip(*[F.col(a).alias(out) for a, out in arrays.items()])
    names = list(arrays.values())
    return blocks.select(*layout.block_key, start.alias("_f"), F.posexplode(zipped).alias("_p", "_z")).select(
        *layout.block_key, (F.col("_f") + F.col("_p")).alias("i"), *[F.col("_z")[n].alias(n) for n in names]
    )


Step = Callable[[dict, list | None], tuple[list, list | None]]


def stateful_scan(
    blocks: DataFrame,
    key: list[str],
    inputs: list[str],
    step: Step,
    out_type: T.DataType,
    *,
    spans_blocks: bool,
    keep: list[str] = (),
) -> DataFrame:
    """Ordered fold over the blocks of each recording; adds the array column ``out``.

    ``keep`` names further array columns that are passed through.

    ``step(arrays of one block, carry)`` returns the outputs of the block and the next carry (a short
    list of doubles, ``None`` before the first sample).  The fold runs block by block in parallel:
    every block first starts without a carry, then blocks whose true carry differs are repeated
    until no carry changes.  Trackers forget their start within a few samples, so a second round
    usually settles it; the result is that of the sequential fold in any case.
    """
    def schema(passed: list[str]) -> T.StructType:
        return blocks.select(*key, "blk", *passed).schema.add("out", T.ArrayType(out_type)).add("carry_out", T.ArrayType(T.DoubleType()))

    def run(passed: list[str], parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            outs, carries = [], []
            for row in pdf.to_dict("records"):
                carry = row["carry_in"]
                out, carry = step({c: row[c] for c in inputs}, None if carry is None else list(carry))
                outs.append(out)
                carries.append(carry)
            yield pdf[[*key, "blk", *passed]].assign(out=outs, carry_out=carries)

    def fold(rows: DataFrame, passed: list[str] = ()) -> DataFrame:
        needed = list(dict.fromkeys([*inputs, *passed]))
        return rows.select(*key, "blk", "carry_in", *needed).mapInPandas(lambda p: run(list(passed), p), schema(passed))

    nothing = F.lit(None).cast("array<double>")
    if not spans_blocks:
        return fold(blocks.withColumn("carry_in", nothing), keep).drop("carry_out")

    block_key = [*key, "blk"]
    order = Window.partitionBy(*key).orderBy("blk")
    state = materialise(
        fold(blocks.withColumn("carry_in", nothing)).select(*block_key, "carry_out").withColumn("carry_in", nothing), "carry"
    )
    while True:
        wanted = state.withColumn("want", F.lag("carry_out").over(order))
        stale = materialise(wanted.where(~F.col("want").eqNullSafe(F.col("carry_in"))).select(*block_key, F.col("want").alias("carry_in")), "stale")
        if stale.isEmpty():
            break
        redone = fold(blocks.join(stale, block_key)).select(*block_key, F.col("carry_out").alias("_new"))
        fresh = stale.withColumnRenamed("carry_in", "_in").join(redone, block_key)
        state = materialise(
            state.join(fresh, block_key, "left").select(
                *block_key,
                F.when(F.col("_in").isNotNull(), F.col("_new")).otherwise(F.col("carry_out")).alias("carry_out"),
                F.coalesce("_in", "carry_in").alias("carry_in"),
            ),
            "carry",
        )
    return fold(blocks.join(state.select(*block_key, "carry_in"), block_key), keep).drop("carry_out")
