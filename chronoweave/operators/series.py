"""Series layout: every ordered operator works on bounded, overlapping row blocks.

A recording may be any size (one key may hold a third of all rows), so no operator may put
``PARTITION BY recording`` on raw rows.  ``lay_out`` gives every row its position ``i`` in its
recording and cuts the recording into blocks of ``block_rows`` rows.  Each block also carries
``halo`` rows of its neighbours on both sides (``core = false``).  A window function over
``(recording, blk)`` with a frame of at most ``halo`` rows is then exact on the core rows, and a
task never sees more than ``block_rows + 2 * halo`` rows of one recording.  The blocks are written
once, bucketed by ``(recording, blk)``: later windows and joins on that key need no exchange.

Anything that reaches further than the halo follows three steps: summarise each block, scan the
few block summaries of a recording, attach the scanned value to the block (``attach``).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from chronoweave.storage import materialise, materialise_bucketed, release

BLOCK_ROWS = 65_536
HALO_ROWS = 64
ROWS_PER_SORT_PARTITION = 4_000_000
ROWS_PER_BUCKET = 4_000_000
MIN_ROWS = 5_000


@dataclass(frozen=True)
class Layout:
    """Blocks of a set of recordings.  ``df`` has ``key..., blk, i, core`` and the payload."""

    df: DataFrame
    key: tuple[str, ...]
    block_rows: int
    halo: int
    last_block: int
    blocks: DataFrame  # one row per (key, blk)
    buckets: int = 1

    @property
    def block_key(self) -> list[str]:
        return [*self.key, "blk"]

    @property
    def spans_blocks(self) -> bool:
        return self.last_block > 0

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.block_key).orderBy("i")

    def frame(self, start: int, end: int) -> WindowSpec:
        """Row frame; refused when it would reach beyond the halo."""
        self.check_reach(max(-start, end))
        return self.window().rowsBetween(start, end)

    def check_reach(self, rows: int) -> None:
        if rows > self.halo:
            raise ValueError(f"operator reaches {rows} rows, the layout holds a halo of {self.halo}")

    def centred(self, width: int) -> WindowSpec:
        """Centred frame; an even width leans to the past."""
        return self.frame(-(width // 2), width - 1 - width // 2)

    def with_df(self, df: DataFrame) -> "Layout":
        return replace(self, df=df)

    def core(self) -> DataFrame:
        return self.df.where("core").drop("core")


def partitions_for(rows: int, per_partition: int, parallelism: int) -> int:
    """Enough partitions for the size; at least one per core unless the parts would become tiny."""
    by_size, by_core = -(-rows // per_partition), min(parallelism, -(-rows // MIN_ROWS))
    return max(1, by_size, by_core)


def index_rows(df: DataFrame, key: list[str], order: list[str], *, derived: bool = False) -> tuple[DataFrame, int]:
    """Add the dense position ``i`` (from 0) of each row in its recording.

    A range partitioning on ``(key, order)`` splits hot recordings over many tasks.  Each sorted
    partition numbers its rows; only the run lengths, one row per (recording, partition), are
    summed up per recording to find where a partition's run starts.  Counting, sampling the range
    bounds and sorting each read the input: ``derived`` writes an input that is costly to compute.
    """
    spark = df.sparkSession
    df = materialise(df, "derived") if derived else df
    rows = df.count()
    parts = partitions_for(rows, ROWS_PER_SORT_PARTITION, spark.sparkContext.defaultParallelism)
    numbered = (
        df.repartitionByRange(parts, *key, *order)
        .sortWithinPartitions(*key, *order)
        .withColumn("_pos", F.monotonically_increasing_id())
        .withColumn("_run", F.shiftright("_pos", 33))
    )
    numbered = materialise(numbered, "numbered")
    if derived:
        release(df)
    before = Window.partitionBy(*key).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = (
        numbered.groupBy(*key, "_run")
        .agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_len"))
        .select(*key, "_run", (F.col("_first") - F.coalesce(F.sum("_len").over(before), F.lit(0))).alias("_zero"))
    )
    indexed = (
        numbered.join(runs, [*key, "_run"])
        .withColumn("i", F.col("_pos") - F.col("_zero"))
        .drop("_pos", "_run", "_zero")
    )
    return indexed, rows


def lay_out(
    df: DataFrame,
    key: list[str],
    order: list[str],
    *,
    block_rows: int = BLOCK_ROWS,
    halo: int = HALO_ROWS,
    label: str = "series",
    derived: bool = False,
) -> Layout:
    """Index, block and write the recordings in ``df``.  ``key`` must not be NULL."""
    indexed, rows = index_rows(df, key, order, derived=derived)
    layout = block_rows_of(indexed, key, rows, block_rows=block_rows, halo=halo, label=label)
    release(indexed)  # the numbered rows: the blocks hold all of them
    return layout


def block_rows_of(
    indexed: DataFrame, key: list[str], rows: int, *, block_rows: int = BLOCK_ROWS, halo: int = HALO_ROWS, label: str = "series"
) -> Layout:
    """Block and write rows that carry their position ``i``; about ``rows`` rows are expected."""
    if halo >= block_rows:
        raise ValueError("the halo must be smaller than a block")
    spark = indexed.sparkSession
    blocks = F.sequence(
        F.expr(f"greatest(i - {halo}, 0) div {block_rows}"), F.expr(f"(i + {halo}) div {block_rows}")
    )
    overlapped = (
        indexed.withColumn("_home", F.expr(f"i div {block_rows}"))
        .withColumn("blk", F.explode(blocks))
        .withColumn("core", F.col("blk") == F.col("_home"))
        .drop("_home")
    )
    buckets = partitions_for(rows, ROWS_PER_BUCKET, spark.sparkContext.defaultParallelism)
    written = materialise_bucketed(overlapped, label, buckets, [*key, "blk"], [*key, "blk", "i"])
    blocks = written.where("core").select(*key, "blk").distinct()  # bucketed: no exchange
    last = written.where("core").agg(F.max("blk")).first()[0]
    return Layout(written, tuple(key), block_rows, halo, int(last or 0), blocks, buckets)


def attach(layout: Layout, rows: DataFrame, per_recording: DataFrame) -> DataFrame:
    """Add per-recording columns to rows of the layout without joining on the hot key.

    The per-recording table is first spread over the blocks (one row per block), then joined on
    ``(recording, blk)``, so the large side keeps its partitioning and no key is hot.
    """
    if layout.spans_blocks:
        spread = layout.blocks.join(per_recording, list(layout.key))
    else:
        spread = per_recording.withColumn("blk", F.lit(0).cast("long"))
    return rows.join(spread, layout.block_key, "left")


def scan_blocks(layout: Layout, summary: DataFrame, **scans: tuple[Column, int, int | None]) -> DataFrame:
    """Scan block summaries of each recording: ``name=(aggregate, from_block, to_block)``."""
    base = Window.partitionBy(*layout.key).orderBy("blk")
    lo, hi = Window.unboundedPreceding, Window.unboundedFollowing
    cols = [
        agg.over(base.rowsBetween(lo if a is None else a, hi if b is None else b)).alias(name)
        for name, (agg, a, b) in scans.items()
    ]
    return summary.select(*layout.block_key, *cols)


def bracket(
    layout: Layout, rows: DataFrame, value: str, axis: str = "i", valid: Column | None = None, *, with_halo: bool = False
) -> DataFrame:
    """``bracket_many`` for one value; adds ``prev`` and ``next``."""
    known = F.col(value).isNotNull() if valid is None else valid
    return bracket_many(layout, rows, {"": (value, axis, known)}, with_halo=with_halo)


def bracket_many(
    layout: Layout, rows: DataFrame, samples: dict[str, tuple[str, str, Column]], *, with_halo: bool = False
) -> DataFrame:
    """Add ``prev<name>`` and ``next<name>``: the closest sample at or before / at or after each row.

    ``samples`` maps a name suffix to (value, axis, is-a-sample).  The columns are structs
    ``(i, x, v)`` with ``x`` from the axis.  ``rows`` are core rows; with ``with_halo`` they are all
    rows of the layout and halo rows are bracketed too.  Samples outside the block come in through
    one table of block summaries, however far away they are.
    """
    w = layout.window()
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    packed = {
        f"_s{name}": F.when(known, F.struct(F.col("i"), F.col(axis).alias("x"), F.col(value).alias("v")))
        for name, (value, axis, known) in samples.items()
    }
    rows = rows.withColumns(packed)
    both = {}
    for name in samples:
        both[f"prev{name}"] = F.last(f"_s{name}", ignorenulls=True).over(back)
        both[f"next{name}"] = F.first(f"_s{name}", ignorenulls=True).over(ahead)
    rows = rows.withColumns(both)
    if layout.spans_blocks:
        # What a block sees itself (its halo included) must not come back as carried sample.
        seen = layout.halo if with_halo else 0
        within = F.col("i") - F.col("blk") * layout.block_rows
        core = rows.where("core") if with_halo else rows
        ends, scans = [], {}
        for name in samples:
            s = F.col(f"_s{name}")
            ends += [
                F.max(s).alias(f"_l{name}"),
                F.max(F.when(within < layout.block_rows - seen, s)).alias(f"_lf{name}"),
                F.min(s).alias(f"_f{name}"),
                F.min(F.when(within >= seen, s)).alias(f"_ff{name}"),
            ]
            scans[f"_b1{name}"] = (F.last(f"_lf{name}"), -1, -1)
            scans[f"_b2{name}"] = (F.last(f"_l{name}", ignorenulls=True), None, -2)
            scans[f"_a1{name}"] = (F.first(f"_ff{name}"), 1, 1)
            scans[f"_a2{name}"] = (F.first(f"_f{name}", ignorenulls=True), 2, None)
        carried = scan_blocks(layout, core.groupBy(*layout.block_key).agg(*ends), **scans)
        rows = rows.join(carried, layout.block_key, "left")
        whole = {f"prev{name}": F.coalesce(f"prev{name}", f"_b1{name}", f"_b2{name}") for name in samples}
        whole |= {f"next{name}": F.coalesce(f"next{name}", f"_a1{name}", f"_a2{name}") for name in samples}
        rows = rows.withColumns(whole).drop(*scans)
    return rows.drop(*[f"_s{name}" for name in samples])


def salted_join(rows: DataFrame, small: DataFrame, key: list[str], spread_by: str, salts: int = 32) -> DataFrame:
    """Inner join with a small per-key table, splitting each key of the large side into ``salts`` parts."""
    left = rows.withColumn("_salt", F.pmod(F.col(spread_by), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*key, "_salt"]).drop("_salt")
