"""Sensor and reference CSV recordings as series tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions.columns import as_number, clock_seconds
from chronoweave.operators.series import HALO_ROWS, BLOCK_ROWS, Layout, index_rows, lay_out, salted_join

# Column names of the sensor export and the channel names they map to.
SENSOR_COLUMNS = {
    "Uc1(mV)": "uc1",
    "Uc2(mV)": "uc2",
    "Ut1(mV)": "hf1",
    "Ut2(mV)": "hf2",
    "PPG_Green": "ppg_green",
    "PPG_Red": "ppg_red",
    "PPG_IR": "ppg_ir",
    "AccX(g)": "accx",
    "AccY(g)": "accy",
    "AccZ(g)": "accz",
    "GyroX(dps)": "gyrox",
    "GyroY(dps)": "gyroy",
    "GyroZ(dps)": "gyroz",
}
TIME_WORDS = ["time", "seconds", "sec"]
HR_WORDS = ["hr", "heart", "bpm"]
SECOND_LAYOUT_SKIP = 3


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.csv$", "")


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines of text files with their position: file, block start and order inside the block."""
    return spark.read.text(paths).select(
        _stem(F.col("_metadata.file_path")).alias("sample_id"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
        "value",
    )


def _fields(line: Column) -> Column:
    """Comma-separated fields without a byte-order mark; a quoted field may hold commas and doubled quotes."""
    clean = F.regexp_replace(line, "^﻿", "")
    outside = ',(?=(?:[^"]*"[^"]*")*[^"]*$)'
    quoted = F.transform(F.split(clean, outside, -1), lambda f: F.trim(F.replace(F.regexp_replace(F.trim(f), '^"|"$', ""), F.lit('""'), F.lit('"'))))
    plain = F.transform(F.split(clean, ",", -1), lambda f: F.trim(f))
    return F.when(F.contains(clean, F.lit('"')), quoted).otherwise(plain)


def number_lines(lines: DataFrame) -> DataFrame:
    """Position of each line in its file: a file may be split over any number of tasks."""
    numbered, _ = index_rows(lines, ["sample_id"], ["_block", "_line"])
    return numbered.select("sample_id", "i", "value")


def read_sensor_csv(spark: SparkSession, paths: str | list[str], fs: float = 100.0) -> DataFrame:
    return parse_sensor_lines(number_lines(_lines(spark, paths)), fs)


def missing_columns(lines: DataFrame) -> DataFrame:
    """Files whose header lacks required columns, with the reason."""
    header = lines.where("i = 0").select("sample_id", _fields(F.col("value")).alias("_names"))
    lacking = F.array_except(F.array(*[F.lit(c) for c in SENSOR_COLUMNS]), F.col("_names"))
    return header.where(F.size(lacking) > 0).select(
        "sample_id", F.concat(F.lit("missing required columns: "), F.array_join(F.array_sort(lacking), ", ")).alias("reason")
    )


def parse_sensor_lines(lines: DataFrame, fs: float = 100.0) -> DataFrame:
    """Lines ``(sample_id, i, value)`` with a header at ``i = 0`` to rows ``sample_id, i, t, channels``.

    Text that is no number becomes NULL.  The time is rebuilt from the row position, a time column
    is ignored.  A file that lacks a required column fails the job with its name.
    """
    header = lines.where("i = 0").select("sample_id", _fields(F.col("value")).alias("_names"))
    wanted = F.array(*[F.lit(c) for c in SENSOR_COLUMNS])
    missing = F.array_except(wanted, F.col("_names"))
    header = header.withColumn(
        "_names",
        F.when(F.size(missing) == 0, F.col("_names")).otherwise(
            F.raise_error(F.concat_ws(" ", F.col("sample_id"), F.lit("lacks columns"), F.to_json(missing)))
        ),
    )
    rows = salted_join(lines.where("i > 0"), header, ["sample_id"], "i").withColumn("_f", _fields(F.col("value")))
    channels = [
        as_number(F.get("_f", (F.array_position("_names", F.lit(source)) - 1).cast("int"))).alias(name)
        for source, name in SENSOR_COLUMNS.items()
    ]
    return rows.select("sample_id", (F.col("i") - 1).alias("i"), ((F.col("i") - 1) / fs).alias("t"), *channels)


def sensor_layout(rows: DataFrame, *, block_rows: int = BLOCK_ROWS, halo: int = HALO_ROWS) -> Layout:
    return lay_out(rows.withColumnRenamed("i", "pos"), ["sample_id"], ["pos"], block_rows=block_rows, halo=halo, label="sensor")


def _first_match(names: Column, words: list[str]) -> Column:
    """0-based position of the first column whose lower-case name contains one of the words."""
    hits = F.transform(
        names, lambda n: F.greatest(*[F.contains(F.lower(n), F.lit(w)).cast("int") for w in words])
    )
    return (F.nullif(F.array_position(hits, 1), F.lit(0)) - 1).cast("int")


def read_reference_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return parse_reference_lines(number_lines(_lines(spark, paths)))


def _column_choice(*pairs: tuple[int, Column | int, Column | int]) -> Column:
    return F.array(*[
        F.struct(F.lit(c).alias("cand"), F.lit(t).cast("int").alias("at_t"), F.lit(h).cast("int").alias("at_hr"))
        for c, t, h in pairs
    ])


def parse_reference_lines(lines: DataFrame) -> DataFrame:
    """Reference series ``sample_id, t, hr`` from exports of two layouts, found per file.

    Layout 1 has its header in row 1, layout 2 no header after three rows.  Named columns are taken
    where the header has both, otherwise the second and third column, then the first and second.
    The first choice with at least two valid rows wins.  Times are seconds or clock text, decided
    per file.  Of equal times the first row stays.
    """
    fields = lines.select("sample_id", "i", _fields(F.col("value")).alias("_f"))
    names = F.col("_f")
    named_t, named_hr = _first_match(names, TIME_WORDS), _first_match(names, HR_WORDS)
    header = fields.where("i = 0").select(
        "sample_id",
        F.when(named_t.isNotNull() & named_hr.isNotNull(), _column_choice((1, named_t, named_hr)))
        .when(F.size(names) >= 3, _column_choice((1, 1, 2), (2, 0, 1)))
        .when(F.size(names) >= 2, _column_choice((2, 0, 1)))
        .alias("_pick"),
    )
    second = F.when(F.size("_f") >= 3, _column_choice((3, 1, 2), (4, 0, 1))).when(F.size("_f") >= 2, _column_choice((4, 0, 1)))
    late = F.when(F.col("i") >= SECOND_LAYOUT_SKIP, second)
    none = F.array().cast("array<struct<cand:int,at_t:int,at_hr:int>>")
    picks = F.concat(F.coalesce("_pick", none), F.coalesce(late, none))
    body = salted_join(fields.where("i > 0"), header, ["sample_id"], "i")
    tried = body.select("sample_id", "i", "_f", F.inline(picks)).select(
        "sample_id", "i", "cand", F.get("_f", "at_t").alias("t_text"), as_number(F.get("_f", "at_hr")).alias("hr")
    )
    rows = tried.withColumn("t_num", as_number("t_text")).withColumn("t_clock", clock_seconds("t_text"))
    has_hr = F.col("hr").isNotNull()
    per_choice = rows.groupBy("sample_id", "cand").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count("t_num").alias("_numeric"),
        F.count_if(F.col("t_num").isNotNull() & has_hr).alias("_ok_num"),
        F.count_if(F.col("t_clock").isNotNull() & has_hr).alias("_ok_clock"),
    )
    numeric = F.col("_numeric") >= F.greatest(F.lit(1), F.expr("_n div 2"))
    valid = F.when(numeric, F.col("_ok_num")).otherwise(F.col("_ok_clock"))
    chosen = (
        per_choice.where(valid >= 2)
        .groupBy("sample_id")
        .agg(F.min(F.struct("cand", numeric.alias("numeric"))).alias("_c"))
        .select("sample_id", F.col("_c.cand").alias("cand"), F.col("_c.numeric").alias("numeric"))
    )
    t = F.when(F.col("numeric"), F.col("t_num")).otherwise(F.col("t_clock"))
    series = salted_join(rows, chosen, ["sample_id", "cand"], "i").select("sample_id", "i", t.alias("t"), "hr")
    return (
        series.where(F.col("t").isNotNull() & F.col("hr").isNotNull())
        .groupBy("sample_id", "t")
        .agg(F.min_by("hr", "i").alias("hr"))
    )
