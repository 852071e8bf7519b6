"""Result tables: CSV and JSON output with stable headers, guarded output folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column orders of the result tables.
GLOBAL_HR_COLUMNS = [
    "time_s", "segment_label", "is_filtered_segment", "ppg_hr_bpm", "ref_hr_after_bpm", "time_bias_after_s",
    "abs_err_after_bpm", "time_bias_after_source", "time_bias_after_mode",
]

QC_COLUMNS = [
    "group_id", "motion_type", "data_file", "ref_file", "file_name", "status", "reason", "std_ut1", "std_ut2", "outlier_count_ut1",
    "outlier_count_ut2", "outlier_ratio_ut1", "outlier_ratio_ut2", "is_good",
]
SAMPLE_COLUMNS = ["group_id", "motion_type", "motion_index", "data_file", "ref_file"]
SPLIT_COLUMNS = ["fold_id", "heldout_group_id", "split", "group_id", "motion_type", "data_file", "ref_file", "reason"]
BATCH_COLUMNS = ["motion_type", "sample", "status", "reason", "split", "result_csv", "report_json"]
FINAL_COLUMNS = [
    "motion_type", "target_scope", "cascade_scheme", "adaptive_filter", "result_level", "aggregation", "params_semantics", "metric_value",
    "objective_mode", "data_split_mode", "n_trials", "n_repeats", "success", "reason",
]
FINAL_METRICS = ["aae", "accuracy", "posthoc_aae", "posthoc_accuracy"]
WINDOW_COLUMNS = [
    "motion_type", "target_scope", "cascade_scheme", "adaptive_filter", "heldout_group_id", "role", "repeat_idx", "trial_idx", "sample_id",
    "group_id", "w", "center_s", "label", "in_scope", "ref_hr", "baseline_hr", "adaptive_hr",
]


def write_samples(rows: DataFrame, path: str, key: list[str], time: str, *, rows_per_file: int = 4_000_000, group_bytes: int = 1 << 24) -> None:
    """Samples clustered by (recording, time): each file and row group covers a short range of both."""
    parts = max(1, -(-rows.count() // rows_per_file))
    ordered = rows.repartitionByRange(parts, *key, time).sortWithinPartitions(*key, time)
    ordered.write.mode("overwrite").option("parquet.block.size", group_bytes).parquet(path)


def time_slice(rows: DataFrame, start, end, time: str = "time_s") -> DataFrame:
    """Rows between two times, both included.  On a table of ``write_samples`` the bounds reach the scan, and row
    groups outside them are not read."""
    return rows.where((F.col(time) >= F.lit(start)) & (F.col(time) <= F.lit(end)))


def score_map(scores: DataFrame, key: list[str], candidate: str, score: str) -> DataFrame:
    """``key, scores``: map from each candidate of a recording's grid to its score, in the grid's order."""
    entries = F.array_sort(F.collect_list(F.when(F.col(score).isNotNull(), F.struct(F.round(candidate, 10).alias("key"), F.col(score).alias("value")))))
    return scores.groupBy(*key).agg(F.map_from_entries(entries).alias("scores"))


def safe_output(path: str, root: str, protected: list[str] = ()) -> str:
    """Path that may be overwritten: below ``root``, not ``root`` itself, not above or at a protected path."""
    clean, base = path.rstrip("/"), root.rstrip("/")
    if ".." in clean.split("/") or not clean.startswith(base + "/"):
        raise ValueError(f"{path} is not below {root}")
    for other in protected:
        keep = other.rstrip("/")
        if keep == clean or keep.startswith(clean + "/"):
            raise ValueError(f"{path} would overwrite {other}")
    return clean


def json_safe(df: DataFrame) -> DataFrame:
    """Non-finite numbers become NULL, so that JSON and CSV show nothing instead of NaN."""
    inf = float("inf")
    fix = {
        f.name: F.when(~F.isnan(f.name) & (F.abs(f.name) != inf), F.col(f.name))
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.withColumns(fix) if fix else df


def as_json(df: DataFrame, *keep: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keep]
    return json_safe(df).select(*keep, F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("json"))


def _flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, as CSV has no nested values."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.withColumns({f.name: F.to_json(f.name) for f in df.schema.fields if isinstance(f.dataType, nested)})


def write_csv(df: DataFrame, path: str, *, columns: list[str] | None = None, by: list[str] = (), one_file: bool = False) -> None:
    """CSV with a header, also for an empty table.  ``one_file`` is for report tables of bounded size."""
    out = _flat(json_safe(df if columns is None else with_columns(df, columns)))
    out = out.coalesce(1) if one_file else out
    writer = out.write.mode("overwrite").option("header", True)
    # A partitioned write of no rows makes no file, and then there is no header.
    (writer.partitionBy(*by) if by and not out.isEmpty() else writer).csv(path)


def with_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns in their fixed order; those the table lacks are NULL."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def pick_params(requests: DataFrame, params: DataFrame, mode: list[str], score: str, maximise: bool = False) -> DataFrame:
    """Best parameter row for every requested mode; a mode without rows gets the first row of the table.

    ``params`` has a ``row_id`` in file order.  Missing scores lose against any score.
    """
    value = F.col(score) if not maximise else -F.col(score)
    rest = [c for c in params.columns if c not in mode]
    best = (
        params.groupBy(*mode)
        .agg(F.min_by(F.struct(*rest), F.struct(value.isNull(), F.round(value, 9), "row_id")).alias("_b"))
        .withColumn("matched", F.lit(True))
    )
    first = params.agg(F.min_by(F.struct(*rest), "row_id").alias("_first"))  # one row
    joined = requests.join(best, mode, "left").join(F.broadcast(first))
    return joined.withColumn("_b", F.coalesce("_b", "_first")).select(
        *requests.columns, F.coalesce("matched", F.lit(False)).alias("matched"), *[F.col("_b")[c].alias(c) for c in rest]
    )


def read_params(spark: SparkSession, path: str) -> DataFrame:
    """Written parameter rows: scores as numbers, ``params`` as map, ``row_id`` sorts by file and place, whatever the listing."""
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))
    rows = spark.read.option("header", True).csv(path).withColumn("row_id", place)
    numbers = [c for c in rows.columns if c.endswith(("_aae", "_acc", "_idx", "_value")) or c.startswith(("train_", "test_"))]
    typed = {c: F.col(c).try_cast("double") for c in numbers}
    typed["params"] = F.from_json("params", "map<string,double>")
    return rows.withColumns(typed)


def write_global_rates(rows: DataFrame, path: str, by: list[str]) -> None:
    """Full-length curves of ``redraw.global_rates`` with their fixed columns, partitioned by recording."""
    named = rows.withColumnRenamed("rate_bpm", GLOBAL_HR_COLUMNS[3])
    write_csv(named.select(*by, *GLOBAL_HR_COLUMNS), path, by=by)
