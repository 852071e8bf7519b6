"""Pairing of sensor and reference files by name."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.operators.experiment import MOTION_TYPES

SENSOR_PATTERN = r"^multi_([A-Za-z]+\d+)$"  # fixed value: sensor file names
ID_PATTERN = rf"^({'|'.join(MOTION_TYPES)})(\d+)$"


def list_csv(spark: SparkSession, folder: str) -> DataFrame:
    """CSV files of one folder, not of its subfolders: ``file_path, file_name, stem``.

    The names come from the listing that Spark's driver makes of the folder: a scan shows no empty files.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).inputFiles()
    files = spark.createDataFrame([(unquote(f),) for f in listed], "path string")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.col("path").alias("file_path"), name.alias("file_name"), F.regexp_replace(name, r"\.csv$", "").alias("stem"))


def motion_id(stem: Column) -> list[Column]:
    """Type, index and canonical id of a stem; leading zeros of the index go, other names give NULL."""
    bare = F.regexp_replace(F.regexp_replace(stem, "^multi_", ""), "_ref$", "")
    legal = bare.rlike(ID_PATTERN)
    kind = F.when(legal, F.regexp_extract(bare, ID_PATTERN, 1))
    index = F.when(legal, F.regexp_extract(bare, ID_PATTERN, 2).cast("long"))
    return [
        kind.alias("motion_type"),
        index.alias("motion_index"),
        F.when(legal, F.concat(kind, index.cast("string"))).alias("motion_id"),
    ]


def pair_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs and unpaired files of ``files(file_path, file_name, stem)``.

    One full outer join on the sensor stem: both sides are keyed by file name, so no key is hot.
    """
    is_ref = F.col("stem").endswith("_ref")
    named = files.select("*", *motion_id(F.col("stem")))
    sensors = named.where(~is_ref).withColumn(
        "legal", F.col("stem").rlike(SENSOR_PATTERN) & F.col("motion_id").isNotNull()
    )
    refs = files.where(is_ref).select(
        F.regexp_replace("stem", "_ref$", "").alias("stem"),
        F.col("file_path").alias("ref_path"),
        F.col("file_name").alias("ref_name"),
    )
    both = sensors.join(refs, "stem", "full_outer")
    paired = F.col("legal") & F.col("ref_path").isNotNull()
    pairs = both.where(paired).select("motion_id", "motion_type", "motion_index", "stem", "file_path", "ref_path")
    bad_name = (F.col("file_name").isNotNull()) & ~F.col("legal")
    lone_sensor = F.col("legal") & F.col("ref_path").isNull()
    no_sensor = F.col("ref_path").isNotNull() & ~F.coalesce(F.col("legal"), F.lit(False))
    rows = F.array_compact(
        F.array(
            F.when(
                bad_name,
                F.struct(
                    "file_name",
                    F.concat(
                        F.lit("sensor name must match multi_<motion_type><index>.csv with motion_type in "),
                        F.lit(", ".join(MOTION_TYPES)),
                    ).alias("reason"),
                ),
            ),
            F.when(
                lone_sensor,
                F.struct("file_name", F.concat(F.lit("missing reference file "), F.col("stem"), F.lit("_ref.csv")).alias("reason")),
            ),
            F.when(
                no_sensor,
                F.struct(
                    F.col("ref_name").alias("file_name"),
                    F.concat(F.lit("missing sensor file "), F.col("stem"), F.lit(".csv")).alias("reason"),
                ),
            ),
        )
    )
    unpaired = both.select(F.inline(rows))
    return pairs, unpaired
