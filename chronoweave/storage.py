"""Written intermediate tables in the cluster's shared folder.

Lineage is cut by writing parquet below ``spark.checkpoint.dir``.  Losing an executor then never
forces a re-sort of the input, and both readers of an intermediate table see the same rows.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_fallback: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a scratch folder only for a local master."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if sc.applicationId not in _local_fallback:
        folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        sc.setCheckpointDir(folder)
        _local_fallback[sc.applicationId] = folder
    return _local_fallback[sc.applicationId]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/chronoweave/{label}-{uuid.uuid4().hex[:12]}"


#: Tables so large that a slower codec than the session's pays for itself.
CODECS = {"keyed_paragraphs": "zstd", "spectra": "zstd"}


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as parquet to the shared folder and return the written table."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path, compression=CODECS.get(label))
    return spark.read.schema(df.schema).parquet(path)


def few(df: DataFrame, rows: int, each: int = 1 << 14) -> DataFrame:
    """``df``, of about ``rows`` rows, in no more tasks than these rows need, but one for each core.

    Shuffle partitions follow the input; a small table would else be written as so many nearly empty files.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


def release(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` returned and nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise_bucketed(df: DataFrame, label: str, buckets: int, by: list[str], sort: list[str]) -> DataFrame:
    """Write ``df`` bucketed, so that later windows and joins on ``by`` need no exchange."""
    spark = df.sparkSession
    path = new_path(spark, label)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    (
        df.repartition(buckets, *by)
        .write.format("parquet")
        .bucketBy(buckets, *by)
        .sortBy(*sort)
        .option("path", path)
        .saveAsTable(table)
    )
    return spark.table(table)
