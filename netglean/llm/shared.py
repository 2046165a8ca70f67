"""Table access and lineage cuts that the operators share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. A session that names none gets a local folder if it has one machine; on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named or "/tmp/checkpoints"


def _path(spark: SparkSession, path: str):
    """Hadoop's file system and path, for any store that Spark knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def save(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, so that lost executors cost no recomputation of what came before.

    forget() deletes it; what a result still reads is deleted when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    store, at = _path(spark, path)
    store.deleteOnExit(at)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def forget(*saved: DataFrame) -> None:
    """Deletes tables that save() wrote, once nothing reads them any more."""
    for df in saved:
        store, at = _path(df.sparkSession, df.saved_at)
        store.delete(at, True)
        store.cancelDeleteOnExit(at)


def buckets(spark: SparkSession, rows: int, rows_each: int) -> int:
    """Number of buckets so that one holds about rows_each rows, with enough of them to use the session's partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_each))


def empty_text(df: DataFrame) -> DataFrame:
    """Only doc_id and text, null texts made empty; other columns, whatever their names, stay behind."""
    return df.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
