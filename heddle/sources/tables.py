"""Tables on shared storage: reading the driver tables, cutting lineage, versioned rewrite, tombstones, manifest."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; one is set only where there is none and all runs in one process (tests, local runs)."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and sc.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="heddle-"))
    return sc.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again, so that lineage is cut and a lost executor costs nothing."""
    path = f"{shared_dir(df.sparkSession)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def rewrite(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """Writes a new version beside the old ones and returns its path; the path that is read is never overwritten."""
    to = f"{path}/v-{uuid.uuid4().hex}"
    w = df.write.mode("error")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(to)
    return to


def with_tombstones(df: DataFrame, drop: Column, reason: Column, archive: str) -> DataFrame:
    """What stays; what goes is appended to the archive with its reason."""
    gone = F.coalesce(drop, F.lit(False))
    df.filter(gone).withColumn("retired_reason", reason).write.mode("append").parquet(archive)
    return df.filter(~gone)


def manifest(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """file, bytes, sha256 of every file below path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def sorted_jsonl(df: DataFrame, path: str, *order: str) -> None:
    """A report of bounded size as one JSON-lines file in a fixed order."""
    df.orderBy(*order).coalesce(1).write.mode("error").json(path)
