"""Helpers that the corpus operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than these six (as a Java and RE2 class).
SPACES = r"\x20\x09-\x0D"
WORD = rf"[^{SPACES}]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where it is unset, a local one, and on a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "/tmp/checkpoints/keelson"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder for a table that a later stage reads."""
    return f"{shared_dir(spark).rstrip('/')}/keelson-{label}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remainder_of_id(column: str, divisor: int):
    """crc32 of the id as text, modulo ``divisor``; null ids give null."""
    return F.crc32(F.col(column).cast("string")) % F.lit(divisor)
