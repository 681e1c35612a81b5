"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a batch of rows on its way to Python.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder that driver and executors share.

    It lies in ``spark.checkpoint.dir``; where that is unset (tests), in the warehouse
    folder, which is shared as well. Folders may be deleted once the application ended.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/llm_scratch"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here.

    A lost executor then costs the tasks it ran, not all that led to this table.
    """
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of at most BATCH_BYTES (the session's own setting, if smaller).

    Whole texts are held in several copies on their way, so large batches of long texts fill a
    task's memory. The setting holds for the session.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)b?", spark.conf.get(name).lower()).groups()
    spark.conf.set(name, str(min(BATCH_BYTES, int(number) << 10 * " kmgtp".index(unit or " "))))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remainder(key: str, modulus: int) -> Column:
    """crc32 of a key as text, modulo; NULL keys count as remainder 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % modulus, F.lit(0))


def hash_share(key: str, share: float) -> Column:
    """True for about ``share`` of the keys, the same ones in every run."""
    return F.pmod(F.xxhash64(F.lit("share"), F.col(key)), F.lit(1 << 30)) < F.lit(int(min(1.0, share) * (1 << 30)))
