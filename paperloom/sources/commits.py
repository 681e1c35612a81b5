"""Tables whose batches count once.

A batch is written to a folder of its own first; then one row in the table of commits names the
folder. Readers see committed folders only, one for each batch, so a retried batch, a job
that died half-way or a stream that starts again adds nothing twice.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

_COMMIT = "batch string, attempt string, at timestamp, schema string"


def commits(spark: SparkSession, path: str) -> DataFrame:
    """(batch, attempt, at, schema): the attempt of each batch that counts, the first committed.

    Two writers may commit one batch at a time; the smaller attempt decides between equal times.
    """
    try:
        rows = spark.read.schema(_COMMIT).parquet(f"{path}/commits")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], _COMMIT)
    return rows.groupBy("batch").agg(F.min(F.struct("at", "attempt", "schema")).alias("c")).select("batch", "c.*")


def write_attempt(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    """Write rows to a new folder that no commit names yet; returns its name."""
    attempt = f"a-{uuid.uuid4().hex}"
    out = df.withColumn("attempt", F.lit(attempt)).write.mode("append")
    out.partitionBy("attempt", *partition_by).parquet(f"{path}/data")
    return attempt


def commit(spark: SparkSession, path: str, batch: str, attempt: str, schema: StructType) -> None:
    row = spark.range(1).select(
        F.lit(batch).alias("batch"), F.lit(attempt).alias("attempt"), F.current_timestamp().alias("at"), F.lit(schema.json()).alias("schema")
    )
    row.coalesce(1).write.mode("append").parquet(f"{path}/commits")


def write_batch(df: DataFrame, path: str, batch: str, partition_by: Sequence[str] = ()) -> bool:
    """Append ``df`` as ``batch``; False, and nothing is written, where that batch is committed.

    ``batch`` must name the same rows each time. ``attempt`` is the table's own column.
    """
    spark = df.sparkSession
    if commits(spark, path).where(F.col("batch") == batch).head(1):
        return False
    commit(spark, path, batch, write_attempt(df, path, partition_by), df.schema)
    return True


def read_table(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """The rows of all committed batches, with the columns of the last commit's schema.

    The commits are joined to the folder column, so only committed folders are read. A table without
    commits has no rows; its columns must be given then.
    """
    counted = commits(spark, path)
    last = counted.orderBy(F.desc("at"), F.desc("attempt")).select("schema").head(1)
    if not last:
        if schema is None:
            raise ValueError(f"no batch is committed in {path}; give the schema")
        return spark.createDataFrame([], schema)
    schema = schema or StructType.fromJson(json.loads(last[0]["schema"]))
    rows = spark.read.schema(StructType(list(schema.fields)).add("attempt", "string")).parquet(f"{path}/data")
    return rows.join(counted.select("attempt"), "attempt", "left_semi").select(*schema.names)


def start(stream: DataFrame, name: str, path: str, checkpoint: str, partition_by: Sequence[str] = (), once: bool = True) -> StreamingQuery:
    """Append a stream to the table at ``path``, a batch for each micro-batch.

    Batches are named after ``checkpoint`` and their number, so a restart repeats none. A new
    checkpoint folder needs a new path: its numbers start again.
    """

    def add(rows: DataFrame, number: int) -> None:
        write_batch(rows, path, f"{checkpoint}#{number}", partition_by)

    writer = stream.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(add)
    return (writer.trigger(availableNow=True) if once else writer).start()
