"""Writing results, metrics and audit rows (S8-S10), and cutting lineage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.sources import commits


def write_results(results: DataFrame, path: str, fmt: str = "parquet", mode: str = "append", batch: str | None = None) -> None:
    """Results partitioned by document type; ``doc_id`` identifies a result.

    With a name for the ``batch``, a retry adds nothing (``sources.commits``, whose ``read_table`` reads it).
    """
    if batch is not None:
        commits.write_batch(results, path, batch, ("document_type",))
        return
    results.write.mode(mode).partitionBy("document_type").format(fmt).save(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Replaces the last report."""
    metrics.write.mode("overwrite").json(path)


def read_metrics(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def append_decisions(decisions: DataFrame, path: str, session_id: str | None, batch: str | None = None) -> None:
    """One partition of the audit table per session; without ``session_id``, by the column of that name.

    With a name for the ``batch``, a retry adds nothing (``sources.commits``).
    """
    rows = decisions if session_id is None else decisions.withColumn("session_id", F.lit(session_id))
    if batch is not None:
        commits.write_batch(rows, path, batch, ("session_id",))
        return
    rows.write.mode("append").partitionBy("session_id").parquet(path)


def _sums(decisions: DataFrame) -> DataFrame:
    failed = F.coalesce(F.col("error_message"), F.lit("")) != ""
    return decisions.groupBy("session_id", "agent_type").agg(
        F.count(F.lit(1)).alias("decisions"),
        F.sum("duration_ms").cast("double").alias("duration_ms"),
        F.count("duration_ms").alias("timed"),
        F.count_if(failed).alias("errors"),
        F.sum(F.coalesce(F.col("confidence"), F.lit(0.0))).cast("double").alias("confidence"),
    )


def append_with_totals(decisions: DataFrame, path: str, batch: str) -> None:
    """S10 with M6, M8: append decisions and, beside them, their sums per session and agent.

    Both are batches of one name, so a retry after a crash between them writes what is missing.
    """
    append_decisions(decisions, path, None, batch)
    commits.write_batch(_sums(decisions), f"{path}/totals", batch)


def running_totals(spark: SparkSession, path: str) -> DataFrame:
    """M6, M8 per session and agent from the kept sums; no decision is read again."""
    sums = ["decisions", "duration_ms", "timed", "errors", "confidence"]
    kept = commits.read_table(spark, f"{path}/totals").groupBy("session_id", "agent_type").agg(*[F.sum(c).alias(c) for c in sums])
    return kept.select(
        "session_id", "agent_type", "decisions", F.col("duration_ms").alias("total_duration_ms"),
        F.try_divide("duration_ms", "timed").alias("avg_duration_ms"), "errors",
        (F.col("errors") / F.col("decisions")).alias("error_rate"), (F.col("confidence") / F.col("decisions")).alias("avg_confidence"),
    )


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names; where it names none, one in the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder that driver and executors share, below the checkpoint folder."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and keep it in the checkpoint folder.

    For inputs that are read several times and costly to recompute; survives the
    loss of executors.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint(eager=True)


@contextmanager
def session_set(spark: SparkSession, settings: Mapping[str, str]) -> Iterator[None]:
    """The session with other settings while this is open."""
    was = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in was.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
