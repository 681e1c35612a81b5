"""Documents dropped into a folder, redacted as they arrive.

The stages are row-local, so the batch transforms are used as they are and the
stream needs no state and no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from paperloom.operators.redact import redact
from paperloom.sources.files import ingest, scan_stream
from paperloom.sources.sinks import session_set

_STORE = "spark.sql.streaming.stateStore"
#: State lies on the executors' disks, and an executor holds at most so many MB of it; Spark's default holds all of it in the heap.
STATE_ON_DISK = {
    f"{_STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STORE}.rocksdb.boundedMemoryUsage": "true",
    f"{_STORE}.rocksdb.maxMemoryUsageMB": "192",
}


def redacted_documents(spark: SparkSession, folder: str, mode: str = "compat") -> DataFrame:
    """Stream of redacted documents; rows that could not be loaded keep their error."""
    docs = ingest(scan_stream(spark, folder))
    return redact(docs, mode=mode).drop("text", "pii_entities")


def start(
    stream: DataFrame, name: str, out: str, checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Append to ``out``. ``checkpoint`` holds the progress: a restart with the same folder
    goes on where the last run stopped, so give each stream one that all executors reach. It also
    keeps the kind of state store; a new one gets STATE_ON_DISK where the session names none.
    """
    spark = stream.sparkSession
    named = spark.conf.get(f"{_STORE}.providerClass", None) is not None
    writer = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .queryName(name)
        .option("path", out)
        .option("checkpointLocation", checkpoint)
    )
    with session_set(spark, {} if named else STATE_ON_DISK):
        return (writer.trigger(availableNow=True) if once else writer).start()
