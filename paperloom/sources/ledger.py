"""Ingest that reads new content only (S1, S3): a ledger of files and fingerprints.

The ledger is a table of commits (``sources.commits``) of the files that were read. A file whose path,
length and time are in it is not read again. Of the others, content whose fingerprint is known
is told apart by a Bloom filter over the known fingerprints, and only rows that the filter
does not clear are compared with the ledger itself.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from contextlib import AbstractContextManager
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.sources import commits
from paperloom.sources.files import FILE_SCHEMA, ingest
from paperloom.sources.sinks import session_set, settle

#: Bits of a block of the filter, which is one row; what ``bitmap_construct_agg`` gives.
_BLOCK = 32768
BITS_A_KEY, HASHES = 16, 5
ENTRY = "path string, length bigint, modificationTime timestamp, source_hash string"
#: Files that Spark's reader is given in one call.
AT_ONCE = 20_000
#: Tasks that list folders or files, and bytes of the files that one task reads; Spark gives nearly every folder a task.
LISTING_TASKS = 64
TASK_BYTES = 16 << 20
#: Content that a task hands to Spark at once.
BATCH_BYTES = 4 << 20


def _bits(column: str) -> Column:
    """The bits of a key in its block."""
    return F.array(*[F.pmod(F.xxhash64(F.lit(f"bit{i}"), F.col(column)), F.lit(_BLOCK)) for i in range(HASHES)])


def _block(column: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), F.col(column)), F.lit(blocks))


def bloom_filter(known: DataFrame, column: str, keys: int, bits_a_key: int = BITS_A_KEY) -> tuple[DataFrame, int]:
    """(block, bits) rows of a blocked Bloom filter for about ``keys`` keys, and the number of blocks.

    A key sets its bits in one block of 4 KB, so the filter is a table: it grows with the keys, is
    built by a partial aggregate, and is joined by block.
    """
    blocks = max(1, -(-keys * bits_a_key // _BLOCK))
    rows = known.where(F.col(column).isNotNull()).select(_block(column, blocks).alias("block"), F.explode(_bits(column)).alias("bit"))
    return rows.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits")), blocks


def maybe_known(rows: DataFrame, column: str, bloom: DataFrame, blocks: int) -> DataFrame:
    """``rows`` with ``_maybe``: whether the filter has all bits of the key. Never false for a known key."""
    byte = "CAST(conv(hex(substring(_held, CAST(b div 8 AS INT) + 1, 1)), 16, 10) AS INT)"
    every = F.expr(f"coalesce(forall(_bits, b -> shiftright({byte}, CAST(b % 8 AS INT)) % 2 = 1), false)")
    asked = rows.withColumns({"_block": _block(column, blocks), "_bits": _bits(column)})
    held = bloom.select(F.col("block").alias("_at"), F.col("bits").alias("_held"))
    joined = asked.join(held, asked["_block"] == held["_at"], "left")
    return joined.withColumn("_maybe", F.col("_held").isNotNull() & every).drop("_block", "_bits", "_at", "_held")


def new_rows(rows: DataFrame, known: DataFrame, column: str, place: str, bits_a_key: int = BITS_A_KEY) -> DataFrame:
    """The rows whose key no row of ``known`` has, one for each key: that with the smallest ``place``.

    Rows that the filter clears are new; the others are compared with ``known`` exactly, so a false
    positive costs a comparison and changes nothing. Rows without a key are left out.
    """
    bloom, blocks = bloom_filter(known, column, known.count(), bits_a_key)
    keyed = maybe_known(rows.where(F.col(column).isNotNull()), column, bloom, blocks)
    exact = known.select(F.col(column).alias("_known")).where("_known IS NOT NULL").distinct()
    asked = keyed.where("_maybe")
    fresh = keyed.where("NOT _maybe").unionByName(asked.join(exact, asked[column] == exact["_known"], "left_anti"))
    others = [F.col(c) for c in rows.columns if c not in (column, place)]
    least = fresh.groupBy(column).agg(F.min_by(F.struct(*others) if others else F.lit(1), place).alias("_row"), F.min(place).alias(place))
    return least.select(*[c if c in (column, place) else F.col("_row")[c].alias(c) for c in rows.columns])


def entries(spark: SparkSession, ledger: str) -> DataFrame:
    """(path, length, modificationTime, source_hash) of the files that were read."""
    return commits.read_table(spark, ledger, spark.createDataFrame([], ENTRY).schema)


def _few_tasks(spark: SparkSession) -> AbstractContextManager[None]:
    """Spark lists folders by LISTING_TASKS tasks while this is open."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    return session_set(spark, {name: str(min(LISTING_TASKS, int(spark.conf.get(name))))})


def _mounted(spark: SparkSession, folder: str) -> str | None:
    """The path of one folder of a mounted file system, where tasks can list and open files themselves; else None."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    root = system.makeQualified(path).toUri().getPath()
    named = not any(c in root for c in "*?[]{}\\")  # Spark reads others as patterns
    return root if named and system.getUri().getScheme() == "file" and os.path.isdir(root) else None


def _listed(spark: SparkSession, root: str) -> DataFrame:
    """(path, modificationTime, length) of the files below a mounted folder; hidden names and empty files are left out, as Spark does.

    In each round tasks list the folders that the round before has found, so no names pass the driver.
    """

    def entries_of(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list) -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["at", "length", "ms"])

        rows: list = []
        for frame in frames:
            for folder in frame.column("at").to_pylist():
                with os.scandir(folder) as found:
                    for entry in found:
                        name = entry.name
                        hidden = name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")
                        if hidden and not name.startswith(("_metadata", "_common_metadata")):
                            continue
                        try:
                            name.encode()  # a name that is not UTF-8 is not found by Spark either
                            told = entry.stat()
                        except (FileNotFoundError, UnicodeEncodeError):
                            continue
                        if stat.S_ISDIR(told.st_mode):
                            rows.append((entry.path, None, None))
                        elif told.st_size and not hidden:
                            rows.append((entry.path, told.st_size, told.st_mtime_ns // 1_000_000))
                        if len(rows) == 10_000:
                            yield batch(rows)
                            rows = []
        yield batch(rows)

    folders, levels, count = spark.createDataFrame([(root,)], "at string"), [], 1
    while count:
        rows = settle(folders.repartition(min(LISTING_TASKS, count)).mapInArrow(entries_of, "at string, length bigint, ms bigint"))
        levels.append(rows.where("ms IS NOT NULL"))
        folders = rows.where("ms IS NULL").select("at")
        count = folders.count()
    files = reduce(DataFrame.unionByName, levels)
    return files.select(F.concat(F.lit("file:"), "at").alias("path"), F.timestamp_millis("ms").alias("modificationTime"), "length")


def _opened(files: DataFrame, tasks: int, max_mb: int | None) -> DataFrame:
    """Files of a mounted file system with their content, as Spark's reader gives them; those over ``max_mb`` are not opened."""
    limit = None if max_mb is None else max_mb << 20

    def contents(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list) -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["path", "ms", "length", "content"])

        rows, held = [], 0
        for frame in frames:
            for path in frame.column("path").to_pylist():
                told, content = os.stat(path.removeprefix("file:")), None
                if limit is None or told.st_size <= limit:
                    with open(path.removeprefix("file:"), "rb") as file:
                        told, content = os.fstat(file.fileno()), file.read()
                if rows and held + len(content or b"") > BATCH_BYTES:
                    yield batch(rows)
                    rows, held = [], 0
                rows.append((path, told.st_mtime_ns // 1_000_000, told.st_size, content))
                held += len(content or b"")
        yield batch(rows)

    read = files.select("path").repartition(tasks).mapInArrow(contents, "path string, ms bigint, length bigint, content binary")
    return read.select("path", F.timestamp_millis("ms").alias("modificationTime"), "length", "content")


def _opened_by_spark(files: DataFrame, tasks: int) -> DataFrame:
    """Files of any other file system with their content; their names pass the driver."""
    spark = files.sparkSession
    paths, found = [row["path"] for row in files.select("path").toLocalIterator()], spark.createDataFrame([], FILE_SCHEMA)
    with _few_tasks(spark):
        for at in range(0, len(paths), AT_ONCE):
            found = found.unionByName(spark.read.format("binaryFile").load(paths[at : at + AT_ONCE]))
    return found.coalesce(tasks)


def unseen_files(spark: SparkSession, folder: str, ledger: str) -> DataFrame:
    """Files below ``folder`` that the ledger does not list as they are now; their content is not read."""
    root = _mounted(spark, folder)
    if root is not None:
        listed = _listed(spark, root).coalesce(LISTING_TASKS)
    else:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        with _few_tasks(spark):
            listed = reader.load(folder).drop("content").coalesce(LISTING_TASKS)
    # Sizes of listed files are not known to the planner, which would send them all to the driver.
    return listed.join(entries(spark, ledger).hint("merge"), ["path", "length", "modificationTime"], "left_anti")


def ingest_new(spark: SparkSession, folder: str, ledger: str, batch: str, max_mb: int | None = None) -> DataFrame:
    """S1-S7 for the new content below ``folder``, one row for each fingerprint; ``batch`` names the run.

    Only files that the ledger does not list are opened. Below a mounted folder (``file:``) tasks list and read
    the files, and the driver holds none of their names; elsewhere Spark does, and they pass the driver.
    The files are entered in the ledger once their rows are
    kept, so a run that dies is done again as a whole, and a batch that is committed returns no rows.
    Files that could not be loaded are entered without a fingerprint and come back as rows
    with their error, once.
    """
    unseen = settle(unseen_files(spark, folder, ledger))
    count, total = unseen.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    tasks = max(LISTING_TASKS, -(-total // TASK_BYTES))
    if _mounted(spark, folder) is not None:
        files = _opened(unseen, max(1, min(count, tasks)), max_mb)
    else:
        files = _opened_by_spark(unseen, tasks)
    if max_mb is not None:
        files = files.withColumn("max_mb", F.lit(max_mb))
    docs = settle(ingest(files))
    fresh = new_rows(docs.where("load_error IS NULL"), entries(spark, ledger), "source_hash", "file_path")
    found = settle(fresh.select(*docs.columns).unionByName(docs.where("load_error IS NOT NULL")))
    seen = unseen.join(docs.select(F.col("file_path").alias("path"), "source_hash").hint("merge"), "path")
    if not commits.write_batch(seen.select("path", "length", "modificationTime", "source_hash"), ledger, batch):
        return found.where("false")
    return found
