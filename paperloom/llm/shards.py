"""Contiguous shards of near equal bytes, cut from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import settle, shuffle_partitions


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, text_key): bytes of the text plus 1, and what orders it."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("text_key"),
    )


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of ``docs(doc_id, text)``.

    Rows are put in one global order, by a hash of the text and then by doc_id, so that
    equal texts are neighbours and every shard is a fair draw of the corpus. Range
    partitions of that order give their total bytes; the running sum of the totals plus the
    running sum inside a partition is a row's place among all bytes. A row goes to the shard
    in which its middle lies, so a shard is off its target by less than the two rows at its
    ends. ``slot`` counts a shard's rows from 0 without gaps.

    A hot group of equal texts spreads over several range partitions, as doc_id is part of
    the order. NULL text has size 1; NULL doc_id sorts first; equal rows are interchangeable.
    An empty table gives an empty table. Other columns are ignored.
    """
    spark = docs.sparkSession
    order = ["text_key", "doc_id", "size", "text_crc32"]
    placed = settle(
        sized(docs).repartitionByRange(shuffle_partitions(spark), *order).withColumn("part", F.spark_partition_id()),
        "ranges",
    )
    # One row per range partition: as many as the session has shuffle partitions.
    totals = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"),
    )
    inside = Window.partitionBy("part").orderBy(*order)
    running = placed.select(
        "*",
        F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("upto"),
        F.row_number().over(inside).alias("place"),
    ).join(F.broadcast(offsets), "part")
    middle = F.col("bytes_before") * 2 + F.col("upto") * 2 - F.col("size")
    cut = running.select(
        "doc_id",
        "size",
        "text_crc32",
        F.floor(middle.cast("decimal(38,0)") * shards / (F.col("all_bytes") * 2)).cast("int").alias("shard"),
        (F.col("rows_before") + F.col("place") - 1).alias("rank"),
    )
    cut = settle(cut, "cuts")
    first = cut.groupBy("shard").agg(F.min("rank").alias("first"))  # at most `shards` rows
    return cut.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.col("first")).cast("long").alias("slot")
    )
