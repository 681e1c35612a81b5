"""Documents from files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.basics import fixed_point
from paperloom.functions.fixed_values import (
    IMAGE_SUFFIXES,
    IMAGE_TEXT,
    PDF_SUFFIXES,
    TEXT_SUFFIXES,
)

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def scan(spark: SparkSession, path: str, max_mb: int | None = None) -> DataFrame:
    """Files below ``path`` as ``(path, modificationTime, length, content)``.

    With ``max_mb`` (the fixed value is ``MAX_DOCUMENT_MB``), files over it keep their
    row but their content is never read: two reads push opposite length filters to the
    scan, the second without content. A column ``max_mb`` tells ``ingest``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if max_mb is None:
        return files
    files = files.withColumn("max_mb", F.lit(max_mb))
    limit = max_mb * 1024 * 1024
    fits = files.where(F.col("length") <= limit)
    too_big = files.drop("content").where(F.col("length") > limit)
    return fits.unionByName(
        too_big.withColumn("content", F.lit(None).cast("binary")), allowMissingColumns=True
    )


def scan_stream(spark: SparkSession, path: str, max_mb: int | None = None) -> DataFrame:
    """New files below a folder as a stream; a stream needs the schema up front."""
    reader = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true")
    files = reader.schema(FILE_SCHEMA).load(path)
    return files if max_mb is None else files.withColumn("max_mb", F.lit(max_mb))


def decode(content: Column) -> Column:
    """UTF-8, else Latin-1; line ends become ``\\n``."""
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(
        F.decode(content, "ISO-8859-1")
    )
    return F.regexp_replace(text, "\r\n?", "\n")


def ingest(files: DataFrame) -> DataFrame:
    """Metadata, text and ``load_error`` of each file, one row per file.

    The size limit is the scan's: a column ``max_mb``, none where it is absent or NULL.
    Row-local, so it also runs on ``scan_stream``.
    """
    if "max_mb" not in files.columns:
        files = files.withColumn("max_mb", F.lit(None).cast("int"))
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.regexp_extract(name, r"^.+\.([^.]+)$", 1)
    size_error = F.concat(
        F.lit("File too large: "),
        F.expr(fixed_point("length / 1024D / 1024D", 2)),
        F.lit("MB (max: "),
        F.col("max_mb").cast("string"),
        F.lit("MB)"),
    )
    error = (
        F.when(F.col("length") > F.col("max_mb") * F.lit(1024 * 1024).cast("bigint"), size_error)
        .when(F.col("content").isNull(), "File content was not read")
        .when(F.col("route") == "pdf", "Failed to load PDF: text extraction not available")
        .when(F.col("route") == "unsupported", F.concat(F.lit("Unsupported file type: "),
                                                        F.col("file_type")))
    )
    text = F.when(F.col("load_error").isNull(), F.when(F.col("route") == "image", IMAGE_TEXT)
                  .when(F.col("route") == "text", decode(F.col("content"))))
    failed = F.col("load_error").isNotNull()
    return (
        files.withColumns({"file_name": name, "_suffix": suffix, "file_type": F.lower(suffix)})
        .withColumn(
            "route",
            F.when(F.col("file_type").isin(TEXT_SUFFIXES), "text")
            .when(F.col("file_type").isin(PDF_SUFFIXES), "pdf")
            .when(F.col("file_type").isin(IMAGE_SUFFIXES), "image")
            .otherwise("unsupported"),
        )
        .withColumn("load_error", error)
        .select(
            F.col("path").alias("doc_id"),
            F.col("path").alias("file_path"),
            "file_name",
            F.when(failed, F.col("_suffix")).otherwise(F.col("file_type")).alias("file_type"),
            F.when(failed, F.lit(0)).otherwise(F.col("length")).cast("bigint")
            .alias("file_size_bytes"),
            F.lit(None).cast("int").alias("page_count"),
            F.lit(False).alias("ocr_applied"),
            F.when(~failed, F.sha2("content", 256)).alias("source_hash"),
            "route",
            text.alias("text"),
            "load_error",
        )
    )


def loaded(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("load_error").isNull())


def quarantined(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("load_error").isNotNull())


def not_found(requested: DataFrame, docs: DataFrame) -> DataFrame:
    """Error rows for requested paths (column ``path``) that no file answered."""
    name = F.element_at(F.split("path", "/"), -1)
    missing = requested.join(docs.select(F.col("file_path").alias("path")), "path", "left_anti")
    return missing.select(
        F.col("path").alias("doc_id"),
        F.col("path").alias("file_path"),
        name.alias("file_name"),
        F.regexp_extract(name, r"^.+\.([^.]+)$", 1).alias("file_type"),
        F.lit(0).cast("bigint").alias("file_size_bytes"),
        F.concat(F.lit("File not found: "), F.col("path")).alias("load_error"),
    )
