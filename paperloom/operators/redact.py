"""Detection and masking of personal data over a table of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions import masking, spans


def detect(df: DataFrame, text: str = "text", out: str = "pii_spans") -> DataFrame:
    """Add the pattern spans of every row as one array column."""
    return df.withColumn(out, F.expr(spans.pattern_spans(f"coalesce({text}, '')")))


def redact(
    df: DataFrame, text: str = "text", model_spans: str | None = None, mode: str = "compat"
) -> DataFrame:
    """Add ``redacted_text``, ``pii_entities``, ``total_pii_found``, ``pii_by_type``.

    ``mode='compat'`` masks by value, last span first; ``mode='clean'`` resolves
    overlaps first and masks by position. ``model_spans`` names the column of the
    second detector and switches it on (R8). Row-local: no shuffle, works on a
    stream.
    """
    if mode not in ("compat", "clean"):
        raise ValueError(f"mode must be 'compat' or 'clean', not {mode!r}")
    body = f"coalesce({text}, '')"
    ordered = (
        spans.merge_spans("_found", model_spans) if model_spans else spans.in_start_order("_found")
    )
    if mode == "compat":
        done = masking.mask_by_value(body, "_all")
    else:
        done = masking.mask_by_place(body, "_all")
        ordered = spans.resolve(body, ordered)
    return (
        detect(df, text, "_found")
        .withColumn("_all", F.expr(ordered))
        .withColumn("_done", F.expr(done))
        .withColumns(
            {
                "redacted_text": F.col("_done.text"),
                "pii_entities": F.col("_done.kept"),
                "total_pii_found": F.size("_done.kept"),
                "pii_by_type": F.expr(masking.count_by_type("_done.kept")),
                "pattern_spans_found": F.size("_found"),
                "model_spans_found": F.size(model_spans) if model_spans else F.lit(0),
            }
        )
        .drop("_found", "_all", "_done")
    )


def span_rows(
    df: DataFrame, spans_col: str = "pii_entities", keys: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """One row per span, numbered within its row."""
    # The outer form keeps Spark from running the detection a second time in a
    # filter for rows without spans.
    rows = df.select(*keys, F.posexplode_outer(spans_col).alias("ord", "span"))
    return rows.where("ord IS NOT NULL").select(*keys, "ord", "span.*")


def spans_with_context(df: DataFrame, text: str = "text") -> DataFrame:
    """R2: span rows with their surroundings; opt-in since it repeats raw text."""
    named = detect(df, text).withColumn(
        "_in", F.expr(f"transform(pii_spans, s -> {spans.context(text, 's')})")
    )
    rows = named.select(
        "doc_id", F.posexplode_outer(F.arrays_zip("pii_spans", "_in")).alias("ord", "z")
    ).where("ord IS NOT NULL")
    return rows.select("doc_id", "ord", "z.pii_spans.*", F.col("z._in").alias("context"))


def corpus_profile(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Entities and documents per type over a batch.

    Each row holds a type at most once in its map, so documents are counted
    without a distinct: one shuffle of pre-aggregated counts.
    """
    return (
        df.select(*by, F.explode_outer("pii_by_type").alias("pii_type", "n"))
        .where("n IS NOT NULL")
        .groupBy(*by, "pii_type")
        .agg(
            F.sum("n").cast("bigint").alias("entities"),
            F.count(F.lit(1)).alias("documents"),
        )
    )
