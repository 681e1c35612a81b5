"""Scoring against ground truth (R4 over tables, M9, M15)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.operators.report import precision_recall

# Spans are compared inside blocks of this many characters, so even one huge
# document is spread over many tasks.
BLOCK_CHARS = 4096


def compare_spans(found: DataFrame, truth: DataFrame, keys: Sequence[str]) -> DataFrame:
    """R4 between two span tables, both ways in one pass: the distinct spans of each,
    ``is_true`` for those of ``truth``, with their count ``n`` and whether a span of the
    other table with the same keys overlaps them.

    No pair is ever produced. Within a block, the spans that start before a span's end
    are the ones it can overlap, and it does overlap one exactly when the furthest of
    their ends lies beyond its start: a running maximum over one sort. Duplicates go
    before the sort, so a block holds a number of spans bounded by its length.
    """
    span = [*keys, "start_index", "end_index", "is_true"]
    first = F.floor(F.least("start_index", F.col("end_index") - 1) / BLOCK_CHARS)
    last = F.floor(F.greatest("start_index", F.col("end_index") - 1) / BLOCK_CHARS)
    # On equal positions the question (given = 0) comes first: starting where a span
    # ends is not an overlap.
    events = F.array(
        F.struct(F.col("end_index").alias("at"), F.lit(0).alias("given")),
        F.struct(F.col("start_index").alias("at"), F.lit(1).alias("given")),
    )
    plain = [*keys, "start_index", "end_index"]
    both = found.select(*plain, F.lit(False).alias("is_true")).unionByName(
        truth.select(*plain, F.lit(True).alias("is_true"))
    )
    upto = (
        W.partitionBy(*keys, "block").orderBy("at", "given")
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )

    def reach(of_truth: bool) -> Column:
        here = (F.col("given") == 1) & (F.col("is_true") == of_truth)
        return F.max(F.when(here, F.col("end_index"))).over(upto)

    other = F.when(F.col("is_true"), F.col("_found")).otherwise(F.col("_true"))
    return (
        both.groupBy(*span)
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("block", F.explode(F.sequence(first, last)))
        .select(*span, "n", "block", F.inline(events))
        .withColumns({"_found": reach(False), "_true": reach(True)})
        .where("given = 0")
        .groupBy(*span)
        .agg(
            F.max("n").alias("n"),
            F.max(F.coalesce(other > F.col("start_index"), F.lit(False))).alias("overlapped"),
        )
    )


def flag_overlaps(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The distinct spans of ``left`` with their count ``n`` and whether any span of
    ``right`` with the same keys overlaps them.
    """
    return compare_spans(left, right, keys).where("NOT is_true").drop("is_true")


def score_spans(
    found: DataFrame,
    truth: DataFrame,
    by: Sequence[str] = (),
    keys: Sequence[str] = ("doc_id", "pii_type"),
) -> DataFrame:
    """A found span is right when it overlaps a true one of its type; a true
    span is missed when no found one overlaps it. ``by`` must be among ``keys``.
    """
    hit, true = F.col("overlapped"), F.col("is_true")

    def spans(where: Column) -> Column:
        return F.when(where, F.col("n")).otherwise(0)

    counted = compare_spans(found, truth, keys).select(
        *by, spans(~true & hit).alias("tp"), spans(~true & ~hit).alias("fp"),
        spans(true & ~hit).alias("fn"),
    )
    counts = counted.groupBy(*by).agg(
        F.coalesce(F.sum("tp"), F.lit(0)).cast("bigint").alias("true_positives"),
        F.coalesce(F.sum("fp"), F.lit(0)).cast("bigint").alias("false_positives"),
        F.coalesce(F.sum("fn"), F.lit(0)).cast("bigint").alias("false_negatives"),
    )
    scores = precision_recall(
        F.col("true_positives"), F.col("false_positives"), F.col("false_negatives")
    )
    total = F.col("true_positives") + F.col("false_positives")
    return counts.withColumn("total_detected", total).withColumns(scores)


def score_fields(
    fields: DataFrame, truth: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """Of the true fields ``(doc_id, name, value)``, how many came out right.

    Both sides are reduced to one value per key first, so a repeated key cannot
    multiply rows.
    """
    got = fields.groupBy("doc_id", "name").agg(F.max("value").alias("got"))
    want = truth.groupBy("doc_id", "name", *by).agg(F.max("value").alias("want"))
    right = F.count_if(F.col("got").eqNullSafe(F.col("want")) & F.col("want").isNotNull())
    n = F.count(F.lit(1))
    return (
        want.join(got, ["doc_id", "name"], "left")
        .groupBy(*by)
        .agg(n.alias("fields_total"), right.alias("fields_correct"))
        .withColumn(
            "extraction_accuracy",
            F.when(F.col("fields_total") > 0, F.col("fields_correct") / F.col("fields_total"))
            .otherwise(0.0),
        )
    )


def score_types(
    results: DataFrame, truth: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """Share of labelled documents whose predicted type is the true one.

    A labelled document without a prediction counts, as a wrong one.
    """
    want = truth.groupBy("doc_id", *by).agg(F.max("document_type").alias("want"))
    right = F.count_if(F.col("document_type") == F.col("want"))
    return (
        want.join(results.select("doc_id", "document_type"), "doc_id", "left")
        .groupBy(*by)
        .agg(F.count(F.lit(1)).alias("documents"), right.alias("correct"))
        .withColumn(
            "classifier_accuracy",
            F.when(F.col("documents") > 0, F.col("correct") / F.col("documents")).otherwise(0.0),
        )
    )


def score_repairs(validated: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Repaired records among those where repair was tried."""
    tried = F.count_if("validation.repair_attempted")
    fixed = F.count_if("validation.repair_successful")
    return (
        validated.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("records"),
            tried.alias("repair_attempted"),
            fixed.alias("repair_successful"),
        )
        .withColumn(
            "repair_success_rate",
            F.when(
                F.col("repair_attempted") > 0,
                F.col("repair_successful") / F.col("repair_attempted"),
            ).otherwise(0.0),
        )
    )
