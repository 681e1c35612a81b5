"""Validation of extracted records (V1-V9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions import rules
from paperloom.functions.basics import empty, struct
from paperloom.functions.fixed_values import DOCUMENT_RULES


def validate(
    df: DataFrame,
    fixes: str | None = None,
    untruthy: str | None = None,
    catalogue: dict = DOCUMENT_RULES,
) -> DataFrame:
    """Add ``validation`` and replace ``structured_data`` by its repaired form.

    Needs ``document_type`` and ``structured_data MAP<STRING,STRING>``. ``fixes``
    is a column or expression with one correction per allowed attempt, evaluated
    only for records with errors; without it nothing is repaired. Row-local: no
    shuffle, works on a stream.
    """
    none = empty("string")
    kind = "coalesce(document_type, 'unknown')"
    falsy = f"coalesce({untruthy}, {none})" if untruthy else none
    data = "structured_data"
    if fixes:
        rounds = rules.repair_rounds(kind, data, falsy, "_errors", fixes, catalogue)
    else:
        rounds = rules.first_visit(data, falsy, "_errors")
    verdict = struct(
        is_valid="size(_state.errors) = 0",
        errors="_state.errors",
        warnings=empty(rules.ERROR),
        schema_version="'1.0'",
        repair_attempted="_state.attempts > 0",
        repair_successful="_state.attempts > 0 AND size(_state.errors) = 0",
        attempts="_state.attempts",
        visits="_state.visits",
    )
    return (
        df.withColumn("_errors", F.expr(rules.rule_errors(kind, data, falsy, catalogue)))
        .withColumn("_state", F.expr(rounds))
        .withColumns({"validation": F.expr(verdict), "structured_data": F.col("_state.data")})
        .drop("_errors", "_state")
    )


def error_rows(df: DataFrame, keys: tuple[str, ...] = ("doc_id", "document_type")) -> DataFrame:
    """One row per error, numbered in catalogue order."""
    # The outer form keeps Spark from evaluating the rules a second time in a
    # filter for records without errors.
    rows = df.select(*keys, F.posexplode_outer("validation.errors").alias("ord", "error"))
    return rows.where("ord IS NOT NULL").select(*keys, "ord", "error.*")


def error_report(df: DataFrame) -> DataFrame:
    """V9: how often each field breaks each rule, per document type."""
    return (
        error_rows(df, ("document_type",))
        .groupBy("document_type", "field_name", "error_type")
        .agg(F.count(F.lit(1)).alias("n"))
    )
