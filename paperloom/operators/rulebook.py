"""Catalogue rules as rows of a table, with versions by date (C1 with V1-V4)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions.basics import let, lit, reads_as_float, struct
from paperloom.functions.fixed_values import DOCUMENT_RULES, INVOICE_NUMERIC, RECEIPT_NUMERIC
from paperloom.functions.rules import ERROR

RULES = "document_type string, valid_from date, field string, kind string, pattern string, ord int"
#: Rule rows up to which the versions are sent to every task.
MAX_SENT = 10_000
#: Kinds of rules in the order in which a record's errors are listed. A number must read as one where
#: the record has the key (``number_here``) or where it has a value (``number``).
KINDS = ("required", "pattern", "number_here", "number")


def built_in(
    spark: SparkSession, catalogue: dict = DOCUMENT_RULES, valid_from: date | None = None
) -> DataFrame:
    """The catalogue as a rule table, one row per check."""
    rows = []
    for doc_type, (required, _, patterns) in catalogue.items():
        rows += [(doc_type, valid_from, f, "required", None, i) for i, f in enumerate(required)]
        rows += [
            (doc_type, valid_from, f, "pattern", p, i) for i, (f, p) in enumerate(patterns.items())
        ]
    for doc_type, kind, fields in (
        ("invoice", "number_here", INVOICE_NUMERIC), ("receipt", "number", RECEIPT_NUMERIC)
    ):
        if doc_type in catalogue:
            rows += [(doc_type, valid_from, f, kind, None, i) for i, f in enumerate(fields)]
    return spark.createDataFrame(rows, RULES)


def versions(rules: DataFrame) -> DataFrame:
    """(document_type, valid_from, valid_to, rules): one row per version of a type.

    A version holds all rules of its type that start on one day (NULL: from the beginning) and
    ends where the next begins. Equal rows count once; rows without a type or field, of an
    unknown kind, and patterns without a text are no rules, but they do begin a
    version, so a type without checks from a day on can be said by a row of kind ``none``.
    """
    rank = F.expr(f"array_position(array({', '.join(lit(k) for k in KINDS)}), kind)")
    usable = (rank > 0) & F.col("field").isNotNull() & ((F.col("kind") != "pattern") | F.col("pattern").isNotNull())
    rule = F.struct(rank.alias("rank"), "ord", "field", "kind", "pattern")
    grouped = (
        rules.where("document_type IS NOT NULL")
        .groupBy("document_type", "valid_from")
        .agg(F.array_sort(F.collect_set(F.when(usable, rule))).alias("rules"))
    )
    line = Window.partitionBy("document_type").orderBy(F.col("valid_from").asc_nulls_first())
    return grouped.withColumn("valid_to", F.lead("valid_from").over(line))


def _error_of(data: str, untruthy: str) -> str:
    """The error of rule ``r`` in one record, or NULL."""

    def error(kind: str, message: str, expected: str = "CAST(NULL AS STRING)", actual: str = "v") -> str:
        made = struct(
            field_name="r.field", error_type=lit(kind), error_message=message,
            expected_value=expected, actual_value=actual, severity="'error'",
        )
        return f"CAST({made} AS {ERROR})"

    truthy = f"(coalesce(v, '') <> '' AND NOT array_contains({untruthy}, r.field))"
    plain = "replace(replace(coalesce(v, 'None'), ',', ''), '$', '')"
    missing = error(
        "missing_required",
        f"concat({lit("Required field '")}, r.field, {lit("' is missing or empty")})",
        actual="CAST(NULL AS STRING)",
    )
    mismatch = error(
        "pattern_mismatch",
        f"concat({lit("Field '")}, r.field, {lit("' value '")}, v, "
        f"{lit("' does not match expected pattern")})",
        expected="r.pattern",
    )
    no_number = error("invalid_type", f"concat(r.field, {lit(' must be numeric')})")
    checks = (
        f"CASE WHEN r.kind = 'required' THEN CASE WHEN coalesce(v, '') = '' THEN {missing} END "
        f"WHEN r.kind = 'pattern' THEN CASE WHEN {truthy} AND NOT (v RLIKE concat('(?Ud)', r.pattern)) THEN {mismatch} END "
        f"WHEN (r.kind = 'number_here' AND map_contains_key({data}, r.field) OR r.kind = 'number' AND {truthy}) "
        f"AND NOT {reads_as_float(plain)} THEN {no_number} END"
    )
    return let("v", f"try_element_at({data}, r.field)", checks)


def check(
    records: DataFrame,
    rules: DataFrame,
    on: str = "CAST(NULL AS DATE)",
    untruthy: str = "CAST(array() AS array<string>)",
) -> DataFrame:
    """Records with ``rules_from`` and ``errors`` by the version of their type in force.

    ``on`` is the date (column or expression) that a record is judged at; without one the latest
    version counts. Records before the first version and of types without rules have no errors; a
    NULL ``structured_data`` is the one error ``missing_data``. Patterns are read from the rows, and a pattern
    that is not a regular expression fails the job. Up to MAX_SENT rules (counted here) are broadcast, a
    larger table is joined by a shuffle in which Spark splits hot types.
    """
    known = versions(rules).select(
        F.col("document_type").alias("_type"), F.col("valid_from").alias("rules_from"),
        F.col("valid_to").alias("_to"), F.col("rules").alias("_rules"),
    )
    if rules.limit(MAX_SENT + 1).count() <= MAX_SENT:
        known = F.broadcast(known)
    dated = records.withColumn("_on", F.expr(f"CAST({on} AS DATE)"))
    in_force = (
        (F.col("document_type") == F.col("_type"))
        & F.expr("rules_from IS NULL OR _on IS NULL OR rules_from <= _on")
        & F.expr("_to IS NULL OR _on < _to")
    )
    no_data = struct(
        field_name="'extracted_data'", error_type="'missing_data'",
        error_message="'No extracted data to validate'", expected_value="NULL",
        actual_value="NULL", severity="'error'",
    )
    errors = (
        f"CASE WHEN structured_data IS NULL THEN array(CAST({no_data} AS {ERROR})) ELSE "
        f"array_compact(transform(coalesce(_rules, array()), r -> {_error_of('structured_data', untruthy)})) END"
    )
    return (
        dated.join(known, in_force, "left")
        .withColumn("errors", F.expr(errors))
        .drop("_type", "_to", "_rules", "_on")
    )


def error_rows(checked: DataFrame) -> DataFrame:
    """One row per error, numbered within its record, with the version that found it."""
    rows = checked.select(
        "doc_id", "document_type", "rules_from", F.posexplode_outer("errors").alias("ord", "error")
    )
    return rows.where("ord IS NOT NULL").select(
        "doc_id", "document_type", "rules_from", "ord", "error.*"
    )
