"""The rule catalogue as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.fixed_values import DOCUMENT_RULES, DOCUMENT_TYPES

_RULES = "document_type string, field string, kind string, pattern string, ord int"


def rule_table(spark: SparkSession) -> DataFrame:
    """One row per required field, optional field and pattern. 70 rows."""
    rows = []
    for doc_type, (required, optional, patterns) in DOCUMENT_RULES.items():
        rows += [(doc_type, f, "required", None, i) for i, f in enumerate(required)]
        rows += [(doc_type, f, "optional", None, i) for i, f in enumerate(optional)]
        rows += [(doc_type, f, "pattern", p, i) for i, (f, p) in enumerate(patterns.items())]
    return spark.createDataFrame(rows, _RULES)


def type_table(spark: SparkSession) -> DataFrame:
    """The twelve types with the first three fields of each kind."""

    def brief(fields: list[str]) -> str:
        text = ", ".join(fields[:3]) + ("..." if len(fields) > 3 else "")
        return text or "-"

    nothing = ([], [], {})
    rows = [
        (i, t, brief(DOCUMENT_RULES.get(t, nothing)[0]), brief(DOCUMENT_RULES.get(t, nothing)[1]))
        for i, t in enumerate(DOCUMENT_TYPES)
    ]
    return spark.createDataFrame(
        rows, "ord int, document_type string, required_fields string, optional_fields string"
    )


def type_usage(records: DataFrame) -> DataFrame:
    """C3 next to the data: each listed type with the number of records it has.

    Records of other types and of none follow as ``(unlisted)`` and ``(none)`` where there
    are any, so the counts are at most fourteen rows and add up to the input.
    """
    types = type_table(records.sparkSession)
    kind = (
        F.when(F.col("document_type").isin(DOCUMENT_TYPES), F.col("document_type"))
        .when(F.col("document_type").isNull(), "(none)")
        .otherwise("(unlisted)")
    )
    counts = records.groupBy(kind.alias("document_type")).agg(F.count(F.lit(1)).alias("records"))
    return (
        types.join(F.broadcast(counts), "document_type", "full")
        .withColumn("records", F.coalesce("records", F.lit(0)))
    )


def field_coverage(records: DataFrame) -> DataFrame:
    """C1 next to the data: per catalogue field, how many records fill it."""
    fields = rule_table(records.sparkSession).where("kind != 'pattern'")
    keys = ["document_type", "field"]
    filled = (
        records.select("document_type", F.explode("structured_data").alias("field", "value"))
        .where(F.coalesce(F.col("value"), F.lit("")) != "")
        .join(F.broadcast(fields.select(*keys)), keys, "left_semi")  # 64 catalogue rows
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("filled"))
    )
    return (
        fields.join(F.broadcast(filled), keys, "left")  # at most one row per catalogue row
        .select(
            "document_type", "kind", "ord", "field", F.coalesce("filled", F.lit(0)).alias("filled")
        )
    )
