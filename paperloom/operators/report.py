"""Verdicts, projections, batch metrics and audit reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.basics import fixed_point
from paperloom.functions.fixed_values import THRESHOLDS
from paperloom.operators.percentiles import exact_percentiles, join_groups
from paperloom.sources.sinks import settle


def status(valid: Column) -> Column:
    """M1: recorded stage errors do not matter, only the verdict."""
    return F.when(valid, "completed").otherwise("requires_review")


def processing_time(total: Column, started: Column | None, finished: Column | None) -> Column:
    """M2: wall time in ms when both ends are known, else the sum of durations."""
    if started is None or finished is None:
        return total
    wall = (F.unix_micros(finished) - F.unix_micros(started)) / 1000.0
    return F.coalesce(wall, total)


def _entities(counts: str = "pii_summary") -> Column:
    return F.aggregate(F.map_values(counts), F.lit(0), lambda acc, n: acc + n)


def api_view(results: DataFrame, *keys: str) -> DataFrame:
    """M13."""
    return results.select(
        *keys, "success", "document_type", "extracted_data", "pii_summary",
        "validation_passed", "errors", "processing_time_ms",
    )


# ---- batch metrics ----------------------------------------------------------


def metric_inputs(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The few narrow columns that metrics need of a result row."""
    return results.select(
        *by,
        F.coalesce("success", F.lit(False)).alias("success"),
        F.coalesce("validation_passed", F.lit(False)).alias("validation_passed"),
        F.coalesce(F.size(F.map_keys("extracted_data")), F.lit(0)).alias("n_fields"),
        F.coalesce(_entities(), F.lit(0)).alias("n_pii"),
        F.col("processing_time_ms").cast("double").alias("processing_time_ms"),
    )


def metrics(inputs: DataFrame, by: Sequence[str] = (), scores: DataFrame | None = None) -> DataFrame:
    """M3, M4: one row over everything, or one per group.

    ``inputs`` as from ``metric_inputs``. Accuracy, recall and precision need
    ground truth: ``scores`` (one row per group with ``extraction_accuracy``,
    ``pii_recall``, ``pii_precision``) fills them, otherwise they are NULL.
    """
    n = F.col("total_documents")
    counts = inputs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_documents"),
        F.count_if("success").alias("successful_documents"),
        F.coalesce(F.sum("n_fields"), F.lit(0)).cast("bigint").alias("fields_extracted"),
        F.coalesce(F.sum("n_pii"), F.lit(0)).cast("bigint").alias("pii_total_detected"),
        F.count_if("validation_passed").alias("_passed"),
        F.coalesce(F.avg("processing_time_ms"), F.lit(0.0)).alias("avg_latency_ms"),
    )
    share = counts.select(
        *by,
        "total_documents",
        "successful_documents",
        (n - F.col("successful_documents")).alias("failed_documents"),
        F.when(n > 0, F.col("successful_documents") / n).otherwise(0.0)
        .alias("workflow_success_rate"),
        "fields_extracted",
        "pii_total_detected",
        F.when(n > 0, F.col("_passed") / n).otherwise(0.0).alias("validator_pass_rate"),
        "avg_latency_ms",
    )
    points = exact_percentiles(inputs, "processing_time_ms", by)
    if by:
        joined = join_groups(share, points, by)
    else:
        joined = beside(share, points, ("p50", "p95", "p99"))
    out = joined.withColumns({f"{p}_latency_ms": F.coalesce(p, F.lit(0.0)) for p in
                              ("p50", "p95", "p99")}).drop("p50", "p95", "p99")
    names = ("extraction_accuracy", "pii_recall", "pii_precision")
    if scores is None:
        return out.withColumns({c: F.lit(None).cast("double") for c in names})
    if by:
        return join_groups(out, scores.select(*by, *names), by)
    return beside(out, scores, names)


def metrics_by_levels(inputs: DataFrame, levels: Sequence[Sequence[str]]) -> DataFrame:
    """M3, M4 on several groupings in one pass, such as type, language and total.

    ``inputs`` as from ``metric_inputs`` with all columns that ``levels`` name. Columns: ``level``
    (the columns of the grouping, comma-joined; empty for the total), the group columns, the
    metrics. A column that a level does not group by is NULL, as is a group of rows without a value;
    ``level`` tells them apart. Each row is counted once for every level, percentiles are exact on each.
    The inputs are written once and read from there; levels are expanded before the one shuffle.
    """
    columns = list(dict.fromkeys(c for level in levels for c in level))
    kinds = dict(inputs.dtypes)
    sets = [
        F.struct(
            F.lit(",".join(level)).alias("level"),
            *[(F.col(c) if c in level else F.lit(None).cast(kinds[c])).alias(c) for c in columns],
        )
        for level in levels
    ]
    kept = settle(inputs.groupBy(*inputs.columns).agg(F.count(F.lit(1)).alias("_n")))
    rest = [c for c in inputs.columns if c not in columns]
    spread = kept.select(F.inline(F.array(*sets)), *rest, "_n")
    return _weighted_metrics(spread, ["level", *columns])


def _weighted_metrics(inputs: DataFrame, by: Sequence[str]) -> DataFrame:
    """``metrics`` of groups of rows that stand for ``_n`` equal rows each."""
    n = F.col("_n")
    time = F.col("processing_time_ms")
    total = F.col("total_documents")
    share = inputs.groupBy(*by).agg(
        F.sum(n).alias("total_documents"),
        F.sum(F.when(F.col("success"), n).otherwise(0)).alias("successful_documents"),
        F.sum(F.col("n_fields") * n).alias("fields_extracted"),
        F.sum(F.col("n_pii") * n).alias("pii_total_detected"),
        F.sum(F.when(F.col("validation_passed"), n).otherwise(0)).alias("_passed"),
        F.coalesce(F.try_divide(F.sum(time * n), F.sum(F.when(time.isNotNull(), n))), F.lit(0.0)).alias("avg_latency_ms"),
    )
    share = share.select(
        *by,
        "total_documents",
        "successful_documents",
        (total - F.col("successful_documents")).alias("failed_documents"),
        (F.col("successful_documents") / total).alias("workflow_success_rate"),
        "fields_extracted",
        "pii_total_detected",
        (F.col("_passed") / total).alias("validator_pass_rate"),
        "avg_latency_ms",
    )
    points = exact_percentiles(inputs, "processing_time_ms", by, weight="_n")
    out = join_groups(share, points, by)
    names = ("p50", "p95", "p99")
    return out.withColumns({f"{p}_latency_ms": F.coalesce(p, F.lit(0.0)) for p in names}).drop(*names)


def beside(df: DataFrame, row: DataFrame, names: Sequence[str]) -> DataFrame:
    """Columns of the one row of ``row``, NULL where it has none; more rows are an error."""
    found = row.select(F.struct(*names).alias("found")).scalar()
    return df.withColumn("_found", found).select("*", "_found.*").drop("_found")


def meets_thresholds(metrics_: DataFrame, limits: dict[str, float] = THRESHOLDS) -> DataFrame:
    """M5: five booleans beside the metrics."""
    measured = {
        "extraction_accuracy": F.col("extraction_accuracy") >= limits["extraction_accuracy"],
        "pii_recall": F.col("pii_recall") >= limits["pii_recall"],
        "pii_precision": F.col("pii_precision") >= limits["pii_precision"],
        "workflow_success": F.col("workflow_success_rate") >= limits["workflow_success"],
        "latency_p95": F.col("p95_latency_ms") <= limits["latency_p95"],
    }
    return metrics_.withColumns({f"meets_{k}": v for k, v in measured.items()})


# ---- decisions --------------------------------------------------------------


def _failed() -> Column:
    return F.coalesce(F.col("error_message"), F.lit("")) != ""


def agent_report(decisions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """M6: per agent; a missing confidence counts as 0 in the average."""
    n = F.count(F.lit(1))
    return decisions.groupBy(*by, "agent_type").agg(
        n.alias("decisions"),
        F.sum("duration_ms").alias("total_duration_ms"),
        F.avg("duration_ms").alias("avg_duration_ms"),
        F.count_if(_failed()).alias("errors"),
        (F.count_if(_failed()) / n).alias("error_rate"),
        (F.sum(F.coalesce("confidence", F.lit(0.0))) / n).alias("avg_confidence"),
    )


def decision_view(decisions: DataFrame, *keys: str) -> DataFrame:
    """M7: any message at all, even an empty one, is an error here."""
    return decisions.select(
        *keys,
        F.col("agent_type").alias("agent"),
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        "duration_ms",
        "confidence",
        F.col("error_message").isNotNull().alias("has_error"),
    )


def audit_summary(decisions: DataFrame, by: Sequence[str] = ("session_id",)) -> DataFrame:
    """M8: one row per group with a map of any agents; those without one are ``(none)``."""
    n = F.count(F.lit(1))
    totals = decisions.groupBy(*by).agg(
        n.alias("total_decisions"),
        F.sum("duration_ms").alias("total_duration_ms"),
        F.avg("duration_ms").alias("avg_duration_ms"),
        F.count_if(_failed()).alias("error_count"),
        (F.count_if(_failed()) / n).alias("error_rate"),
    )
    per_agent = decisions.groupBy(*by, F.coalesce("agent_type", F.lit("(none)")).alias("_agent"))
    entries = F.sort_array(F.collect_list(F.struct("_agent", "count")))
    maps = per_agent.count().groupBy(*by).agg(
        F.map_from_entries(entries).alias("decisions_by_agent")
    )
    return join_groups(totals, maps, by)


def precision_recall(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """M9: 0 wherever a denominator is 0."""

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {
        "precision": precision,
        "recall": recall,
        "f1_score": ratio(2 * (precision * recall), precision + recall),
    }


def evaluation_period(
    decisions: DataFrame, start: str | None = None, end: str | None = None, at: str = "timestamp"
) -> DataFrame:
    """Decisions with ``start <= at < end``; the filter reaches the scan."""
    out = decisions
    if start is not None:
        out = out.where(F.col(at) >= F.lit(start).cast("timestamp"))
    if end is not None:
        out = out.where(F.col(at) < F.lit(end).cast("timestamp"))
    return out


# ---- displays ---------------------------------------------------------------


def batch_summary(results: DataFrame, *keys: str) -> DataFrame:
    """One line per document. A document that could not be loaded shows ``-``;
    every other one counts as done here, whatever its verdict.
    """
    loaded = F.col("load_error").isNull()

    def shown(c: Column) -> Column:
        return F.when(loaded, c.cast("string")).otherwise("-")

    return results.select(
        *keys,
        F.col("file_name").alias("file"),
        F.when(loaded, "Success").otherwise("Failed").alias("status"),
        shown(F.coalesce("document_type", F.lit("unknown"))).alias("type"),
        shown(F.size(F.map_keys("extracted_data"))).alias("fields"),
        shown(F.coalesce(_entities(), F.lit(0))).alias("pii_found"),
        shown(F.expr(fixed_point("processing_time_ms", 1))).alias("time_ms"),
    )


def batch_footer(results: DataFrame) -> DataFrame:
    done = F.count_if(F.col("load_error").isNull())
    return results.agg(
        F.concat_ws("/", done.cast("string"), F.count(F.lit(1)).cast("string")).alias("done")
    )


def result_view(
    results: DataFrame, first: int | None = 10, width: int | None = 50
) -> DataFrame:
    """Lines (section, ord, label, value) that describe each result.

    The ``first`` fields are listed, with ``width`` characters of a value; None lists them whole.
    """

    def line(section: str, label, value) -> Column:
        return F.struct(
            F.lit(section).alias("section"),
            (label if isinstance(label, Column) else F.lit(label)).alias("label"),
            value.cast("string").alias("value"),
        )

    def short(v: Column) -> Column:
        text = F.coalesce(v, F.lit("None"))
        if width is None:
            return text
        return F.when(
            F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))
        ).otherwise(text)

    entries = F.map_entries("extracted_data")
    more = F.size(entries) - first if first is not None else F.lit(0)
    info = F.array(
        line("info", "File", F.col("file_name")),
        line("info", "Type", F.coalesce("document_type", F.lit("unknown"))),
        line("info", "Size",
             F.expr(f"concat({fixed_point('file_size_bytes / 1024D', 1)}, ' KB')")),
    )
    data = F.transform(
        entries if first is None else F.slice(entries, 1, first), lambda e: line("data", e["key"], short(e["value"]))
    )
    rest = F.array_compact(
        F.array(
            F.when(
                more > 0,
                line("data", "...", F.concat(F.lit("("), more.cast("string"),
                                             F.lit(" more fields)"))),
            )
        )
    )
    pii = F.transform(
        F.map_entries("pii_summary"), lambda e: line("pii", e["key"], e["value"])
    )
    rows = results.select(
        "doc_id", F.posexplode_outer(F.concat(info, data, rest, pii)).alias("ord", "line")
    )
    return rows.select("doc_id", "ord", "line.*")
