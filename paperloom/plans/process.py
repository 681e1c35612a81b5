"""The whole chain over a table of documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.fixed_values import MAX_REPAIR_ATTEMPTS
from paperloom.operators import redact, replies, report, trace, validate
from paperloom.sources.sinks import settle

_ANSWER = "struct<attempt:int,reply:string,error:string,duration_ms:double>"


@dataclass(frozen=True)
class ProcessOptions:
    mode: str = "compat"
    use_model_spans: bool = True
    max_repair_attempts: int = MAX_REPAIR_ATTEMPTS
    model: str | None = None
    run_at: str = "current_timestamp()"
    trace_names: int | None = None
    summary_chars: int | None = None


def process(
    docs: DataFrame, answers: DataFrame | None = None, options: ProcessOptions = ProcessOptions()
) -> DataFrame:
    """Classify, extract, validate with repair, redact and report every document.

    ``docs`` has ``doc_id`` and ``text``, and may have the columns of
    ``sources.files.ingest``. ``answers`` is the reply table of
    ``operators.replies``. One join brings all replies to their document; every
    stage after it works inside the row.
    """
    full = _with_defaults(docs)
    if answers is None:
        slots = {c: F.lit(None).cast(_ANSWER) for c in ("classify", "extract", "detect_pii")}
        slots["repairs"] = F.array_repeat(
            F.lit(None).cast(_ANSWER), options.max_repair_attempts
        )
        full = full.withColumns(slots)
    else:
        full = replies.attach(full, replies.gather(answers, options.max_repair_attempts))
    read = (
        full.transform(replies.read_classification)
        .transform(replies.read_extraction)
        .transform(replies.read_detection)
    )
    checked = validate.validate(read, replies.corrections(), "untruthy")
    masked = redact.redact(
        checked,
        model_spans="model_spans" if options.use_model_spans else None,
        mode=options.mode,
    )
    loaded = F.col("load_error").isNull()
    valid = F.col("validation.is_valid")
    judged = masked.withColumn("success", loaded & valid)
    traced = trace.add_trace(
        judged, options.run_at, options.model, options.trace_names, options.summary_chars
    )
    started = F.col("started_at") if "started_at" in docs.columns else None
    finished = F.col("finished_at") if "finished_at" in docs.columns else None
    time = report.processing_time(F.expr(trace.stage_time()), started, finished)
    stage_errors = F.array_compact(F.array("classify_error", "extract_error"))

    def when_loaded(value: Column, kind: str | None = None, otherwise=None) -> Column:
        return F.when(loaded, value).otherwise(F.lit(otherwise) if kind is None else
                                               F.lit(otherwise).cast(kind))

    no_map = F.create_map().cast
    return traced.select(
        "doc_id",
        "file_name",
        "file_type",
        "file_size_bytes",
        "load_error",
        "success",
        F.when(loaded, report.status(valid)).otherwise("failed").alias("status"),
        when_loaded(F.col("document_type"), "string").alias("document_type"),
        when_loaded(F.col("classification_confidence"), otherwise=0.0)
        .alias("classification_confidence"),
        F.when(loaded, F.col("structured_data")).otherwise(no_map("map<string,string>"))
        .alias("extracted_data"),
        "fields",
        when_loaded(F.col("redacted_text"), "string").alias("redacted_text"),
        F.when(loaded, F.col("pii_by_type")).otherwise(no_map("map<string,int>"))
        .alias("pii_summary"),
        when_loaded(valid, otherwise=False).alias("validation_passed"),
        "validation",
        F.when(loaded, stage_errors).otherwise(F.array("load_error")).alias("errors"),
        when_loaded(time, otherwise=0.0).alias("processing_time_ms"),
        F.when(loaded, F.col("agent_trace")).otherwise(F.array().cast(
            f"array<{trace.DECISION}>")).alias("agent_trace"),
        F.when(loaded, F.col("audit")).otherwise(F.array().cast(
            f"array<{trace.DECISION}>")).alias("audit"),
        (~loaded | (F.size(stage_errors) > 0)).alias("had_errors"),
    )


def _with_defaults(docs: DataFrame) -> DataFrame:
    wanted = {
        "file_name": "string",
        "file_type": "string",
        "file_size_bytes": "bigint",
        "load_error": "string",
    }
    missing = {c: F.lit(None).cast(t) for c, t in wanted.items() if c not in docs.columns}
    return docs.withColumns(missing) if missing else docs


def batch_metrics(results: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Metrics over results that are still to be computed.

    Percentiles read their input more than once, so the few numbers they need are
    computed once and kept, not the stages before them repeated.
    """
    return report.meets_thresholds(report.metrics(settle(report.metric_inputs(results, by)), by))
