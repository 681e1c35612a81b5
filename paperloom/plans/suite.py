"""One query per operator, over the given tables; every result is flat."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import prompts
from paperloom.operators import (
    catalogue,
    evaluate,
    overlaps,
    periods,
    quantile_states,
    redact,
    replies,
    report,
    requests,
    rulebook,
    trace,
    validate,
)
from paperloom.operators.percentiles import exact_percentiles
from paperloom.plans import derived as D
from paperloom.plans.process import ProcessOptions, process
from paperloom.sources import commits, ledger, sinks
from paperloom.sources import files as file_source
from paperloom.sources.sinks import settle
from paperloom.streaming import documents as stream
from paperloom.streaming import repairs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _long(*names: str):
    return [F.col(n).cast("bigint").alias(n) for n in names]


def _round(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# ---- personal data ----------------------------------------------------------


@query
def pii_counts_by_language(spark, sf):
    """Flagship: detect, mask and count over the whole corpus."""
    masked = redact.redact(D.documents(spark, sf, "lang"))
    return redact.corpus_profile(masked, ("lang",))


@query
def pii_spans(spark, sf):
    rows = redact.span_rows(redact.detect(D.documents(spark, sf)), "pii_spans")
    return rows.select(
        "doc_id", *_long("ord", "start_index", "end_index"), "pii_type", "original_value",
        "masked_value", "confidence",
    )


@query
def pii_spans_in_conversations(spark, sf):
    rows = redact.span_rows(
        redact.detect(D.turns(spark, sf)), "pii_spans", ("conv_id", "turn")
    )
    return rows.select(
        "conv_id", "turn", *_long("ord", "start_index", "end_index"), "pii_type", "original_value"
    )


@query
def pii_context(spark, sf):
    rows = redact.spans_with_context(D.documents(spark, sf))
    return rows.select("doc_id", *_long("ord"), "pii_type", "context")


@query
def pii_redacted_text(spark, sf):
    done = redact.redact(D.documents(spark, sf))
    return done.select("doc_id", "redacted_text", *_long("total_pii_found"))


@query
def pii_redacted_text_clean(spark, sf):
    done = redact.redact(D.documents(spark, sf), mode="clean")
    return done.select("doc_id", "redacted_text", *_long("total_pii_found"))


@query
def pii_counts(spark, sf):
    done = redact.redact(D.documents(spark, sf))
    rows = done.select("doc_id", F.explode_outer("pii_by_type").alias("pii_type", "n"))
    return rows.where("n IS NOT NULL").select("doc_id", "pii_type", *_long("n"))


@query
def pii_corpus_profile(spark, sf):
    return redact.corpus_profile(redact.redact(D.documents(spark, sf)))


def _with_model_spans(spark, sf):
    gathered = replies.gather(D.answers(spark, sf, "detect_pii"))
    return replies.read_detection(replies.attach(D.documents(spark, sf), gathered))


@query
def pii_model_spans(spark, sf):
    rows = redact.span_rows(_with_model_spans(spark, sf), "model_spans")
    return rows.select(
        "doc_id", *_long("ord", "start_index", "end_index"), "pii_type", "original_value",
        "masked_value", "confidence",
    )


@query
def pii_window_spans(spark, sf):
    """Model spans in windows of each text, at their places in the whole text."""
    found = replies.window_detections(D.window_answers(spark, sf))
    return found.select("doc_id", F.inline("model_spans")).select(
        "doc_id", *_long("start_index", "end_index"), "pii_type"
    )


@query
def pii_merged_redaction(spark, sf):
    done = redact.redact(_with_model_spans(spark, sf), model_spans="model_spans")
    return done.select(
        "doc_id", "redacted_text",
        *_long("total_pii_found", "pattern_spans_found", "model_spans_found"),
    )


@query
def pii_merged_spans(spark, sf):
    done = redact.redact(_with_model_spans(spark, sf), model_spans="model_spans")
    rows = redact.span_rows(done)
    return rows.select(
        "doc_id", *_long("ord", "start_index", "end_index"), "pii_type", "confidence"
    )


@query
def pii_span_overlaps(spark, sf):
    """Found spans that overlap a true span of their type."""
    found, truth = D.found_spans(spark, sf), D.true_spans(spark, sf)
    flags = evaluate.flag_overlaps(found, truth, ("doc_id", "pii_type"))
    return flags.select(
        "doc_id", "pii_type", *_long("start_index", "end_index", "n"), "overlapped"
    )


@query
def pii_overlap_pairs(spark, sf):
    """Pairs of a found span and a true span of a document that overlap, whatever their types."""
    found, truth = D.found_spans(spark, sf).drop("text"), D.true_spans(spark, sf)
    kept = ["doc_id", "pii_type", "start_index", "end_index"]
    pairs = overlaps.overlap_pairs(found.select(*kept), truth.select(*kept), ("doc_id",))
    return pairs.select(
        "doc_id",
        *[F.col(f"{side}.{c}").cast(kind).alias(f"{side}_{c}") for side in ("left", "right")
          for c, kind in (("pii_type", "string"), ("start_index", "bigint"), ("end_index", "bigint"))],
    )


@query
def pii_detection_scores(spark, sf):
    found, truth = D.found_spans(spark, sf), D.true_spans(spark, sf)
    scores = evaluate.score_spans(found, truth, by=("pii_type",))
    return _round(scores, "precision", "recall", "f1_score")


# ---- requests and replies ---------------------------------------------------


def _request_facts(df: DataFrame, *extra: str) -> DataFrame:
    return df.select(
        "doc_id", *extra,
        F.length("request").cast("bigint").alias("n_chars"),
        F.sha2("request", 256).alias("request_hash"),
    )


@query
def classification_requests(spark, sf):
    return _request_facts(requests.classification_requests(D.documents(spark, sf)))


@query
def extraction_requests(spark, sf):
    typed = D.documents(spark, sf).withColumn("document_type", F.expr(f"lower({D.KIND})"))
    return _request_facts(requests.extraction_requests(typed), "document_type")


@query
def detection_requests(spark, sf):
    rows = requests.detection_requests(
        D.documents(spark, sf), limit=8000, overlap=D.WINDOW_OVERLAP
    )
    return _request_facts(rows, "part", "offset")


@query
def repair_request_errors(spark, sf):
    """The error lines that go into repair requests, empty for a valid invoice."""
    checked = validate.validate(D.invoices(spark, sf))
    return checked.select(
        "doc_id", F.expr(prompts.error_lines("validation.errors")).alias("error_lines")
    )


@query
def repair_requests(spark, sf):
    texts = D.documents(spark, sf).select(F.col("doc_id").alias("k"), "text")
    checked = validate.validate(D.invoices(spark, sf)).join(texts, "k", "left")
    rows = requests.repair_requests(checked, max_attempts=3)
    return _request_facts(rows.withColumn("attempt", F.col("attempt").cast("bigint")), "attempt")


@query
def reply_payloads(spark, sf):
    rows = replies.payloads(D.answers(spark, sf, "classify", "detect_pii"))
    return rows.select("doc_id", "stage", "payload", "is_json")


@query
def classification_replies(spark, sf):
    keys = D.table(spark, sf, "documents").select("doc_id")
    gathered = replies.gather(D.answers(spark, sf, "classify"))
    read = replies.read_classification(replies.attach(keys, gathered))
    return read.select(
        "doc_id", "document_type", "classification_confidence", "reasoning", "classify_error"
    )


@query
def repeated_key_replies(spark, sf):
    """Replies that repeat keys, of which the last counts."""
    read = replies.read_classification(replies.gather(D.repeated_key_answers(spark, sf)))
    return read.select(
        "doc_id", "document_type", "classification_confidence", "reasoning", "classify_error"
    )


def _extracted(spark, sf):
    keys = D.table(spark, sf, "documents").select("doc_id")
    gathered = replies.gather(D.answers(spark, sf, "extract"))
    return replies.read_extraction(replies.attach(keys, gathered))


@query
def extracted_fields(spark, sf):
    rows = _extracted(spark, sf).select("doc_id", F.posexplode_outer("fields").alias("ord", "f"))
    return rows.where("ord IS NOT NULL").select("doc_id", *_long("ord"), "f.*")


@query
def extraction_replies(spark, sf):
    read = _extracted(spark, sf)
    return _round(
        read.select(
            "doc_id",
            F.size("fields").cast("bigint").alias("n_fields"),
            F.size("structured_data").cast("bigint").alias("n_values"),
            F.array_join("untruthy", ",").alias("untruthy"),
            "avg_confidence",
            "extract_error",
        ),
        "avg_confidence",
    )


@query
def extracted_values(spark, sf):
    rows = _extracted(spark, sf)
    named = rows.select("doc_id", F.explode_outer("structured_data").alias("name", "value"))
    return named.where("name IS NOT NULL")


@query
def repair_replies(spark, sf):
    gathered = replies.gather(D.repair_replies(spark, sf))
    read = replies.read_repairs(gathered)
    rows = read.select("doc_id", F.posexplode_outer("fixes").alias("pos", "fix"))
    return rows.select(
        "doc_id",
        (F.col("pos") + 1).cast("bigint").alias("attempt"),
        F.col("fix").isNotNull().alias("usable"),
        F.to_json("fix.data").alias("corrected"),
    )


# ---- validation -------------------------------------------------------------


@query
def record_verdicts(spark, sf):
    done = validate.validate(D.records(spark, sf))
    return done.select(
        "doc_id", "document_type",
        F.col("validation.is_valid").alias("is_valid"),
        F.size("validation.errors").cast("bigint").alias("n_errors"),
    )


@query
def record_errors(spark, sf):
    rows = validate.error_rows(validate.validate(D.records(spark, sf)))
    return rows.withColumn("ord", F.col("ord").cast("bigint"))


@query
def versioned_record_errors(spark, sf):
    """Errors by rules that are rows: the version of a type in force on the record's day."""
    checked = rulebook.check(D.dated_records(spark, sf), D.rule_versions(spark), on="issued")
    return rulebook.error_rows(checked).withColumns(
        {"ord": F.col("ord").cast("bigint"), "rules_from": F.col("rules_from").cast("string")}
    )


@query
def record_error_report(spark, sf):
    return validate.error_report(validate.validate(D.records(spark, sf)))


def _repaired(spark, sf):
    gathered = replies.gather(D.repair_replies(spark, sf))
    joined = replies.attach(D.invoices(spark, sf), gathered)
    return validate.validate(joined, replies.corrections())


@query
def repair_rounds(spark, sf):
    return _round_columns(_repaired(spark, sf))


def _round_columns(done):
    return done.select(
        "doc_id",
        F.col("validation.is_valid").alias("is_valid"),
        F.col("validation.attempts").cast("bigint").alias("attempts"),
        F.col("validation.repair_attempted").alias("repair_attempted"),
        F.col("validation.repair_successful").alias("repair_successful"),
        F.size("validation.errors").cast("bigint").alias("n_errors"),
        F.size("validation.visits").cast("bigint").alias("n_visits"),
        F.try_element_at("structured_data", F.lit("date")).alias("date"),
        F.try_element_at("structured_data", F.lit("vendor_name")).alias("vendor_name"),
    )


@query
def repair_success(spark, sf):
    done = _repaired(spark, sf).withColumn("o_mod", F.col("k") % 4)
    return _round(evaluate.score_repairs(done, by=("o_mod",)), "repair_success_rate")


@query
def catalogue_types(spark, sf):
    return catalogue.type_usage(D.records(spark, sf)).withColumn(
        "ord", F.col("ord").cast("bigint")
    )


@query
def catalogue_fields(spark, sf):
    return catalogue.field_coverage(D.records(spark, sf)).withColumn(
        "ord", F.col("ord").cast("bigint")
    )


# ---- decisions --------------------------------------------------------------


@query
def latency_percentiles(spark, sf):
    return exact_percentiles(D.decisions(spark, sf), "duration_ms", ("agent_type",))


@query
def latency_percentiles_overall(spark, sf):
    return exact_percentiles(D.decisions(spark, sf), "duration_ms")


@query
def latency_states(spark, sf):
    """Percentiles from states kept per session, merged per agent, with their true rank errors."""
    rows = D.decisions(spark, sf)
    path = sinks.scratch(spark, "states")
    states = quantile_states.quantile_state(rows, "duration_ms", ("session_id", "agent_type"), 32)
    commits.write_batch(states, path, "all", ("session_id",))
    kept = quantile_states.merged_state(commits.read_table(spark, path), ("agent_type",), 64)
    found = quantile_states.state_quantiles(kept, ("agent_type",))
    return quantile_states.rank_errors(rows, "duration_ms", found, ("agent_type",))


@query
def decision_periods(spark, sf):
    """Each decision with the evaluation period in force at its time."""
    found = periods.period_at(D.decisions(spark, sf), D.periods(spark, sf), ("agent_type",))
    return found.select("doc_id", "agent_type", F.col("period.name").alias("period"), F.col("period.start_at").alias("start_at"))


@query
def running_audit(spark, sf):
    """Totals per session and agent after three appends, one of them retried."""
    path = sinks.scratch(spark, "audit")
    rows = D.decisions(spark, sf)
    for batch in (0, 1, 1, 2):
        sinks.append_with_totals(rows.where(F.col("doc_id") % 3 == batch), path, f"batch {batch}")
    out = sinks.running_totals(spark, path).withColumn("total_confidence", F.col("avg_confidence") * F.col("decisions"))
    kept = ("total_duration_ms", "total_confidence", "error_rate")  # sums: an average may lie on a rounding edge
    return _round(out.drop("avg_duration_ms", "avg_confidence"), *kept, digits=4)


@query
def agent_report(spark, sf):
    return _round(
        report.agent_report(D.decisions(spark, sf)),
        "total_duration_ms", "avg_duration_ms", "error_rate", "avg_confidence", digits=4,
    )


@query
def decision_view(spark, sf):
    return report.decision_view(D.decisions(spark, sf), "doc_id")


@query
def audit_summary(spark, sf):
    rows = report.audit_summary(D.decisions(spark, sf))
    flat = rows.select("*", F.explode("decisions_by_agent").alias("agent_type", "decisions"))
    return _round(
        flat.drop("decisions_by_agent"),
        "total_duration_ms", "avg_duration_ms", "error_rate", digits=4,
    )


@query
def audit_log(spark, sf):
    rows = trace.log_decisions(D.decisions(spark, sf), limit=None)
    return rows.select("doc_id", "agent_type", "input_summary", "output_summary")


@query
def evaluation_period(spark, sf):
    rows = report.evaluation_period(
        D.decisions(spark, sf), "2024-01-02 00:00:00", "2024-01-05 12:00:00"
    )
    return rows.groupBy("agent_type").agg(
        F.count(F.lit(1)).alias("decisions"),
        F.min("timestamp").alias("first_at"),
        F.max("timestamp").alias("last_at"),
    )


# ---- files ------------------------------------------------------------------


@query
def ingested_files(spark, sf):
    docs = file_source.ingest(D.files(spark, sf))
    return docs.select(
        "file_path", "file_name", "file_type", "file_size_bytes", "ocr_applied", "source_hash",
        "route", "text", "load_error",
    )


@query
def quarantined_files(spark, sf):
    docs = file_source.quarantined(
        file_source.ingest(D.files(spark, sf).withColumn("max_mb", F.lit(1)))
    )
    return docs.groupBy("route", "load_error").agg(F.count(F.lit(1)).alias("files"))


@query
def scanned_files(spark, sf):
    """Pages written as files and scanned in two runs; the second opens only what the first has not seen."""
    base = sinks.scratch(spark, "scanned")
    for part in (0, 1):
        D.write_pages(D.table(spark, sf, "pages").where(F.col("page_id") % 2 == part), f"{base}/in/part{part}")
    runs = []
    for run, folder in enumerate((f"{base}/in/part0", f"{base}/in")):
        runs.append(ledger.ingest_new(spark, folder, f"{base}/ledger", f"run{run}").withColumn("run", F.lit(run).cast("bigint")))
    return runs[0].unionByName(runs[1]).select(
        F.regexp_extract("file_path", "page_id=([0-9]+)/", 1).cast("bigint").alias("page_id"),
        "run", "file_type", "file_size_bytes", "source_hash", F.sha2("text", 256).alias("text_hash"),
    )


@query
def new_pages(spark, sf):
    """Pages whose content a ledger of two thirds of them does not have."""
    pages = D.table(spark, sf, "pages").select("page_id", F.sha2("html", 256).alias("source_hash"))
    path = sinks.scratch(spark, "known")
    known = pages.where("page_id % 3 <> 0")
    commits.write_batch(known, path, "first")
    commits.write_batch(known, path, "first")
    return ledger.new_rows(pages, commits.read_table(spark, path), "source_hash", "page_id")


@query
def committed_decisions(spark, sf):
    """Decisions appended in three batches, one of them twice, one also by a job that died."""
    path = sinks.scratch(spark, "decisions")
    rows = D.decisions(spark, sf)
    for batch in (0, 1, 2, 1):
        part = rows.where(F.col("doc_id") % 3 == batch)
        if batch == 2:
            commits.write_attempt(part, path, ("session_id",))
        sinks.append_decisions(part, path, None, f"batch {batch}")
    found = commits.read_table(spark, path)
    return found.groupBy("session_id", "agent_type").agg(
        F.count(F.lit(1)).alias("decisions"), F.count_distinct("doc_id").alias("documents"),
        F.round(F.sum("duration_ms"), 4).alias("total_duration_ms"),
    )


@query
def committed_results(spark, sf):
    """Results written by type, retried, and read back with their metrics."""
    path = sinks.scratch(spark, "results")
    done = validate.validate(D.records(spark, sf)).select(
        "doc_id", "document_type", F.col("validation.is_valid").alias("success"), F.size("validation.errors").cast("bigint").alias("n_errors")
    )
    for _ in range(2):
        sinks.write_results(done, path, batch="all")
    found = commits.read_table(spark, path)
    report_ = found.groupBy("document_type").agg(F.count(F.lit(1)).alias("results"), F.count_if("success").alias("passed"), F.sum("n_errors").alias("errors"))
    sinks.write_metrics(report_, f"{path}/metrics")
    return sinks.read_metrics(spark, f"{path}/metrics", report_.schema)


# ---- streams ----------------------------------------------------------------


@query
def streamed_repairs(spark, sf):
    """``repair_rounds`` as a stream: records and replies meet in state."""
    base = sinks.scratch(spark, "repairs")
    kept = D.table(spark, sf, "orders")
    orders = D.spread(spark.readStream.schema(kept.schema).parquet(f"{sf}/orders*.parquet"), kept)
    at = F.lit("2024-01-01 00:00:00").cast("timestamp").alias("at")
    records = D.invoice_rows(orders).select("doc_id", "document_type", "structured_data", at)
    answers = D.repair_reply_rows(orders).select("*", at)
    done = _round_columns(repairs.repaired(records, answers, buckets=repairs.buckets_for(kept.count())))
    stream.start(done, f"repairs-{base[-8:]}", f"{base}/out", f"{base}/progress").awaitTermination()
    return spark.read.schema(done.schema).parquet(f"{base}/out")


# ---- the whole chain --------------------------------------------------------


def _processed(spark, sf, **more):
    docs = D.documents(spark, sf, "lang").withColumns(
        {
            "file_name": F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt")),
            "file_size_bytes": F.octet_length("text").cast("bigint"),
            **more,
        }
    )
    options = ProcessOptions(run_at="TIMESTAMP'2024-01-01 00:00:00'")
    return process(docs, D.answers(spark, sf), options)


@query
def processed_documents(spark, sf):
    done = _processed(spark, sf)
    return done.select(
        "doc_id", "success", "status", "document_type", "validation_passed", "had_errors",
        F.size("extracted_data").cast("bigint").alias("n_values"),
        F.size("validation.errors").cast("bigint").alias("n_errors"),
        F.col("validation.attempts").cast("bigint").alias("attempts"),
        F.aggregate(F.map_values("pii_summary"), F.lit(0), lambda a, n: a + n)
        .cast("bigint").alias("n_pii"),
        "processing_time_ms",
        "redacted_text",
    )


@query
def processed_api_view(spark, sf):
    rows = report.api_view(_processed(spark, sf), "doc_id")
    return rows.select(
        "doc_id", "success", "document_type",
        F.to_json("extracted_data").alias("extracted_data"),
        F.size("pii_summary").cast("bigint").alias("pii_types"),
        "validation_passed",
        F.array_join("errors", "; ").alias("errors"),
        "processing_time_ms",
    )


@query
def processed_metrics(spark, sf):
    inputs = settle(report.metric_inputs(_processed(spark, sf)))
    out = report.meets_thresholds(report.metrics(inputs))
    names = ("extraction_accuracy", "pii_recall", "pii_precision")
    return _round(
        out.drop(*names, *[f"meets_{n}" for n in names]),
        "workflow_success_rate", "validator_pass_rate", "avg_latency_ms",
    )


@query
def metrics_by_level(spark, sf):
    """Metrics per type and language, per type, and in total, in one pass."""
    done = _processed(spark, sf, file_type=F.col("lang")).withColumnRenamed("file_type", "lang")
    inputs = report.metric_inputs(done, ("document_type", "lang"))
    out = report.metrics_by_levels(inputs, (("document_type", "lang"), ("document_type",), ()))
    return _round(out, "workflow_success_rate", "validator_pass_rate", "avg_latency_ms")


@query
def threshold_checks(spark, sf):
    """All five limits, with accuracy, recall and precision from given truth."""
    fields = field_accuracy(spark, sf).agg(
        (F.sum("fields_correct") / F.sum("fields_total")).alias("extraction_accuracy")
    )
    spans = evaluate.score_spans(D.found_spans(spark, sf), D.true_spans(spark, sf))
    named = spans.select(
        F.col("recall").alias("pii_recall"), F.col("precision").alias("pii_precision")
    )
    scores = report.beside(fields, named, ("pii_recall", "pii_precision"))
    inputs = settle(report.metric_inputs(_processed(spark, sf)))
    out = report.meets_thresholds(report.metrics(inputs, scores=scores))
    names = ["extraction_accuracy", "pii_recall", "pii_precision"]
    return _round(out.select(*names, *[c for c in out.columns if c.startswith("meets_")]), *names)


def _files_processed(spark, sf):
    """Pages as files through the whole chain; some cannot be loaded."""
    files = D.files(spark, sf).withColumn("max_mb", F.lit(1))
    return process(file_source.ingest(files))


@query
def file_footer(spark, sf):
    return report.batch_footer(_files_processed(spark, sf))


@query
def file_metrics_by_type(spark, sf):
    """Metrics per type, with the failed loads as the group without one."""
    done = _files_processed(spark, sf).withColumn(
        "processing_time_ms", F.length("doc_id") * F.lit(0.5) + F.length("file_name") % 3
    )
    out = report.metrics(report.metric_inputs(done, ("document_type",)), ("document_type",))
    return _round(
        out.select(
            "document_type", "total_documents", "successful_documents", "failed_documents",
            "workflow_success_rate", "validator_pass_rate", "avg_latency_ms", "p50_latency_ms",
            "p95_latency_ms", "p99_latency_ms",
        ),
        "workflow_success_rate", "validator_pass_rate", "avg_latency_ms",
    )


@query
def processed_trace(spark, sf):
    rows = trace.decision_rows(_processed(spark, sf))
    return rows.select(
        "doc_id", *_long("seq"), "agent_type", "agent_name", "input_summary", "output_summary",
        F.round("confidence", 6).alias("confidence"), "reasoning", "duration_ms", "error_message",
    )


@query
def processed_audit(spark, sf):
    rows = trace.decision_rows(_processed(spark, sf), "audit")
    return rows.select(
        "doc_id", *_long("seq"), "agent_type", "input_summary", "output_summary",
        F.round("confidence", 6).alias("confidence"),
    )


@query
def processed_summary(spark, sf):
    return report.batch_summary(_processed(spark, sf), "doc_id")


@query
def processed_result_view(spark, sf):
    rows = report.result_view(_processed(spark, sf), first=None, width=None)
    return rows.withColumn("ord", F.col("ord").cast("bigint"))


@query
def classifier_accuracy(spark, sf):
    """Predicted types against labels that name every document an invoice or a memo."""
    done = _typed(spark, sf)
    truth = D.table(spark, sf, "labels").select(
        "doc_id",
        F.col("quality"),
        F.when(F.col("doc_id") % 2 == 0, "invoice").otherwise("receipt").alias("document_type"),
    )
    return _round(evaluate.score_types(done, truth, by=("quality",)), "classifier_accuracy")


def _typed(spark, sf):
    keys = D.table(spark, sf, "documents").select("doc_id")
    gathered = replies.gather(D.answers(spark, sf, "classify"))
    return replies.read_classification(replies.attach(keys, gathered))


@query
def field_accuracy(spark, sf):
    fields = _extracted(spark, sf).select("doc_id", F.inline_outer("fields")).where(
        "name IS NOT NULL"
    )
    truth = D.table(spark, sf, "documents").select(
        "doc_id",
        "lang",
        F.inline(
            F.array(
                F.struct(
                    F.lit("invoice_number").alias("name"),
                    F.concat(F.lit("INV-"), F.col("doc_id").cast("string")).alias("value"),
                ),
                F.struct(F.lit("date").alias("name"), F.lit("2024-03-01").alias("value")),
                F.struct(
                    F.lit("total_amount").alias("name"),
                    F.concat(F.col("n_chars").cast("string"), F.lit(".5")).alias("value"),
                ),
            )
        ),
    )
    return _round(evaluate.score_fields(fields, truth, by=("lang",)), "extraction_accuracy")
