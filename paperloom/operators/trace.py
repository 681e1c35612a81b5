"""Decision records of the five stages, built inside each row."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.basics import empty, fixed_point, lit, struct
from paperloom.functions.fixed_values import AGENTS, SUMMARY_CHARS

DECISION = (
    "struct<agent_type:string,agent_name:string,timestamp:timestamp,input_summary:string,"
    "output_summary:string,confidence:double,reasoning:string,duration_ms:double,"
    "model_used:string,tokens_used:int,retry_count:int,error_message:string>"
)


def decision(
    agent: str,
    run_at: str,
    model: str | None,
    said: str,
    did: str,
    confidence: str = "NULL",
    reasoning: str = "NULL",
    duration: str = "NULL",
    error: str = "NULL",
) -> str:
    made = struct(
        agent_type=lit(agent),
        agent_name=lit(AGENTS[agent]),
        timestamp=run_at,
        input_summary=said,
        output_summary=did,
        confidence=confidence,
        reasoning=reasoning,
        duration_ms=f"coalesce({duration}, 0D)",
        model_used=lit(model) if model else "NULL",
        tokens_used="NULL",
        retry_count="0",
        error_message=error,
    )
    return f"CAST({made} AS {DECISION})"


def _text(template: str, **parts: str) -> str:
    """SQL for a message with ``{holes}``."""
    pieces = re.split(r"\{(\w+)\}", template)
    sql = [lit(p) if i % 2 == 0 else f"CAST({parts[p]} AS STRING)" for i, p in enumerate(pieces)]
    return "concat(" + ", ".join(sql) + ")"


def _yes_no(flag: str) -> str:
    return f"CASE WHEN {flag} THEN 'True' ELSE 'False' END"


def add_trace(
    df: DataFrame,
    run_at: str = "current_timestamp()",
    model: str | None = None,
    names: int | None = None,
    summary_chars: int | None = None,
) -> DataFrame:
    """Add ``agent_trace`` and ``audit`` to rows that carry every stage's columns.

    The audit copy is shorter: no failed stages, no reporter. ``names`` bounds the field names
    that the extractor's reasoning lists, ``summary_chars`` the summaries of the audit copy; without
    them both are whole.
    """
    listed = "fields" if names is None else f"slice(fields, 1, {int(names)})"
    text = "coalesce(text, '')"
    seen = f"length({text})"
    parts = {
        "file": "coalesce(file_name, 'unknown')",
        "seen": seen,
        "read": seen,
        "size": f"length({text})",
        "kind": "document_type",
        "sure": fixed_point("classification_confidence", 2),
        "n_fields": "size(fields)",
        "mean": fixed_point("avg_confidence", 2),
        "names": f"array_join(transform({listed}, f -> concat('\\'', f.name, '\\'')), ', ')",
        "n_pii": "total_pii_found",
        "by_type": "array_join(transform(map_entries(pii_by_type), "
                   "e -> concat('\\'', e.key, '\\': ', CAST(e.value AS STRING))), ', ')",
        "open": "'{'",
        "close": "'}'",
        "n_found": "pattern_spans_found",
        "n_model": "model_spans_found",
        "before": "size(validation.visits) + 3",
        "done": _yes_no("success"),
        "v_fields": "v.n_fields",
        "v_valid": _yes_no("v.is_valid"),
        "v_errors": "v.n_errors",
        "v_attempts": "v.attempts",
    }

    def say(template: str) -> str:
        return _text(template, **parts)

    def made(agent: str, said: str, did: str, **facts: str) -> str:
        return decision(agent, run_at, model, say(said), say(did), **facts)

    def logged(agent: str, said: str, did: str, **facts: str) -> str:
        cut = "{}" if summary_chars is None else f"substring({{}}, 1, {int(summary_chars)})"
        return decision(
            agent, run_at, model, cut.format(say(said)), cut.format(say(did)), **facts
        )

    classify = {"duration": "classify.duration_ms"}
    extract = {"duration": "extract.duration_ms"}
    detect = {"duration": "detect_pii.duration_ms"}
    visit = {
        "confidence": "CASE WHEN v.is_valid THEN 1D ELSE 0.5D END",
        "duration": "CASE WHEN v.attempts > 0 THEN "
                    "try_element_at(repairs, greatest(v.attempts, 1)).duration_ms END",
    }
    classified = made(
        "classifier", "Document: {file} ({seen} chars)",
        "Classified as {kind} with {sure} confidence",
        confidence="classification_confidence", reasoning="reasoning", **classify,
    )
    not_classified = made(
        "classifier", "Document: {file}", "Classification failed",
        error="classify_error", **classify,
    )
    extracted = made(
        "extractor", "Document type: {kind}, Content: {read} chars",
        "Extracted {n_fields} fields with avg confidence {mean}",
        confidence="avg_confidence", reasoning=say("Extracted fields: [{names}]"), **extract,
    )
    not_extracted = made(
        "extractor", "Document type: {kind}", "Extraction failed",
        error="extract_error", **extract,
    )
    validated = made(
        "validator", "Validating {v_fields} fields for {kind}",
        "Valid: {v_valid}, Errors: {v_errors}, Warnings: 0",
        reasoning=say("Repair attempts: {v_attempts}"), **visit,
    )
    redacted = made(
        "redactor", "Text with {size} characters",
        "Found {n_pii} PII entities: {open}{by_type}{close}",
        confidence="CASE WHEN total_pii_found > 0 THEN 0.95D ELSE 1D END",
        reasoning=say("Regex found: {n_found}, LLM found: {n_model}"), **detect,
    )
    reported = made(
        "reporter", "Processing state with {before} agent decisions",
        "Report generated, success={done}", confidence="1D",
    )
    agent_trace = (
        f"concat(array(CASE WHEN classify_error IS NULL THEN {classified} "
        f"ELSE {not_classified} END, CASE WHEN extract_error IS NULL THEN {extracted} "
        f"ELSE {not_extracted} END), transform(validation.visits, v -> {validated}), "
        f"array({redacted}, {reported}))"
    )
    log_classified = logged(
        "classifier", "Document content ({seen} chars)", "Type: {kind}, Confidence: {sure}",
        confidence="classification_confidence", reasoning="reasoning", **classify,
    )
    log_extracted = logged(
        "extractor", "Document type: {kind}", "Extracted {n_fields} fields",
        confidence="avg_confidence", **extract,
    )
    log_validated = logged("validator", "Document type: {kind}", "Valid: {v_valid}", **visit)
    log_redacted = logged(
        "redactor", "Document with {size} chars", "Redacted {n_pii} PII entities",
        confidence="0.95D", **detect,
    )
    nothing = empty(DECISION)
    audit = (
        f"concat(CASE WHEN classify_error IS NULL THEN array({log_classified}) "
        f"ELSE {nothing} END, CASE WHEN extract_error IS NULL THEN array({log_extracted}) "
        f"ELSE {nothing} END, transform(validation.visits, v -> {log_validated}), "
        f"array({log_redacted}))"
    )
    return df.withColumns({"agent_trace": F.expr(agent_trace), "audit": F.expr(audit)})


def stage_time() -> str:
    """Sum of the durations in ``agent_trace``, without having to build it."""
    stages = " + ".join(
        f"coalesce({s}.duration_ms, 0D)" for s in ("classify", "extract", "detect_pii")
    )
    repairs = (
        "aggregate(slice(repairs, 1, validation.attempts), 0D, "
        "(acc, r) -> acc + coalesce(r.duration_ms, 0D))"
    )
    return f"{stages} + coalesce({repairs}, 0D)"


def decision_rows(df: DataFrame, trace: str = "agent_trace") -> DataFrame:
    """M14 the other way round: one row per decision, in order within its document."""
    rows = df.select("doc_id", F.posexplode_outer(trace).alias("seq", "d")).where("seq IS NOT NULL")
    return rows.select("doc_id", "seq", "d.*")


def log_decisions(decisions: DataFrame, limit: int | None = SUMMARY_CHARS) -> DataFrame:
    """The audit copy of a decision table, its summaries cut where a limit is given."""
    if limit is None:
        return decisions
    return decisions.withColumns(
        {
            c: F.substring(F.col(c), 1, limit)
            for c in ("input_summary", "output_summary")
        }
    )
