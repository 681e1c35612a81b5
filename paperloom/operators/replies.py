"""Bringing model replies to their documents and reading them.

Replies are a table ``(doc_id, stage, attempt, reply, error[, duration_ms])``;
stages are ``classify``, ``extract``, ``repair`` and ``detect_pii``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import replies as R
from paperloom.functions.basics import empty, let, lit
from paperloom.functions.fixed_values import MAX_REPAIR_ATTEMPTS
from paperloom.functions.rules import FIX

_ANSWER = "struct<attempt:int,reply:string,error:string,duration_ms:double>"


def gather(replies: DataFrame, max_repairs: int = MAX_REPAIR_ATTEMPTS) -> DataFrame:
    """One row per document: columns ``classify``, ``extract``, ``detect_pii`` and
    ``repairs`` (an array with one slot per attempt).

    A stage answered more than once keeps its last attempt. Everything is a
    ``max`` of a struct, so copies of a hot document collapse before the shuffle
    and no group is ever collected; the pivot costs one shuffle for all stages
    and all repair rounds.
    """
    if "duration_ms" not in replies.columns:
        replies = replies.withColumn("duration_ms", F.lit(None).cast("double"))
    answer = F.struct(
        F.col("attempt").cast("int").alias("attempt"),
        F.col("reply").cast("string").alias("reply"),
        F.col("error").cast("string").alias("error"),
        F.col("duration_ms").cast("double").alias("duration_ms"),
    )

    def last(where: Column) -> Column:
        return F.max(F.when(where, answer))

    stage = F.col("stage")
    repair = [
        last((stage == "repair") & (F.col("attempt") == k)).alias(f"_repair_{k}")
        for k in range(1, max_repairs + 1)
    ]
    grouped = replies.groupBy("doc_id").agg(
        last(stage == "classify").alias("classify"),
        last(stage == "extract").alias("extract"),
        last(stage == "detect_pii").alias("detect_pii"),
        *repair,
    )
    slots = [F.col(f"_repair_{k}") for k in range(1, max_repairs + 1)]
    return grouped.select(
        "doc_id",
        "classify",
        "extract",
        "detect_pii",
        (F.array(*slots) if slots else F.expr(empty(_ANSWER))).alias("repairs"),
    )


def attach(docs: DataFrame, gathered: DataFrame) -> DataFrame:
    """Left join on ``doc_id``; documents without replies stay."""
    return docs.join(gathered, "doc_id", "left")


def payloads(replies: DataFrame) -> DataFrame:
    """The payload text of each reply and whether it is a JSON object."""
    texts = replies.withColumn("payload", F.expr(R.payload("reply")))
    whole = f"{R.parsed('payload')} IS NOT NULL"
    return texts.withColumn("is_json", F.expr(f"{whole} OR {R.single_keys('payload')} IS NOT NULL"))


def _parse(df: DataFrame, answer: str) -> DataFrame:
    """Columns ``_p`` (payload text) and ``_v`` (VARIANT); NULL after an error."""
    text = f"CASE WHEN {answer}.error IS NULL THEN {answer}.reply END"
    read = df.withColumn("_p", F.expr(R.payload(text))).withColumn("_v", F.expr(R.parsed("_p")))
    # Only what does not parse may have an object that repeats a key.
    read = read.withColumn("_s", F.expr(f"CASE WHEN _v IS NULL THEN {R.single_keys('_p')} END"))
    return read.withColumns(
        {
            "_p": F.expr("coalesce(_s, _p)"),
            "_v": F.expr(f"CASE WHEN _s IS NULL THEN _v ELSE {R.parsed('_s')} END"),
        }
    ).drop("_s")


def _why(answer: str, prefix: str, usable: str) -> Column:
    return F.expr(
        f"CASE WHEN NOT ({usable}) THEN concat({lit(prefix + ' failed: ')}, "
        f"CASE WHEN {answer} IS NULL THEN 'no reply' "
        f"WHEN {answer}.error IS NOT NULL THEN {answer}.error "
        f"WHEN _v IS NULL THEN 'Invalid JSON in response' ELSE 'unusable reply' END) END"
    )


def read_classification(df: DataFrame, answer: str = "classify") -> DataFrame:
    """Adds document_type, classification_confidence, reasoning, classify_error."""
    read = _parse(df, answer).withColumn("_c", F.expr(R.classification("_v")))
    return read.withColumns(
        {
            "document_type": F.expr("coalesce(_c.document_type, 'unknown')"),
            "classification_confidence": F.expr("coalesce(_c.confidence, 0D)"),
            "reasoning": F.col("_c.reasoning"),
            "classify_error": _why(answer, "Classification", "_c IS NOT NULL"),
        }
    ).drop("_p", "_v", "_c")


def read_extraction(df: DataFrame, answer: str = "extract") -> DataFrame:
    """Adds fields, structured_data, untruthy, avg_confidence, extract_error.

    One bad item fails the whole reply: no fields, empty data, an error text.
    """
    read = (
        _parse(df, answer)
        .withColumn("_f", F.expr(R.extracted_fields("_v")))
        .withColumn("_s", F.expr(R.structured_data("_v", "_p", "_f")))
    )
    ok = "_v IS NOT NULL AND _f IS NOT NULL AND _s IS NOT NULL"

    def if_ok(value: str, otherwise: str) -> Column:
        return F.expr(f"CASE WHEN {ok} THEN {value} ELSE {otherwise} END")

    return (
        read.withColumns(
            {
                "fields": if_ok("_f", empty(R.FIELD)),
                "structured_data": if_ok("_s.data", "CAST(map() AS map<string,string>)"),
                "untruthy": if_ok("_s.untruthy", empty("string")),
                "extract_error": _why(answer, "Extraction", ok),
            }
        )
        .withColumn("avg_confidence", F.expr(R.average_confidence("fields")))
        .drop("_p", "_v", "_f", "_s")
    )


def read_detection(df: DataFrame, answer: str = "detect_pii") -> DataFrame:
    """Adds ``model_spans``; empty after any error."""
    return (
        _parse(df, answer)
        .withColumn("model_spans", F.expr(R.model_spans("_v")))
        .drop("_p", "_v")
    )


def window_detections(replies: DataFrame) -> DataFrame:
    """I9 over windows: ``(doc_id, model_spans)`` from replies ``(doc_id, offset, attempt,
    reply, error)``, one or more per request window. The last attempt of a window counts, and
    its positions are moved by the window's ``offset``, so they are those of the whole text.
    A span of one type and place that overlapping windows report counts once, the surest one.
    """
    answer = F.max(F.struct(F.col("attempt").cast("int").alias("attempt"), "reply", "error"))
    read = read_detection(replies.groupBy("doc_id", "offset").agg(answer.alias("detect_pii")))
    moved = F.transform(
        "model_spans",
        lambda s: s.withField("start_index", s["start_index"] + F.col("offset"))
        .withField("end_index", s["end_index"] + F.col("offset")),
    )
    spans = read.select("doc_id", "offset", F.posexplode_outer(moved).alias("pos", "span"))
    once = spans.groupBy("doc_id", "span.pii_type", "span.start_index", "span.end_index").agg(
        F.min(F.struct("offset", "pos")).alias("place"),
        F.max_by("span", F.coalesce("span.confidence", F.lit(-1.0))).alias("span"),
    )
    found = F.when(F.col("span").isNotNull(), F.struct("place", "span"))
    parts = F.sort_array(F.collect_list(found))
    return once.groupBy("doc_id").agg(parts["span"].alias("model_spans"))


def corrections(answers: str = "repairs") -> str:
    """Expression for the corrections of each attempt, NULL where it failed."""
    text = f"CASE WHEN an.error IS NULL THEN {R.payload('an.reply')} END"
    value = f"CASE WHEN once IS NULL THEN whole ELSE {R.parsed('once')} END"
    read = let("pt", "coalesce(once, raw)", let("pv", value, R.corrections("pv", "pt")))
    once = let("once", f"CASE WHEN whole IS NULL THEN {R.single_keys('raw')} END", read)
    read = let("raw", text, let("whole", R.parsed("raw"), once))
    slots = f"coalesce({answers}, {empty(_ANSWER)})"
    return f"CAST(transform({slots}, an -> {read}) AS array<{FIX}>)"


def read_repairs(df: DataFrame, answers: str = "repairs") -> DataFrame:
    """Adds ``fixes`` for every row, needed or not."""
    return df.withColumn("fixes", F.expr(corrections(answers)))
