"""Request tables for the model stages (I1-I4): (doc_id, stage, part, offset, request).

A request holds the whole text. Where a model takes less, ``limit`` gives a window in
characters: a document then has a request for each window, and the windows join up to its
text. Positions in a reply to a window count from its ``offset``. Windows for detection can
``overlap``: a value of at most ``overlap + 1`` characters then lies whole in one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions import prompts


def _requests(
    df: DataFrame, stage: str, request: str, text: str, limit: int | None, *extra: str,
    overlap: int = 0,
) -> DataFrame:
    pieces = df.select(
        "doc_id", *extra,
        F.inline_outer(F.expr(prompts.windows(f"coalesce({text}, '')", limit, overlap))),
    )
    return pieces.select(
        "doc_id", *extra, F.lit(stage).alias("stage"), "part", "offset",
        F.expr(request).alias("request"),
    )


def classification_requests(
    df: DataFrame, text: str = "text", limit: int | None = None
) -> DataFrame:
    return _requests(df, "classify", prompts.classify_request("piece"), text, limit)


def extraction_requests(df: DataFrame, text: str = "text", limit: int | None = None) -> DataFrame:
    request = prompts.extract_request("document_type", "piece")
    return _requests(df, "extract", request, text, limit, "document_type")


def detection_requests(
    df: DataFrame, text: str = "text", limit: int | None = None, overlap: int = 0
) -> DataFrame:
    """None for an empty text."""
    full = df.where(F.length(text) > 0)
    return _requests(full, "detect_pii", prompts.detect_request("piece"), text, limit, overlap=overlap)


def repair_requests(df: DataFrame, max_attempts: int, text: str = "text") -> DataFrame:
    """I4: one per invalid record with attempts left; columns as from ``validate``."""
    needed = (
        "structured_data IS NOT NULL AND size(validation.errors) > 0 "
        f"AND validation.attempts < {max_attempts}"
    )
    request = prompts.repair_request("structured_data", "validation.errors", text)
    # A generator instead of a filter: a filter would be pushed below the
    # validation and make Spark evaluate the rules twice.
    rows = df.selectExpr(
        "doc_id",
        f"CASE WHEN {needed} THEN named_struct('attempt', validation.attempts + 1, "
        f"'request', {request}) END AS _r",
    ).select("doc_id", F.inline(F.array_compact(F.array("_r"))))
    return rows.select("doc_id", "attempt", F.lit("repair").alias("stage"), "request")
