"""Repair rounds over streams (V7, V8): records and replies meet in any order.

State holds one record and one answer for each allowed attempt until they are complete or a timer
runs out, for many documents in one group; the rules and the corrections run on what it gives, as in a batch.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from paperloom.functions.fixed_values import MAX_REPAIR_ATTEMPTS
from paperloom.operators import replies as R
from paperloom.operators import validate as V

_ANSWERS = "array<struct<attempt:int,reply:string,error:string,duration_ms:double>>"
_GATHERED = "doc_id string, status string, document_type string, data string, answers string, unused bigint"
_EVENT = ("doc_id", "ms", "is_record", "document_type", "data", "needs", "attempt", "reply", "error")
_STATE = "held string"
#: Groups that the documents are dealt to by a hash of their key; fixed for the life of a checkpoint.
BUCKETS = 1024
#: Documents that one call of Python should hold at a time.
BUCKET_DOCS = 4096


def buckets_for(docs: int) -> int:
    """Groups for about ``docs`` documents whose state is kept at a time, so that a call of Python stays small."""
    return max(BUCKETS, -(-docs // BUCKET_DOCS))


def _events(records: DataFrame, answers: DataFrame) -> DataFrame:
    """Records and replies as one stream; the rules run first, so only faulty records wait for replies."""
    checked = V.validate(records)
    told = checked.select(
        F.col("doc_id").cast("string"),
        "at",
        F.lit(True).alias("is_record"),
        "document_type",
        F.to_json("structured_data", {"ignoreNullFields": "false"}).alias("data"),
        (F.col("structured_data").isNotNull() & (F.size("validation.errors") > 0)).alias("needs"),
        F.lit(None).cast("int").alias("attempt"),
        F.lit(None).cast("string").alias("reply"),
        F.lit(None).cast("string").alias("error"),
    )
    said = answers.where("stage = 'repair'").select(
        F.col("doc_id").cast("string"),
        "at",
        F.lit(False).alias("is_record"),
        F.lit(None).cast("string").alias("document_type"),
        F.lit(None).cast("string").alias("data"),
        F.lit(False).alias("needs"),
        F.col("attempt").cast("int"),
        F.col("reply").cast("string"),
        F.col("error").cast("string"),
    )
    return told.unionByName(said)


def _order(answer: list) -> tuple:
    """Of two answers to one attempt the greater counts, NULL below all, as in a batch."""
    return tuple(x for value in answer for x in (value is not None, value or ""))


def _listed(frame: pd.DataFrame, column: str) -> list:
    """The values of a column, None for NULL."""
    return [None if x is None or x != x else x for x in frame[column].tolist()]


def _step(wait_ms: int, most: int):
    """State of a bucket: ``[doc_id, kind, data, here, needs, answers, done, unused, until]`` of each of its documents."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        docs = {held[0]: held[1:] for held in json.loads(state.get[0])} if state.exists else {}
        now, touched, out = state.getCurrentWatermarkMs(), {}, []

        def give(doc_id: str | None, status: str) -> None:
            kind, data, _, _, got, _, unused, _ = docs[doc_id]
            listed = [dict(zip(("attempt", "reply", "error"), (k, *got[str(k)]))) if str(k) in got else None for k in range(1, most + 1)]
            out.append((doc_id, status, kind, data, json.dumps(listed), unused))

        for frame in () if state.hasTimedOut else frames:
            for doc_id, ms, is_record, kind, data, needs, attempt, reply, error in zip(*(_listed(frame, c) for c in _EVENT)):
                held = docs.setdefault(doc_id, [None, None, False, False, {}, False, 0, 0])
                touched[doc_id] = max(touched.get(doc_id, now), ms)
                if is_record:
                    if not held[2] or not held[5] and (kind or "", data or "") > (held[0] or "", held[1] or ""):
                        held[:4] = kind, data, True, bool(needs)
                elif held[5] or attempt is None or not 1 <= attempt <= most:
                    held[6] += 1
                else:
                    slot, answer, got = str(int(attempt)), [reply, error], held[4]
                    held[6] += slot in got
                    got[slot] = max(got.get(slot, answer), answer, key=_order)
        for doc_id, latest in touched.items():
            held = docs[doc_id]
            held[7] = int(latest) + wait_ms
            if held[2] and not held[5] and (not held[3] or len(held[4]) == most):
                held[6] += 0 if held[3] else len(held[4])
                give(doc_id, "complete")
                held[5] = True
        for doc_id in [k for k, held in docs.items() if held[7] < now and k not in touched]:
            if not docs[doc_id][5]:
                give(doc_id, "expired" if docs[doc_id][2] else "orphan")
            elif docs[doc_id][6]:
                give(doc_id, "late")
            del docs[doc_id]
        if docs:
            state.update((json.dumps([[k, *held] for k, held in docs.items()]),))
            state.setTimeoutTimestamp(max(now, min(held[7] for held in docs.values())))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["doc_id", "status", "document_type", "data", "answers", "unused"])

    return step


def gathered(records: DataFrame, answers: DataFrame, wait_ms: int = 3_600_000, delay: str = "10 minutes", most: int = MAX_REPAIR_ATTEMPTS, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, status, document_type, structured_data, repairs, unused) of two streams.

    ``records(doc_id, document_type, structured_data, at)`` and ``answers(doc_id, stage, attempt, reply, error,
    at)`` come in any order. A record without errors, or without data, is given at once as ``complete``;
    one with errors when all ``most`` attempts have been answered. ``wait_ms`` of event time after the last
    news of a document it is given up as ``expired`` with the answers there are, or, where only
    answers came, as ``orphan``. The state then goes. Until then it tells replies that come after the
    record was given, or to one that needs none, or that another answer to their attempt outranks, or with
    an attempt out of bounds: they are counted as ``unused``, in a row with status ``late`` at the end. Events more than
    ``delay`` behind the latest are dropped by the watermark. Rows with NULL doc_id share one state.

    Documents are dealt to ``buckets`` groups, so a call of Python serves many of them; it holds those of a bucket
    at a time, so more documents need more buckets (``buckets_for``). A bucket that gets news is
    written again as a whole; ``buckets`` must stay the same for the life of a checkpoint.
    """
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int").alias("bucket")
    events = _events(records, answers).withWatermark("at", delay)
    events = events.select("*", bucket, F.coalesce(F.unix_millis("at"), F.lit(0)).alias("ms"))
    out = events.groupBy("bucket").applyInPandasWithState(_step(wait_ms, most), _GATHERED, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(
        "doc_id",
        "status",
        "document_type",
        F.from_json("data", "map<string,string>").alias("structured_data"),
        F.from_json("answers", _ANSWERS).alias("repairs"),
        "unused",
    )


def repaired(records: DataFrame, answers: DataFrame, **options) -> DataFrame:
    """``gathered`` with the verdict after repair, as ``operators.validate`` gives it in a batch."""
    return V.validate(gathered(records, answers, **options), R.corrections())
