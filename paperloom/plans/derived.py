"""Tables the operators need, derived from the given ones by plain expressions.

The given tables hold no records, model replies or decisions. They are derived
row by row here, with defects set by key modulus, so their size follows the given
tables. The expressions are ordinary SQL (no backslashes in literals), so the
comparison queries can state the same inputs.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import date

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.prompts import windows
from paperloom.operators import redact, rulebook
from paperloom.sources.sinks import session_set

# ---- reading the given tables -----------------------------------------------


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Tasks for a table that is a single file, which one task would scan otherwise.
TASKS = 32


def spread(df: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """A table in one file is dealt to several tasks; one in more files is left as it is.

    A stream does not tell its files: ``kept`` is the table that it reads.
    """
    return df.repartition(TASKS) if len((df if kept is None else kept).inputFiles()) == 1 else df


def documents(spark: SparkSession, folder: str, *extra: str) -> DataFrame:
    return spread(table(spark, folder, "documents").select("doc_id", "text", *extra))


# ---- records ----------------------------------------------------------------

# Invoices from orders: NULL means the key is there without a value; the key is
# left out where *_here is false.
INVOICE_COLUMNS = {
    "doc_id": "'o-' || CAST(o_orderkey AS STRING)",
    "k": "o_orderkey",
    "no_data": "o_orderkey % 31 = 0",
    "invoice_number": "CASE WHEN o_orderkey % 19 = 0 THEN 'inv_' || CAST(o_orderkey AS STRING)"
    " ELSE 'INV-' || CAST(o_orderkey AS STRING) END",
    "date": "CASE WHEN o_orderkey % 11 = 0 THEN 'October 3'"
    " ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END",
    "total_amount": "CASE WHEN o_orderkey % 13 = 0 THEN '$1,234.50'"
    " WHEN o_orderkey % 17 = 0 THEN 'n/a' WHEN o_orderkey % 23 = 0 THEN NULL"
    " ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) END",
    "total_here": "o_orderkey % 37 <> 0",
    "vendor_name": "CASE WHEN o_orderkey % 7 = 0 THEN ''"
    " ELSE 'Customer#' || CAST(o_custkey AS STRING) END",
    "vendor_here": "o_orderkey % 29 <> 0",
}

# Receipts from lineitem.
RECEIPT_COLUMNS = {
    "doc_id": "'l-' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING)"
    " || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING)",
    "date": "CASE WHEN l_partkey % 11 = 0 THEN 'March 4'"
    " ELSE CAST(CAST(l_shipdate AS DATE) AS STRING) END",
    "total_amount": "CASE WHEN l_partkey % 17 = 0 THEN 'free'"
    " ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING) END",
    "subtotal": "CASE WHEN l_partkey % 13 = 0 THEN '12.5.0'"
    " ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING) END",
    "tax_amount": "CASE WHEN l_partkey % 19 = 0 THEN ''"
    " ELSE CAST(CAST(l_tax AS DECIMAL(18,2)) AS STRING) END",
    "merchant_name": "CASE WHEN l_suppkey % 7 = 0 THEN ''"
    " ELSE 'Supplier#' || CAST(l_suppkey AS STRING) END",
}


def columns_sql(columns: dict[str, str]) -> list[str]:
    return [f"{sql} AS {name}" for name, sql in columns.items()]


def invoices(spark: SparkSession, folder: str) -> DataFrame:
    return invoice_rows(spread(table(spark, folder, "orders")))


def invoice_rows(orders: DataFrame) -> DataFrame:
    """Invoices of a table or stream of orders."""
    rows = orders.selectExpr(*columns_sql(INVOICE_COLUMNS))
    entries = F.array_compact(
        F.array(
            F.struct(F.lit("invoice_number").alias("k"), F.col("invoice_number").alias("v")),
            F.struct(F.lit("date").alias("k"), F.col("date").alias("v")),
            F.when(
                F.col("total_here"),
                F.struct(F.lit("total_amount").alias("k"), F.col("total_amount").alias("v")),
            ),
            F.when(
                F.col("vendor_here"),
                F.struct(F.lit("vendor_name").alias("k"), F.col("vendor_name").alias("v")),
            ),
        )
    )
    return rows.select(
        "doc_id",
        "k",
        F.lit("invoice").alias("document_type"),
        F.when(~F.col("no_data"), F.map_from_entries(entries)).alias("structured_data"),
    )


def receipts(spark: SparkSession, folder: str) -> DataFrame:
    rows = spread(table(spark, folder, "lineitem")).selectExpr(*columns_sql(RECEIPT_COLUMNS))
    fields = [c for c in RECEIPT_COLUMNS if c != "doc_id"]
    pairs = [x for f in fields for x in (F.lit(f), F.col(f))]
    return rows.select(
        "doc_id",
        F.lit("receipt").alias("document_type"),
        F.create_map(*pairs).alias("structured_data"),
    )


def records(spark: SparkSession, folder: str) -> DataFrame:
    return invoices(spark, folder).drop("k").unionByName(receipts(spark, folder))


#: Day from which the second version of the invoice rules holds.
NEW_RULES_FROM = "2024-07-01"
NEW_INVOICE_RULES = (["invoice_number", "date", "total_amount"], [], {"invoice_number": "^INV-[0-9]*[05]$"})


def dated_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records with the day they are judged at: a day of 2024 for most invoices, else none."""
    issued = "CASE WHEN k % 41 <> 0 THEN date_add(DATE '2024-01-01', CAST(k % 366 AS INT)) END AS issued"
    dated = invoices(spark, folder).selectExpr("doc_id", "document_type", "structured_data", issued)
    return dated.unionByName(receipts(spark, folder).withColumn("issued", F.lit(None).cast("date")))


def rule_versions(spark: SparkSession) -> DataFrame:
    """The catalogue from the beginning, and other rules for invoices from a day on."""
    newer = rulebook.built_in(spark, {"invoice": NEW_INVOICE_RULES}, date.fromisoformat(NEW_RULES_FROM))
    return rulebook.built_in(spark).unionByName(newer)


REPAIR_REPLIES = [
    """CASE WHEN k % 2 = 0 THEN '{"corrected_fields": {"date": "2024-01-15"}}'"""
    """ ELSE '{"corrected_fields": {}}' END""",
    """CASE WHEN k % 5 = 0 THEN '{"corrected_fields": '"""
    """ ELSE '{"corrected_fields": {"vendor_name": "Acme", "total_amount": "100.00"}}' END""",
    """CASE WHEN k % 3 = 0 THEN '{"corrected_fields": {"invoice_number": "INV-1"}}'"""
    """ ELSE '{"repair_notes": "nothing"}' END""",
]


def repair_replies(spark: SparkSession, folder: str) -> DataFrame:
    return repair_reply_rows(table(spark, folder, "orders"))


def repair_reply_rows(orders: DataFrame) -> DataFrame:
    keys = orders.selectExpr(
        f"{INVOICE_COLUMNS['doc_id']} AS doc_id", "o_orderkey AS k"
    )
    slots = ", ".join(REPAIR_REPLIES)
    return keys.selectExpr("doc_id", f"posexplode(array({slots})) AS (pos, reply)").selectExpr(
        "doc_id", "'repair' AS stage", "pos + 1 AS attempt", "reply",
        "CAST(NULL AS STRING) AS error",
    )


# ---- model replies about the documents --------------------------------------

KIND = (
    "CASE doc_id % 14 WHEN 0 THEN 'invoice' WHEN 1 THEN 'receipt' WHEN 2 THEN 'contract'"
    " WHEN 3 THEN 'report' WHEN 4 THEN 'letter' WHEN 5 THEN 'form' WHEN 6 THEN 'resume'"
    " WHEN 7 THEN 'id_document' WHEN 8 THEN 'medical_record' WHEN 9 THEN 'financial_statement'"
    " WHEN 10 THEN 'research_paper' WHEN 11 THEN 'unknown' WHEN 12 THEN 'Invoice'"
    " ELSE 'memo' END"
)
_HUNDREDTHS = "'0.' || lpad(CAST(doc_id % 100 AS STRING), 2, '0')"
_QUOTE = "replace(replace(replace({0}, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"')," \
         " chr(10), chr(92) || 'n')"


def quoted(sql: str) -> str:
    """SQL that escapes a text for use inside a JSON string."""
    return _QUOTE.format(sql)


CLASSIFY_JSON = (
    """CASE WHEN doc_id % 17 = 0 THEN '{"document_type": "' || kind || '"}'"""
    """ ELSE '{"document_type": "' || kind || '", "confidence": ' || """ + _HUNDREDTHS +
    """ || ', "reasoning": "r' || CAST(doc_id AS STRING) || '"}' END"""
)

EXTRACT_JSON = (
    """'{"fields": [{"name": "invoice_number", "value": "INV-' || CAST(doc_id AS STRING)"""
    """ || '", "confidence": 0.9, "data_type": "string"}, {"name": "date", "value": "'"""
    """ || CASE WHEN doc_id % 4 = 0 THEN 'May 5' ELSE '2024-03-01' END || '", "confidence": '"""
    """ || CASE WHEN doc_id % 23 = 0 THEN '1.7' WHEN doc_id % 29 = 0 THEN '"high"' ELSE """
    + _HUNDREDTHS +
    """ END || '}, {"name": "total_amount", "value": ' || CAST(n_chars AS STRING)"""
    """ || '.50, "confidence": 0.75, "data_type": "number"}, {"value": "x"}, "junk"]'"""
    """ || CASE WHEN doc_id % 9 = 0 THEN ', "structured_data": {"invoice_number": "INV-1","""
    """ "date": 0, "total_amount": "12,5", "vendor_name": "V", "parties": ["a"]}'"""
    """ WHEN doc_id % 9 = 1 THEN '' ELSE ', "structured_data": {}' END || '}'"""
)

DETECT_JSON = (
    """'{"pii_entities": [{"type": "Full Name", "value": "' || """ + quoted("substr(text, 1, 6)") +
    """ || '", "start": 0, "confidence": 0.7}'"""
    """ || CASE WHEN instr(text, '@') > 0 THEN ', {"type": "email", "value": "' || """
    + quoted("substr(text, instr(text, '@'), 8)") +
    """ || '", "start": ' || CAST(instr(text, '@') - 1 AS STRING) || ', "end": '"""
    """ || CAST(instr(text, '@') + 7 AS STRING) || ', "confidence": '"""
    """ || CASE WHEN doc_id % 2 = 0 THEN '0.95' ELSE '0.85' END || '}' ELSE '' END"""
    """ || ', {"type": "social security number", "value": "1", "confidence": 5}'"""
    """ || CASE WHEN doc_id % 37 = 0 THEN ', {"type": "ssn", "value": "1", "start": 1,"""
    """ "confidence": 1.5}' ELSE '' END || ']}'"""
)


def wrapped(json: str) -> str:
    """SQL that hands ``json`` over the ways a service may: broken, fenced, enveloped."""
    inner = quoted(json)
    return (
        f"CASE WHEN doc_id % 13 = 0 THEN '{{\"document_type\": \"invoice\", '"
        f" WHEN doc_id % 11 = 0 THEN 'Here it is:' || chr(10) || '```json' || chr(10) || {json}"
        f" || chr(10) || '```' || chr(10) || 'Done.'"
        f" WHEN doc_id % 7 = 0 THEN '{{\"choices\": [{{\"message\": {{\"content\": \"' || {inner}"
        f" || '\"}}}}]}}'"
        f" WHEN doc_id % 5 = 0 THEN '{{\"outputs\": [{{\"text\": \"' || {inner} || '\"}}]}}'"
        f" WHEN doc_id % 3 = 0 THEN '{{\"content\": [{{\"text\": \"' || {inner} || '\"}}]}}'"
        f" WHEN doc_id % 23 = 0 THEN '{{\"content\": \"' || {inner} || '\"}}'"
        f" WHEN doc_id % 29 = 0 THEN '```' || {json} || '!'"
        f" ELSE {json} END"
    )


ANSWER_ERROR = "CASE WHEN doc_id % 19 = 0 THEN 'Request timed out' END"
# Durations are multiples of 1/4, so their sums are exact in any order.
ANSWER_MS = {"classify": "n_chars * 0.25D", "extract": "n_chars * 0.5D",
             "detect_pii": "n_chars * 0.125D * 2", "repair": "16.5D"}
DOC_REPAIR = """'{"corrected_fields": {"date": "2024-05-05", "vendor_name": "Acme"}}'"""


def answers(spark: SparkSession, folder: str, *stages: str) -> DataFrame:
    """Reply table for the documents; the text is read only where it is quoted."""
    docs = documents(spark, folder, "n_chars").withColumn("kind", F.expr(KIND))
    json = {
        "classify": wrapped(CLASSIFY_JSON),
        "extract": wrapped(EXTRACT_JSON),
        "detect_pii": wrapped(DETECT_JSON),
        "repair": DOC_REPAIR,
    }
    wanted = stages or tuple(json)
    slots = ", ".join(
        f"named_struct('stage', '{s}', 'attempt', 1, 'reply', {json[s]}, 'error', "
        f"{ANSWER_ERROR if s != 'repair' else 'CAST(NULL AS STRING)'}, "
        f"'duration_ms', CAST({ANSWER_MS[s]} AS DOUBLE))"
        for s in wanted
    )
    return docs.selectExpr("doc_id", f"inline(array({slots}))")


# One window's reply names the first @ in it.
# Replies whose objects repeat keys; the last one counts, and every member has to be JSON.
REPEATED_TYPE = "CASE doc_id % 3 WHEN 0 THEN 'invoice' WHEN 1 THEN 'receipt' ELSE 'contract' END"
REPEATED_JSON = (
    "CASE WHEN doc_id % 7 = 0 THEN '{\"document_type\": oops, \"document_type\": \"letter\", \"confidence\": 0.5}' ELSE "
    "'{\"document_type\": \"letter\", \"extra\": {\"a\": 1, \"a\": [{\"b\": 1, \"b\": \"{,\"}]}, \"confidence\": 0.25, "
    f"\"reasoning\": \"first\", \"document_type\": \"' || {REPEATED_TYPE} || '\", \"confidence\": 0.' || "
    "CAST(doc_id % 90 + 10 AS STRING) || ', \"reasoning\": \"of ' || CAST(doc_id AS STRING) || '\"}' END"
)


def repeated_key_answers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").selectExpr(
        "doc_id", "'classify' AS stage", "1 AS attempt", f"{REPEATED_JSON} AS reply", "CAST(NULL AS STRING) AS error"
    )


WINDOW_CHARS = 2000
#: Characters that detection requests repeat, more than any value looked for.
WINDOW_OVERLAP = 400
WINDOW_JSON = (
    """CASE WHEN instr(piece, '@') = 0 THEN '{"pii_entities": []}' ELSE """
    """'{"pii_entities": [{"type": "email", "value": "@", "start": ' || """
    """CAST(instr(piece, '@') - 1 AS STRING) || ', "end": ' || CAST(instr(piece, '@') AS STRING)"""
    """ || ', "confidence": 0.95}]}' END"""
)


def window_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Replies to the detection windows of the documents, an older attempt for each second one."""
    pieces = documents(spark, folder).where("length(text) > 0").selectExpr(
        "doc_id", f"inline({windows('text', WINDOW_CHARS)})"
    )
    stale = "named_struct('attempt', 1, 'reply', '{', 'error', CAST(NULL AS STRING))"
    fresh = f"named_struct('attempt', 2, 'reply', {WINDOW_JSON}, 'error', CAST(NULL AS STRING))"
    return pieces.selectExpr(
        "doc_id", "offset", f"inline(CASE WHEN part % 2 = 0 THEN array({fresh}) ELSE array({stale}, {fresh}) END)"
    )


# ---- conversations ----------------------------------------------------------

# Every kind of value that the patterns look for, said in one turn or another.
SAID = [
    " my ssn 123-45-6789",
    " it is 987 65 4321.",
    " 123456789 is my social security number",
    " DOB: 1/2/1990 ok",
    " Born March 5, 1988 in town",
    " passport AB1234567 here",
    " licence D123456 kept",
    " card 4111-1111-1111-1111 now",
    " call +1 555-123-4567 or 555-1234",
    " Date of Birth 03-04-85",
    " mail a.b@example.org from 10.0.0.1",
]
SAID_TEXT = (
    f"text || CASE (conv_id + turn) % {len(SAID) + 1} "
    + " ".join(f"WHEN {i} THEN '{said}'" for i, said in enumerate(SAID))
    + " ELSE '' END"
)


def turns(spark: SparkSession, folder: str) -> DataFrame:
    rows = spread(table(spark, folder, "conversations"))
    return rows.selectExpr("conv_id", "turn", f"{SAID_TEXT} AS text")


# ---- decisions --------------------------------------------------------------

DECISION_COLUMNS = {
    "doc_id": "event_id",
    "session_id": "CAST(CAST(ts AS DATE) AS STRING)",
    "agent_type": "CASE event_type WHEN 'view' THEN 'classifier' WHEN 'click' THEN 'extractor'"
    " WHEN 'signup' THEN 'validator' WHEN 'purchase' THEN 'redactor' ELSE 'reporter' END",
    "timestamp": "ts",
    "duration_ms": "value",
    "error_message": "CASE WHEN event_id % 7 = 0 THEN '' WHEN event_type = 'error'"
    " AND event_id % 3 = 0 THEN 'failed' END",
    "input_summary": "repeat(props, 60)",
    "output_summary": "event_type",
}


def decisions(spark: SparkSession, folder: str) -> DataFrame:
    k = "CAST(get_json_object(props, '$.k') AS DOUBLE)"
    return table(spark, folder, "events").selectExpr(
        *columns_sql(DECISION_COLUMNS),
        f"CASE WHEN event_id % 10 <> 0 THEN {k} / 100 END AS confidence",
    )


# On two of three days an agent is evaluated from six to twenty, on some of them without an end, and on some
# a second period starts at noon.
PERIOD_ROWS = (
    "SELECT agent_type, d + INTERVAL 6 HOUR AS start_at, CASE WHEN day(d) % 5 = 0 THEN NULL ELSE d + INTERVAL 20 HOUR END AS end_at, "
    "agent_type || '-' || CAST(CAST(d AS DATE) AS STRING) AS name FROM days WHERE day(d) % 3 <> 0 "
    "UNION ALL SELECT agent_type, d + INTERVAL 12 HOUR, d + INTERVAL 13 HOUR, agent_type || '-noon' FROM days WHERE day(d) % 4 = 1"
)


def periods(spark: SparkSession, folder: str) -> DataFrame:
    days = decisions(spark, folder).selectExpr("agent_type", "date_trunc('DAY', timestamp) AS d").distinct()
    return spark.sql(PERIOD_ROWS.replace("FROM days", "FROM {days}"), days=days)


# ---- files ------------------------------------------------------------------

# Pages as files: the suffix follows the key; some lines end as on other systems, some
# files are over 1 MB, and some plain ones end in a byte that is not UTF-8.
FILE_PATH = (
    "'/in/p' || CAST(page_id AS STRING) || CASE page_id % 8 WHEN 0 THEN '.txt' WHEN 1 THEN '.MD'"
    " WHEN 2 THEN '.csv' WHEN 3 THEN '.pdf' WHEN 4 THEN '.PNG' WHEN 5 THEN '.docx'"
    " WHEN 6 THEN '.json' ELSE '' END"
)
FILE_TEXT = (
    "CASE WHEN page_id % 50 = 10 THEN repeat(html, CAST(floor(1048576 / length(html)) AS INT) + 1)"
    " WHEN page_id % 5 = 1 THEN replace(html, chr(10), chr(13) || chr(10))"
    " WHEN page_id % 5 = 2 THEN replace(html, chr(10), chr(13)) ELSE html END"
)


def files(spark: SparkSession, folder: str) -> DataFrame:
    pages = spread(table(spark, folder, "pages")).selectExpr(
        f"{FILE_PATH} AS path", f"CAST({FILE_TEXT} AS BINARY) AS written",
        "page_id % 3 = 1 AND octet_length(html) = length(html) AS latin",
    )
    return pages.selectExpr(
        "path",
        "CAST(NULL AS TIMESTAMP) AS modificationTime",
        "CASE WHEN latin THEN concat(written, X'E9') ELSE written END AS content",
    ).withColumn("length", F.octet_length("content").cast("bigint"))


def write_pages(pages: DataFrame, folder: str) -> None:
    """Each page as a text file ``page_id=.../part-N.txt`` below ``folder``, the lines of rows of one id in one file.

    Spark's own writer starts up to three processes a file to set its mode on a local file system, so
    a shared folder that is mounted is written by the tasks themselves; any other by Spark.
    """
    if not folder.startswith(("file:", "/")):
        pages.select("page_id", F.col("html").alias("value")).write.partitionBy("page_id").text(folder)
        return
    root = "/" + folder.removeprefix("file:").lstrip("/")

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, TaskContext.get().partitionId()
        for frame in frames:
            for page, html in zip(frame.column("page_id").to_pylist(), frame.column("html").to_pylist()):
                place = f"{root}/page_id={page}"
                if page != last:
                    os.makedirs(place, exist_ok=True)
                with open(f"{place}/part-{n}.txt", "ab" if page == last else "wb") as out:  # a task that is done again writes anew
                    out.write((html or "").encode("utf-8", "surrogatepass") + b"\n")
                last = page
            yield pa.RecordBatch.from_arrays([pa.array([frame.num_rows], pa.int64())], ["rows"])

    os.makedirs(root, exist_ok=True)
    dealt = pages.select("page_id", "html").repartition(TASKS, "page_id").sortWithinPartitions("page_id")
    with session_set(pages.sparkSession, {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}):
        dealt.mapInArrow(batches, "rows long").agg(F.sum("rows")).collect()


# ---- ground truth -----------------------------------------------------------

# The first value of a document that these patterns find, whatever the detector finds.
TRUE_PATTERNS = {
    "email": "[a-z0-9.]+@[a-z0-9.]+[a-z]",
    "phone": "[(][0-9]{3}[)] [0-9]{3}-[0-9]{4}",
    "credit_card": "[0-9]{16}",
    "ip_address": "[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}",
    "ssn": "[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
# Every third document's labels lie elsewhere.
TRUE_SHIFT = "CASE WHEN doc_id % 3 = 0 THEN 100 ELSE 0 END"


def found_spans(spark: SparkSession, folder: str) -> DataFrame:
    return redact.span_rows(redact.detect(documents(spark, folder)), "pii_spans")


def true_spans(spark: SparkSession, folder: str) -> DataFrame:
    values = ", ".join(
        f"named_struct('pii_type', '{kind}', 'value', regexp_extract(text, '{pattern}', 0))"
        for kind, pattern in TRUE_PATTERNS.items()
    )
    return (
        documents(spark, folder)
        .selectExpr("doc_id", "text", f"inline(array({values}))")
        .where("value <> ''")
        .selectExpr("doc_id", "pii_type", "value", f"instr(text, value) - 1 + {TRUE_SHIFT} AS start_index")
        .selectExpr("doc_id", "pii_type", "start_index", "start_index + length(value) AS end_index")
    )
