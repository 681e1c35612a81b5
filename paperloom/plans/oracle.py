"""The same results in plain SQL, stated independently of the operators.

Only the derived inputs (``plans.derived``), the fixed values and our own request
wording are shared with the Spark side; the logic is written anew. Folds are
recursive queries here.
"""

from __future__ import annotations

import re

from paperloom.functions import prompts
from paperloom.functions.fixed_values import (
    DOCUMENT_RULES,
    DOCUMENT_TYPES,
    EXTRACTION_FIELDS,
    PII_ALIASES,
    PII_MASKS,
    PII_PATTERNS,
)
from paperloom.plans import derived as D

ORACLE: dict[str, str] = {}


def text(value: str) -> str:
    """A DuckDB string literal."""
    parts = value.split("\n")
    quoted = " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in parts)
    return f"({quoted})" if len(parts) > 1 else quoted


def cases(key: str, table: dict[str, str]) -> str:
    whens = " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in table.items())
    return f"CASE {key} {whens} END"


def columns(table: dict[str, str]) -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in table.items())


# ---- spans ------------------------------------------------------------------


def _pattern_sql(i: int, entry: tuple, table: str, keys: str) -> str:
    kind, pattern, group = entry
    ahead = "(?=.*(?:ssn|social|security))"
    bare = pattern.replace(ahead, "")
    start = (
        "CAST(coalesce(list_sum(list_transform(g[1:k], lambda x: length(x))), 0)"
        " + coalesce(list_sum(list_transform(m[1:k-1], lambda x: length(x))), 0) AS BIGINT)"
    )
    rows = (
        f"SELECT {keys}, {i} AS pat, '{kind}' AS pii_type, {text(PII_MASKS[kind])} AS mask, k, "
        f"m[k] AS whole, v[k] AS value, {start} AS s, text FROM (SELECT {keys}, text, "
        f"regexp_extract_all(text, {text(bare)}, 0, 'i') AS m, "
        f"regexp_extract_all(text, {text(bare)}, {group}, 'i') AS v, "
        f"regexp_split_to_array(text, {text(bare)}, 'i') AS g FROM {table} "
        f"WHERE regexp_matches(text, {text(bare)}, 'i')), unnest(range(1, len(m) + 1)) AS t(k)"
    )
    if bare != pattern:
        # No lookahead here: look at the rest of the match's line instead.
        rows = (
            f"SELECT * FROM ({rows}) WHERE regexp_matches(split_part(substr(text, s + 10), "
            "chr(10), 1), 'ssn|social|security', 'i')"
        )
    return rows


def spans_cte(table: str = "documents", keys: str = "doc_id") -> str:
    every = " UNION ALL ".join(_pattern_sql(i, p, table, keys) for i, p in enumerate(PII_PATTERNS))
    return (
        f"spans AS (SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY pat, k) - 1 "
        "AS ord, pii_type, mask, value, s, s + length(whole) AS e, CAST(0.9 AS DOUBLE) AS conf "
        f"FROM ({every}))"
    )


def fold_cte(source: str) -> str:
    """``folded(doc_id, text, step, kept, ...)``: one row per masking step."""
    return (
        "steps AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, ord) AS step "
        f"FROM {source}), "
        "folded AS (SELECT doc_id, text, CAST(0 AS BIGINT) AS step, false AS kept, "
        "CAST(NULL AS VARCHAR) AS pii_type, CAST(NULL AS BIGINT) AS s, CAST(NULL AS BIGINT) AS e, "
        "CAST(NULL AS DOUBLE) AS conf FROM documents UNION ALL "
        "SELECT f.doc_id, CASE WHEN instr(f.text, o.value) > 0 THEN "
        "substr(f.text, 1, instr(f.text, o.value) - 1) || o.mask || "
        "substr(f.text, instr(f.text, o.value) + length(o.value)) "
        "WHEN o.s < length(f.text) THEN substr(f.text, 1, o.s) || o.mask || "
        "substr(f.text, o.e + 1) ELSE f.text END, o.step, "
        "instr(f.text, o.value) > 0 OR o.s < length(f.text), o.pii_type, o.s, o.e, o.conf "
        "FROM folded f JOIN steps o ON o.doc_id = f.doc_id AND o.step = f.step + 1), "
        "masked AS (SELECT doc_id, arg_max(text, step) AS redacted_text, "
        "CAST(count(*) FILTER (kept) AS BIGINT) AS total_pii_found FROM folded GROUP BY doc_id)"
    )


FOUND = "WITH RECURSIVE " + spans_cte() + ", " + fold_cte("spans")

ORACLE["pii_spans"] = (
    f"WITH {spans_cte()} SELECT doc_id, CAST(ord AS BIGINT) AS ord, CAST(s AS BIGINT) AS "
    "start_index, CAST(e AS BIGINT) AS end_index, pii_type, value AS original_value, "
    "mask AS masked_value, conf AS confidence FROM spans"
)
ORACLE["pii_spans_in_conversations"] = (
    f"WITH said AS (SELECT conv_id, turn, {D.SAID_TEXT} AS text FROM conversations), "
    f"{spans_cte('said', 'conv_id, turn')} SELECT conv_id, turn, CAST(ord AS BIGINT)"
    " AS ord, CAST(s AS BIGINT) AS start_index, CAST(e AS BIGINT) AS end_index, pii_type, "
    "value AS original_value FROM spans"
)
ORACLE["pii_context"] = (
    f"WITH {spans_cte()} SELECT doc_id, CAST(ord AS BIGINT) AS ord, pii_type, "
    "substr(text, CASE WHEN s > 20 THEN s - 20 ELSE 0 END + 1, "
    "e + 20 - CASE WHEN s > 20 THEN s - 20 ELSE 0 END) AS context "
    "FROM spans JOIN documents USING (doc_id)"
)
ORACLE["pii_redacted_text"] = FOUND + " SELECT doc_id, redacted_text, total_pii_found FROM masked"
ORACLE["pii_counts"] = (
    FOUND + " SELECT doc_id, pii_type, count(*) AS n FROM folded WHERE kept GROUP BY 1, 2"
)
ORACLE["pii_corpus_profile"] = (
    FOUND + " SELECT pii_type, count(*) AS entities, count(DISTINCT doc_id) AS documents "
    "FROM folded WHERE kept GROUP BY 1"
)
ORACLE["pii_counts_by_language"] = (
    FOUND + " SELECT lang, pii_type, count(*) AS entities, count(DISTINCT doc_id) AS documents "
    "FROM folded JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) WHERE kept GROUP BY 1, 2"
)
ORACLE["pii_redacted_text_clean"] = (
    "WITH RECURSIVE " + spans_cte() + ", tried AS (SELECT *, row_number() OVER (PARTITION BY doc_id"
    " ORDER BY s, e DESC, ord) AS step FROM spans), "
    "walk AS (SELECT doc_id, CAST(0 AS BIGINT) AS step, CAST(0 AS BIGINT) AS upto, false AS kept, "
    "CAST(NULL AS BIGINT) AS s, CAST(NULL AS BIGINT) AS e, CAST(NULL AS VARCHAR) AS mask "
    "FROM documents UNION ALL SELECT w.doc_id, t.step, "
    "CASE WHEN t.s >= w.upto THEN t.e ELSE w.upto END, t.s >= w.upto, t.s, t.e, t.mask "
    "FROM walk w JOIN tried t ON t.doc_id = w.doc_id AND t.step = w.step + 1), "
    "kept AS (SELECT doc_id, s, e, mask, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS b "
    "FROM walk WHERE kept), "
    "done AS (SELECT k.doc_id, string_agg(substr(d.text, b + 1, s - b) || mask, '' ORDER BY s) "
    "|| substr(any_value(d.text), max(e) + 1) AS t, count(*) AS n "
    "FROM kept k JOIN documents d USING (doc_id) GROUP BY 1) "
    "SELECT doc_id, coalesce(t, text) AS redacted_text, coalesce(n, 0) AS total_pii_found "
    "FROM documents LEFT JOIN done USING (doc_id)"
)

# ---- replies ----------------------------------------------------------------


def answers_cte() -> str:
    """``docs`` with one reply column per stage."""
    return (
        f"kinds AS (SELECT *, {D.KIND} AS kind FROM documents), "
        f"docs AS (SELECT *, {D.wrapped(D.CLASSIFY_JSON)} AS classify, "
        f"{D.wrapped(D.EXTRACT_JSON)} AS extract, {D.wrapped(D.DETECT_JSON)} AS detect_pii, "
        f"{D.ANSWER_ERROR} AS error FROM kinds)"
    )


def payload_sql(source: str, reply: str, keep: str) -> str:
    """Subquery: ``keep`` columns and ``p``, the payload of ``reply``."""
    env = (
        f"CASE WHEN json_valid({reply}) THEN coalesce("
        f"json_extract_string({reply}, '$.outputs[0].text'), "
        f"json_extract_string({reply}, '$.choices[0].message.content'), "
        f"json_extract_string({reply}, '$.content[0].text'), "
        f"CASE WHEN json_type({reply}, '$.content') = 'VARCHAR' "
        f"THEN json_extract_string({reply}, '$.content') END, {reply}) ELSE {reply} END"
    )
    at = (
        "CASE WHEN instr(t, '```json') > 0 THEN instr(t, '```json') + 7 "
        "ELSE instr(t, '```') + 3 END"
    )
    body = (
        "CASE WHEN instr(substr(t, o), '```') > 0 THEN substr(t, o, instr(substr(t, o), '```') - 1)"
        " ELSE substr(t, o, length(t) - o) END"
    )
    return (
        f"(SELECT {keep}, CASE WHEN instr(t, '```') = 0 THEN t ELSE "
        rf"regexp_replace({body}, '^\s+|\s+$', '', 'g') END AS p FROM "
        f"(SELECT *, {at} AS o FROM (SELECT *, {env} AS t FROM {source})))"
    )


def object_sql(source: str, reply: str, keep: str = "doc_id, error") -> str:
    """As ``payload_sql``, plus ``j``: the payload when it is a JSON object without error."""
    return (
        f"(SELECT *, CASE WHEN error IS NULL AND json_valid(p) AND json_type(p) = 'OBJECT' "
        f"THEN CAST(p AS JSON) END AS j FROM {payload_sql(source, reply, keep)})"
    )


def failure(prefix: str, usable: str) -> str:
    return (
        f"CASE WHEN NOT ({usable}) THEN '{prefix} failed: ' || CASE WHEN error IS NOT NULL THEN "
        "error WHEN j IS NULL THEN 'Invalid JSON in response' ELSE 'unusable reply' END END"
    )


KNOWN = ", ".join(text(t) for t in DOCUMENT_TYPES)

ORACLE["reply_payloads"] = (
    f"WITH {answers_cte()}, p AS (SELECT *, 'classify' AS stage FROM "
    f"{payload_sql('docs', 'classify', 'doc_id')} UNION ALL SELECT *, 'detect_pii' AS stage FROM "
    f"{payload_sql('docs', 'detect_pii', 'doc_id')}) SELECT doc_id, stage, p AS payload, "
    "json_valid(p) AND coalesce(CASE WHEN json_valid(p) THEN json_type(p) END, '') = 'OBJECT' "
    "AS is_json FROM p"
)

TYPED = (
    "typed AS (SELECT doc_id, CASE WHEN j IS NULL THEN 'unknown' WHEN lower(name) IN "
    f"({KNOWN}) THEN lower(name) ELSE 'unknown' END AS document_type, "
    "CASE WHEN j IS NULL THEN 0 ELSE coalesce(CAST(json_extract_string(j, '$.confidence') AS "
    "DOUBLE), 0.5) END AS classification_confidence, CASE WHEN j IS NOT NULL THEN "
    "coalesce(json_extract_string(j, '$.reasoning'), 'No reasoning provided') END AS reasoning, "
    + failure("Classification", "j IS NOT NULL") + " AS classify_error FROM (SELECT *, "
    "coalesce(json_extract_string(j, '$.document_type'), 'unknown') AS name FROM "
    + object_sql("docs", "classify") + "))"
)

ORACLE["classification_replies"] = (
    f"WITH {answers_cte()}, {TYPED} SELECT doc_id, document_type, CAST(classification_confidence "
    "AS DOUBLE) AS classification_confidence, reasoning, classify_error FROM typed"
)

# Items of the extraction reply; a reply with one bad confidence is dropped whole.
FIELDS = (
    "ex AS (SELECT * FROM " + object_sql("docs", "extract") + "), "
    "items AS (SELECT doc_id, i, json_extract(j, '$.fields[' || i || ']') AS x FROM ex, "
    "unnest(range(0, CAST(coalesce(json_array_length(j, '$.fields'), 0) AS BIGINT))) AS t(i) WHERE j IS NOT NULL), "
    "raw_fields AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS ord, "
    "coalesce(json_extract_string(x, '$.name'), 'unknown') AS name, "
    "CASE json_type(x, '$.value') WHEN 'DOUBLE' THEN CAST(CAST(json_extract_string(x, '$.value') "
    "AS DOUBLE) AS VARCHAR) ELSE coalesce(json_extract_string(x, '$.value'), '') END AS value, "
    "CASE WHEN json_extract_string(x, '$.confidence') IS NULL THEN 0.5 ELSE "
    "TRY_CAST(json_extract_string(x, '$.confidence') AS DOUBLE) END AS confidence, "
    "coalesce(json_extract_string(x, '$.data_type'), 'string') AS data_type "
    "FROM items WHERE json_type(x) = 'OBJECT'), "
    "bad AS (SELECT DISTINCT doc_id FROM raw_fields WHERE confidence IS NULL OR confidence < 0 "
    "OR confidence > 1), "
    "fields AS (SELECT * FROM raw_fields WHERE doc_id NOT IN (SELECT doc_id FROM bad)), "
    "good AS (SELECT * FROM ex WHERE j IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM bad)), "
    # structured data: own keys when there are any, else the fields
    "own AS (SELECT doc_id, key AS name, pos, json_extract(j, '$.structured_data.' || key) AS v "
    "FROM (SELECT doc_id, j, unnest(json_keys(j, '$.structured_data')) AS key, "
    "unnest(range(0, 20)) AS pos FROM good WHERE json_type(j, '$.structured_data') = 'OBJECT') "
    "WHERE key IS NOT NULL), "
    "vals AS (SELECT doc_id, name, pos, CASE json_type(v) WHEN 'VARCHAR' THEN json_extract_string(v, "
    "'$') ELSE CAST(v AS VARCHAR) END AS value, json_type(v) NOT IN ('VARCHAR', 'ARRAY') AND "
    "CAST(v AS VARCHAR) = '0' AS falsy FROM own UNION ALL "
    "SELECT doc_id, name, min(ord), arg_max(value, ord), false FROM fields WHERE doc_id NOT IN "
    "(SELECT doc_id FROM own) GROUP BY doc_id, name)"
)

ORACLE["extracted_fields"] = (
    f"WITH {answers_cte()}, {FIELDS} SELECT doc_id, CAST(ord AS BIGINT) AS ord, name, value, "
    "CAST(confidence AS DOUBLE) AS confidence, data_type FROM fields"
)
ORACLE["extracted_values"] = (
    f"WITH {answers_cte()}, {FIELDS} SELECT doc_id, name, value FROM vals"
)
ORACLE["extraction_replies"] = (
    f"WITH {answers_cte()}, {FIELDS} SELECT e.doc_id, coalesce(f.n, 0) AS n_fields, "
    "coalesce(v.n, 0) AS n_values, coalesce(v.falsy, '') AS untruthy, "
    "coalesce(round(f.mean, 6), 0) AS avg_confidence, extract_error FROM "
    "(SELECT doc_id, " + failure(
        "Extraction", "j IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM bad)")
    + " AS extract_error FROM ex) e "
    "LEFT JOIN (SELECT doc_id, count(*) AS n, CAST(avg(confidence) AS DOUBLE) AS mean FROM fields "
    "GROUP BY 1) f USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n, "
    "string_agg(name, ',') FILTER (falsy) AS falsy FROM vals GROUP BY 1) v USING (doc_id)"
)

MODEL = (
    "detected AS (SELECT * FROM " + object_sql("docs", "detect_pii") + "), "
    "listed AS (SELECT doc_id, i, json_extract(j, '$.pii_entities[' || i || ']') AS x FROM "
    "detected, unnest(range(0, CAST(coalesce(json_array_length(j, '$.pii_entities'), 0) AS BIGINT))) AS t(i) "
    "WHERE j IS NOT NULL), "
    "named AS (SELECT doc_id, i, " + cases(
        "replace(lower(json_extract_string(x, '$.type')), ' ', '_')", PII_ALIASES)
    + " AS pii_type, json_extract_string(x, '$.value') AS value, "
    "coalesce(CAST(json_extract_string(x, '$.start') AS BIGINT), 0) AS s, "
    "CAST(json_extract_string(x, '$.end') AS BIGINT) AS stop, "
    "CAST(json_extract_string(x, '$.confidence') AS DOUBLE) AS conf FROM listed), "
    "sure AS (SELECT *, coalesce(stop, s + length(value)) AS e, " + cases("pii_type", PII_MASKS)
    + " AS mask FROM named WHERE pii_type IS NOT NULL), "
    "model AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS step FROM sure "
    "WHERE doc_id NOT IN (SELECT doc_id FROM sure WHERE conf > 1 OR conf < 0))"
)
ORACLE["pii_model_spans"] = (
    f"WITH {answers_cte()}, {MODEL} SELECT doc_id, CAST(step - 1 AS BIGINT) AS ord, "
    "CAST(s AS BIGINT) AS start_index, CAST(e AS BIGINT) AS end_index, pii_type, "
    "value AS original_value, mask AS masked_value, conf AS confidence FROM model"
)

_ITEM = "{'pii_type': pii_type, 'value': value, 'mask': mask, 's': s, 'e': e, 'conf': conf}"
MERGED = (
    spans_cte() + ", " + MODEL + ", "
    f"first AS (SELECT doc_id, list({_ITEM} ORDER BY ord) AS l FROM spans GROUP BY 1), "
    f"news AS (SELECT doc_id, step, {_ITEM} AS new FROM model), "
    "grow AS (SELECT doc_id, CAST(0 AS BIGINT) AS step, coalesce(l, []) AS l FROM documents "
    "LEFT JOIN first USING (doc_id) UNION ALL SELECT doc_id, step, CASE WHEN hit = 0 THEN "
    "list_append(l, new) WHEN l[hit].conf < new.conf THEN list_append(list_concat(l[1:hit-1], "
    "l[hit+1:len(l)]), new) ELSE l END FROM (SELECT g.doc_id, n.step, g.l, n.new, "
    "coalesce(list_position(list_transform(g.l, lambda a: NOT (a.e <= n.new.s OR n.new.e <= a.s)), "
    "true), 0) AS hit FROM grow g JOIN news n ON n.doc_id = g.doc_id AND n.step = g.step + 1)), "
    "final AS (SELECT doc_id, arg_max(l, step) AS l FROM grow GROUP BY 1), "
    "merged AS (SELECT doc_id, CAST(i AS BIGINT) AS ord, l[i].pii_type AS pii_type, "
    "l[i].value AS value, l[i].mask AS mask, l[i].s AS s, l[i].e AS e, l[i].conf AS conf "
    "FROM final, unnest(range(1, len(l) + 1)) AS t(i)), " + fold_cte("merged")
)
ORACLE["pii_merged_redaction"] = (
    f"WITH RECURSIVE {answers_cte()}, {MERGED} SELECT doc_id, redacted_text, total_pii_found, "
    "coalesce(a.n, 0) AS pattern_spans_found, coalesce(b.n, 0) AS model_spans_found FROM masked "
    "LEFT JOIN (SELECT doc_id, count(*) AS n FROM spans GROUP BY 1) a USING (doc_id) "
    "LEFT JOIN (SELECT doc_id, count(*) AS n FROM model GROUP BY 1) b USING (doc_id)"
)
ORACLE["pii_merged_spans"] = (
    f"WITH RECURSIVE {answers_cte()}, {MERGED} SELECT doc_id, CAST(row_number() OVER "
    "(PARTITION BY doc_id ORDER BY step DESC) - 1 AS BIGINT) AS ord, CAST(s AS BIGINT) AS "
    "start_index, CAST(e AS BIGINT) AS end_index, pii_type, conf AS confidence FROM folded "
    "WHERE kept"
)

# ---- evaluation -------------------------------------------------------------

_TRUE = " UNION ALL ".join(
    f"SELECT doc_id, '{kind}' AS pii_type, text, regexp_extract(text, {text(pattern)}, 0) AS value "
    "FROM documents"
    for kind, pattern in D.TRUE_PATTERNS.items()
)
TRUTH = (
    spans_cte() + ", found AS (SELECT * FROM spans), "
    f"first_values AS (SELECT *, instr(text, value) - 1 + {D.TRUE_SHIFT} AS s FROM ({_TRUE}) "
    "WHERE value <> ''), "
    "truth AS (SELECT doc_id, pii_type, s, s + length(value) AS e FROM first_values), "
    "hits AS (SELECT *, EXISTS (SELECT 1 FROM truth t WHERE t.doc_id = f.doc_id AND t.pii_type = "
    "f.pii_type AND t.s < f.e AND f.s < t.e) AS hit FROM found f), "
    "misses AS (SELECT *, EXISTS (SELECT 1 FROM found f WHERE t.doc_id = f.doc_id AND t.pii_type = "
    "f.pii_type AND t.s < f.e AND f.s < t.e) AS hit FROM truth t)"
)
ORACLE["pii_span_overlaps"] = (
    f"WITH {TRUTH} SELECT doc_id, pii_type, CAST(s AS BIGINT) AS start_index, CAST(e AS BIGINT) "
    "AS end_index, count(*) AS n, bool_or(hit) AS overlapped FROM hits GROUP BY 1, 2, 3, 4"
)
ORACLE["pii_detection_scores"] = (
    f"WITH {TRUTH}, c AS (SELECT pii_type, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM "
    "(SELECT pii_type, CAST(hit AS INT) AS tp, CAST(NOT hit AS INT) AS fp, 0 AS fn FROM hits UNION "
    "ALL SELECT pii_type, 0, 0, CAST(NOT hit AS INT) FROM misses) GROUP BY 1), "
    "r AS (SELECT *, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END AS p, "
    "CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END AS r FROM c) "
    "SELECT pii_type, CAST(tp AS BIGINT) AS true_positives, CAST(fp AS BIGINT) AS false_positives, "
    "CAST(fn AS BIGINT) AS false_negatives, CAST(tp + fp AS BIGINT) AS total_detected, "
    "round(CAST(p AS DOUBLE), 6) AS precision, round(CAST(r AS DOUBLE), 6) AS recall, "
    "round(CAST(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS DOUBLE), 6) AS f1_score "
    "FROM r"
)

# ---- requests ---------------------------------------------------------------


def _facts(request: str, source: str, extra: str = "") -> str:
    return (
        f"SELECT doc_id, {extra}length(r) AS n_chars, sha256(r) AS request_hash FROM "
        f"(SELECT *, {request} AS r FROM {source})"
    )


ORACLE["classification_requests"] = _facts(
    f"{text(prompts.CLASSIFY_HEAD)} || coalesce(text, '')", "documents"
)
_HEADS = " ".join(
    f"WHEN '{t}' THEN {text(prompts.extract_head(t))}" for t in EXTRACTION_FIELDS
)
ORACLE["extraction_requests"] = _facts(
    f"CASE document_type {_HEADS} ELSE {text(prompts.OPEN_EXTRACT_HEAD)} END || "
    "coalesce(text, '')",
    f"(SELECT *, lower({D.KIND}) AS document_type FROM documents)",
    "document_type, ",
)
_STEP = 8000 - D.WINDOW_OVERLAP
ORACLE["detection_requests"] = _facts(
    f"{text(prompts.DETECT_HEAD)} || substr(text, CAST(part * {_STEP} + 1 AS BIGINT), 8000)",
    f"(SELECT doc_id, text, unnest(range(greatest(1, CAST(ceil((length(text) - {D.WINDOW_OVERLAP}) / {_STEP}.0) "
    "AS BIGINT)))) AS part FROM documents WHERE length(text) > 0)",
    f"CAST(part AS INT) AS part, CAST(part * {_STEP} AS INT) AS \"offset\", ",
)

# ---- records ----------------------------------------------------------------


def _missing(c: str) -> str:
    return f"coalesce({c}, '') = ''"


def _mismatch(c: str, pattern: str, skip: str = "false") -> str:
    return f"(coalesce({c}, '') <> '' AND NOT {skip} AND NOT regexp_matches({c}, {text(pattern)}))"


def _not_numeric(c: str, applies: str) -> str:
    plain = f"replace(replace(coalesce({c}, 'None'), ',', ''), '$', '')"
    return f"({applies} AND TRY_CAST({plain} AS DOUBLE) IS NULL)"


def _error_rows(kind: str, source: str, here: dict[str, str], rule: tuple | None = None) -> list[str]:
    """One SELECT per rule of a type; values are columns of ``source``."""
    required, _, patterns = rule or DOCUMENT_RULES[kind]
    rows = []

    def add(condition, field, error, message, expected="NULL", actual="NULL"):
        rows.append(
            f"SELECT rid, doc_id, '{kind}' AS document_type, {len(rows)} AS rule, '{field}' AS "
            f"field_name, '{error}' AS error_type, {message} AS error_message, CAST({expected} AS "
            f"VARCHAR) AS expected_value, CAST({actual} AS VARCHAR) AS actual_value, 'error' AS "
            f"severity FROM {source} WHERE {condition}"
        )

    for f in required:
        add(_missing(f), f, "missing_required", text(f"Required field '{f}' is missing or empty"))
    for f, p in patterns.items():
        add(
            _mismatch(f, p), f, "pattern_mismatch",
            text(f"Field '{f}' value '") + f" || {f} || "
            + text("' does not match expected pattern"),
            text(p), f,
        )
    numeric = ["total_amount"] if kind == "invoice" else ["total_amount", "subtotal", "tax_amount"]
    for f in numeric:
        applies = here.get(f, f"coalesce({f}, '') <> ''")
        add(_not_numeric(f, applies), f, "invalid_type", f"'{f} must be numeric'", "NULL", f)
    return rows


RECORDS = (
    f"inv0 AS (SELECT {columns(D.INVOICE_COLUMNS)} FROM orders), "
    "inv AS (SELECT row_number() OVER () AS rid, doc_id, k, no_data, invoice_number, date, "
    "CASE WHEN total_here THEN total_amount END AS total_amount, total_here, "
    "CASE WHEN vendor_here THEN vendor_name END AS vendor_name, vendor_here FROM inv0), "
    f"rec AS (SELECT -row_number() OVER () AS rid, {columns(D.RECEIPT_COLUMNS)} FROM lineitem), "
    "full_inv AS (SELECT * FROM inv WHERE NOT no_data), "
    "errors AS (SELECT rid, doc_id, 'invoice' AS document_type, 0 AS rule, 'extracted_data' AS "
    "field_name, 'missing_data' AS error_type, 'No extracted data to validate' AS error_message, "
    "CAST(NULL AS VARCHAR) AS expected_value, CAST(NULL AS VARCHAR) AS actual_value, 'error' AS "
    "severity FROM inv WHERE no_data UNION ALL "
    + " UNION ALL ".join(_error_rows("invoice", "full_inv", {"total_amount": "total_here"}))
    + " UNION ALL "
    + " UNION ALL ".join(_error_rows("receipt", "rec", {}))
    + ")"
)
ORACLE["record_errors"] = (
    f"WITH {RECORDS} SELECT doc_id, document_type, row_number() OVER (PARTITION BY rid ORDER BY "
    "rule) - 1 AS ord, field_name, error_type, error_message, expected_value, actual_value, "
    "severity FROM errors"
)
_LATE = f"DATE '2024-01-01' + CAST(k % 366 AS INTEGER) >= DATE '{D.NEW_RULES_FROM}'"
ORACLE["repeated_key_replies"] = (
    f"SELECT doc_id, CASE WHEN bad THEN 'unknown' ELSE {D.REPEATED_TYPE} END AS document_type, CASE WHEN bad THEN "
    "CAST(0 AS DOUBLE) ELSE CAST('0.' || CAST(doc_id % 90 + 10 AS VARCHAR) AS DOUBLE) END AS classification_confidence, "
    "CASE WHEN NOT bad THEN 'of ' || CAST(doc_id AS VARCHAR) END AS reasoning, CASE WHEN bad THEN 'Classification "
    "failed: Invalid JSON in response' END AS classify_error FROM (SELECT doc_id, doc_id % 7 = 0 AS bad FROM documents)"
)
ORACLE["versioned_record_errors"] = (
    f"WITH {RECORDS}, late AS (SELECT * FROM inv WHERE k % 41 = 0 OR {_LATE}), "
    "full_late AS (SELECT * FROM late WHERE NOT no_data), newer AS ("
    + " UNION ALL ".join(_error_rows("invoice", "full_late", {"total_amount": "total_here"}, D.NEW_INVOICE_RULES))
    + "), judged AS (SELECT *, CAST(NULL AS VARCHAR) AS rules_from FROM errors WHERE doc_id NOT IN "
    f"(SELECT doc_id FROM late) UNION ALL SELECT *, '{D.NEW_RULES_FROM}' FROM errors WHERE error_type = "
    "'missing_data' AND doc_id IN (SELECT doc_id FROM late) UNION ALL SELECT *, "
    f"'{D.NEW_RULES_FROM}' FROM newer) "
    "SELECT doc_id, document_type, rules_from, row_number() OVER (PARTITION BY rid, doc_id ORDER BY rule) - 1 AS ord, "
    "field_name, error_type, error_message, expected_value, actual_value, severity FROM judged"
)
ORACLE["record_error_report"] = (
    f"WITH {RECORDS} SELECT document_type, field_name, error_type, count(*) AS n FROM errors "
    "GROUP BY 1, 2, 3"
)
ORACLE["record_verdicts"] = (
    f"WITH {RECORDS} SELECT doc_id, document_type, n IS NULL AS is_valid, coalesce(n, 0) AS "
    "n_errors FROM (SELECT rid, doc_id, 'invoice' AS document_type FROM inv UNION ALL "
    "SELECT rid, doc_id, 'receipt' FROM rec) LEFT JOIN (SELECT rid, count(*) AS n FROM errors "
    "GROUP BY 1) USING (rid)"
)
_LINES = (
    "string_agg('- ' || field_name || ': ' || error_message || CASE WHEN expected_value IS NULL "
    "THEN '' ELSE ' (expected: ' || expected_value || ')' END, chr(10) ORDER BY rule)"
)
ORACLE["repair_request_errors"] = (
    f"WITH {RECORDS} SELECT doc_id, coalesce(l, '') AS error_lines FROM inv LEFT JOIN "
    f"(SELECT rid, {_LINES} AS l FROM errors GROUP BY 1) USING (rid)"
)
_QUOTED = "'\"' || {0} || '\":\"' || {1} || '\"'"
_JSON_MAP = (
    "'{' || concat_ws(',', " + ", ".join(
        [
            _QUOTED.format("'invoice_number'", "invoice_number"),
            _QUOTED.format("'date'", "date"),
            "CASE WHEN total_here THEN CASE WHEN total_amount IS NULL THEN '\"total_amount\":null'"
            " ELSE " + _QUOTED.format("'total_amount'", "total_amount") + " END END",
            "CASE WHEN vendor_here THEN " + _QUOTED.format("'vendor_name'", "vendor_name")
            + " END",
        ]
    ) + ") || '}'"
)
ORACLE["repair_requests"] = (
    f"WITH {RECORDS}, need AS (SELECT doc_id, {text(prompts.REPAIR_HEAD)} || chr(10) || 'Values:' "
    f"|| chr(10) || {_JSON_MAP} || chr(10) || 'Errors:' || chr(10) || l || chr(10) || 'Document:' "
    f"|| chr(10) || coalesce(d.text, '') AS r FROM full_inv i JOIN (SELECT rid, {_LINES} AS l FROM errors GROUP BY 1) "
    "USING (rid) LEFT JOIN (SELECT doc_id AS place, text FROM documents) d ON d.place = i.k) SELECT doc_id, CAST(1 AS BIGINT) AS attempt, length(r) AS n_chars, sha256(r) AS "
    "request_hash FROM need"
)


def _invoice_errors(c: dict[str, str]) -> str:
    """Number of errors of an invoice whose values are the given expressions."""
    tests = [_missing(c[f]) for f in DOCUMENT_RULES["invoice"][0]]
    tests += [_mismatch(c[f], p) for f, p in DOCUMENT_RULES["invoice"][2].items()]
    tests.append(_not_numeric(c["total_amount"], c["total_here"]))
    return "(" + " + ".join(f"CAST({t} AS INT)" for t in tests) + ")"


_COLS = {f: f for f in ("invoice_number", "date", "total_amount", "vendor_name", "total_here")}
_USED = ["n0 > 0 AND k % 2 = 0", "n1 > 0 AND k % 5 <> 0", "n2 > 0 AND k % 3 = 0"]
_NEW = [
    {"date": "'2024-01-15'"},
    {"vendor_name": "'Acme'", "total_amount": "'100.00'", "total_here": "true"},
    {"invoice_number": "'INV-1'"},
]


def _rounds() -> str:
    ctes = [f"r0 AS (SELECT *, {_invoice_errors(_COLS)} AS n0 FROM full_inv)"]
    for i, (used, new) in enumerate(zip(_USED, _NEW, strict=True)):
        fixed = ", ".join(f"CASE WHEN {used} THEN {v} ELSE {c} END AS {c}" for c, v in new.items())
        ctes.append(f"s{i} AS (SELECT * REPLACE ({fixed}) FROM r{i})")
        ctes.append(f"r{i + 1} AS (SELECT *, {_invoice_errors(_COLS)} AS n{i + 1} FROM s{i})")
    tried = "CASE WHEN n0 = 0 THEN 0 WHEN n1 = 0 THEN 1 WHEN n2 = 0 THEN 2 ELSE 3 END"
    ctes.append(
        f"done AS (SELECT doc_id, k, n3 = 0 AS is_valid, CAST({tried} AS BIGINT) AS attempts, "
        "CAST(n3 AS BIGINT) AS n_errors, date, vendor_name FROM r3 UNION ALL SELECT doc_id, k, "
        "false, 0, 1, NULL, NULL FROM inv WHERE no_data)"
    )
    return ", ".join(ctes)


REPAIRED = f"{RECORDS}, {_rounds()}"
ORACLE["repair_rounds"] = (
    f"WITH {REPAIRED} SELECT doc_id, is_valid, attempts, attempts > 0 AS repair_attempted, "
    "attempts > 0 AND is_valid AS repair_successful, n_errors, CAST(CASE WHEN date IS NULL THEN 0 "
    "WHEN attempts = 0 THEN 1 ELSE attempts END AS BIGINT) AS n_visits, date, vendor_name FROM done"
)
ORACLE["repair_success"] = (
    f"WITH {REPAIRED}, c AS (SELECT k % 4 AS o_mod, count(*) AS records, count(*) FILTER "
    "(attempts > 0) AS repair_attempted, count(*) FILTER (attempts > 0 AND is_valid) AS "
    "repair_successful FROM done GROUP BY 1) SELECT *, round(CASE WHEN repair_attempted > 0 THEN "
    "CAST(repair_successful AS DOUBLE) / repair_attempted ELSE 0 END, 6) AS repair_success_rate "
    "FROM c"
)
ORACLE["repair_replies"] = (
    "WITH r AS (SELECT o_orderkey AS k, 'o-' || CAST(o_orderkey AS VARCHAR) AS doc_id, "
    f"unnest([{', '.join(D.REPAIR_REPLIES)}]) AS reply, unnest([1, 2, 3]) AS attempt FROM "
    "(SELECT o_orderkey, o_orderkey AS k FROM orders)) SELECT doc_id, CAST(attempt AS BIGINT) AS "
    "attempt, json_valid(reply) AS usable, CASE WHEN json_valid(reply) THEN "
    "coalesce(CAST(json_extract(reply, '$.corrected_fields') AS VARCHAR), '{}') END AS corrected "
    "FROM r"
)
_BRIEF = [
    (i, t, *[
        (", ".join(f[:3]) + ("..." if len(f) > 3 else "")) or "-"
        for f in DOCUMENT_RULES.get(t, ([], []))[:2]
    ])
    for i, t in enumerate(DOCUMENT_TYPES)
]
ORACLE["catalogue_types"] = (
    "SELECT CAST(ord AS BIGINT) AS ord, t.document_type, required_fields, optional_fields, "
    "CASE t.document_type WHEN 'invoice' THEN (SELECT count(*) FROM orders) WHEN 'receipt' THEN "
    "(SELECT count(*) FROM lineitem) ELSE 0 END AS records FROM (VALUES "
    + ", ".join(f"({i}, '{t}', '{r}', '{o}')" for i, t, r, o in _BRIEF)
    + ") t(ord, document_type, required_fields, optional_fields)"
)
_FIELD_ROWS = [
    (t, kind, i, f)
    for t, rule in DOCUMENT_RULES.items()
    for kind, fields in (("required", rule[0]), ("optional", rule[1]))
    for i, f in enumerate(fields)
]
_FILLED = " UNION ALL ".join(
    [
        f"SELECT 'invoice' AS document_type, '{f}' AS field, count(*) FILTER ({f} <> '') AS n FROM "
        "full_inv" for f in ("invoice_number", "date", "total_amount", "vendor_name")
    ]
    + [
        f"SELECT 'receipt', '{f}', count(*) FILTER ({f} <> '') FROM rec"
        for f in ("date", "total_amount", "subtotal", "tax_amount", "merchant_name")
    ]
)
ORACLE["catalogue_fields"] = (
    f"WITH {RECORDS}, filled AS ({_FILLED}) SELECT document_type, kind, CAST(ord AS BIGINT) AS ord,"
    " field, coalesce(n, 0) AS filled FROM (VALUES "
    + ", ".join(f"('{t}', '{k}', {i}, '{f}')" for t, k, i, f in _FIELD_ROWS)
    + ") c(document_type, kind, ord, field) LEFT JOIN filled USING (document_type, field)"
)

# ---- decisions --------------------------------------------------------------

DECISIONS = (
    f"decisions AS (SELECT {columns(D.DECISION_COLUMNS)}, CASE WHEN event_id % 10 <> 0 THEN "
    "CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 END AS confidence FROM events)"
)


def _points(source: str, value: str) -> str:
    sorted_ = f"list({value} ORDER BY {value})"
    return ", ".join(
        f"{sorted_}[{index} + 1] AS {name}"
        for name, index in (
            ("p50", "count(*) // 2"),
            ("p95", "CAST(floor(count(*) * CAST(0.95 AS DOUBLE)) AS BIGINT)"),
            ("p99", "CAST(floor(count(*) * CAST(0.99 AS DOUBLE)) AS BIGINT)"),
        )
    )


ORACLE["latency_percentiles"] = (
    f"WITH {DECISIONS} SELECT agent_type, {_points('decisions', 'duration_ms')} FROM decisions "
    "GROUP BY 1"
)
ORACLE["latency_percentiles_overall"] = (
    f"WITH {DECISIONS} SELECT {_points('decisions', 'duration_ms')} FROM decisions"
)
_BAD = "coalesce(error_message, '') <> ''"
ORACLE["agent_report"] = (
    f"WITH {DECISIONS} SELECT agent_type, count(*) AS decisions, round(sum(duration_ms), 4) AS "
    "total_duration_ms, round(avg(duration_ms), 4) AS avg_duration_ms, count(*) FILTER "
    f"({_BAD}) AS errors, round(CAST(count(*) FILTER ({_BAD}) AS DOUBLE) / count(*), 4) AS "
    "error_rate, round(sum(coalesce(confidence, 0)) / count(*), 4) AS avg_confidence "
    "FROM decisions GROUP BY 1"
)
ORACLE["decision_view"] = (
    f"WITH {DECISIONS} SELECT doc_id, agent_type AS agent, strftime(timestamp, "
    "'%Y-%m-%dT%H:%M:%S.%f') AS timestamp, duration_ms, confidence, error_message IS NOT NULL AS "
    "has_error FROM decisions"
)
ORACLE["audit_summary"] = (
    f"WITH {DECISIONS}, s AS (SELECT session_id, count(*) AS total_decisions, "
    "round(sum(duration_ms), 4) AS total_duration_ms, round(avg(duration_ms), 4) AS "
    f"avg_duration_ms, count(*) FILTER ({_BAD}) AS error_count, round(CAST(count(*) FILTER ({_BAD})"
    " AS DOUBLE) / count(*), 4) AS error_rate FROM decisions GROUP BY 1), a AS (SELECT session_id, "
    "agent_type, count(*) AS decisions FROM decisions GROUP BY 1, 2) SELECT * FROM s JOIN a USING "
    "(session_id)"
)
ORACLE["audit_log"] = (
    f"WITH {DECISIONS} SELECT doc_id, agent_type, input_summary, output_summary FROM decisions"
)
ORACLE["evaluation_period"] = (
    f"WITH {DECISIONS} SELECT agent_type, count(*) AS decisions, min(timestamp) AS first_at, "
    "max(timestamp) AS last_at FROM decisions WHERE timestamp >= TIMESTAMP '2024-01-02 00:00:00' "
    "AND timestamp < TIMESTAMP '2024-01-05 12:00:00' GROUP BY 1"
)

# ---- files ------------------------------------------------------------------


def _files(limit_mb: int | None) -> str:
    latin = "page_id % 3 = 1 AND strlen(html) = length(html)"
    too_large = f"bytes > {limit_mb} * 1048576" if limit_mb else "false"
    return (
        f"w AS (SELECT {D.FILE_PATH} AS path, {D.FILE_TEXT} AS written, {latin} AS latin FROM pages), "
        "f AS (SELECT path, CASE WHEN latin THEN written || 'é' ELSE written END AS html, "
        "strlen(written) + CAST(latin AS INT) AS bytes, CASE WHEN latin THEN encode(written) || "
        "'\\xE9'::BLOB ELSE encode(written) END AS content FROM w), "
        "n AS (SELECT *, split_part(path, '/', -1) AS file_name, "
        "regexp_extract(split_part(path, '/', -1), '^.+\\.([^.]+)$', 1) AS suffix FROM f), "
        "r AS (SELECT *, CASE WHEN lower(suffix) IN ('txt', 'text', 'md', 'csv', 'json') THEN "
        "'text' WHEN lower(suffix) = 'pdf' THEN 'pdf' WHEN lower(suffix) IN ('jpg', 'jpeg', 'png', "
        "'gif', 'bmp', 'tiff') THEN 'image' ELSE 'unsupported' END AS route FROM n), "
        f"e AS (SELECT *, CASE WHEN {too_large} THEN 'File too large: ' || "
        f"format('{{:.2f}}', bytes / 1048576.0) || 'MB (max: {limit_mb}MB)' WHEN route = 'pdf' THEN "
        "'Failed to load PDF: text extraction not available' WHEN route = 'unsupported' THEN "
        "'Unsupported file type: ' || lower(suffix) END AS load_error FROM r)"
    )


ORACLE["ingested_files"] = (
    f"WITH {_files(None)} SELECT path AS file_path, file_name, CASE WHEN load_error IS NULL THEN "
    "lower(suffix) ELSE suffix END AS file_type, CAST(CASE WHEN load_error IS NULL THEN bytes ELSE "
    "0 END AS BIGINT) AS file_size_bytes, false AS ocr_applied, CASE WHEN load_error IS NULL THEN "
    "sha256(content) END AS source_hash, route, CASE WHEN load_error IS NULL THEN CASE route WHEN "
    "'image' THEN '[Image content - OCR not available]' ELSE replace(replace(html, chr(13) || "
    "chr(10), chr(10)), chr(13), chr(10)) END END AS text, load_error FROM e"
)
ORACLE["quarantined_files"] = (
    f"WITH {_files(1)} SELECT route, load_error, count(*) AS files FROM e WHERE load_error IS NOT "
    "NULL GROUP BY 1, 2"
)

# ---- the whole chain --------------------------------------------------------

_DATE = DOCUMENT_RULES["invoice"][2]["date"]
_AMOUNT = DOCUMENT_RULES["invoice"][2]["total_amount"]
_CODE = DOCUMENT_RULES["invoice"][2]["invoice_number"]


def _count(*tests: str) -> str:
    return " + ".join(f"CAST({t} AS INT)" for t in tests)


def _doc_errors() -> str:
    """Errors of a document's extracted values, for the keys its replies can hold."""
    common = [
        _missing("date"), _missing("total_amount"),
        _mismatch("date", _DATE, "date_falsy"), _mismatch("total_amount", _AMOUNT),
    ]
    invoice = _count(
        _missing("invoice_number"), _missing("vendor_name"),
        _mismatch("invoice_number", _CODE),
        _not_numeric("total_amount", "total_amount IS NOT NULL"), *common,
    )
    receipt = _count(
        "true", _not_numeric("total_amount", "coalesce(total_amount, '') <> ''"), *common
    )
    return (
        f"CASE document_type WHEN 'invoice' THEN {invoice} WHEN 'receipt' THEN {receipt} "
        f"WHEN 'contract' THEN {_count(_missing('parties'))} + 2 WHEN 'resume' THEN 2 "
        f"WHEN 'id_document' THEN 3 WHEN 'medical_record' THEN {_count(_missing('date'))} + 2 "
        "WHEN 'financial_statement' THEN 3 WHEN 'research_paper' THEN 2 ELSE 0 END"
    )


def _pick(name: str) -> str:
    return f"max(value) FILTER (name = '{name}') AS {name}"


_NAMES = ("invoice_number", "date", "total_amount", "vendor_name", "parties")
JUDGED = (
    f"{answers_cte()}, {TYPED}, {FIELDS}, wide AS (SELECT doc_id, "
    + ", ".join(_pick(n) for n in _NAMES)
    + ", coalesce(bool_or(falsy) FILTER (name = 'date'), false) AS date_falsy, count(*) AS n "
    "FROM vals GROUP BY 1), "
    "d0 AS (SELECT t.*, w.* EXCLUDE (doc_id, date_falsy, n), coalesce(date_falsy, false) AS "
    "date_falsy, coalesce(n, 0) AS n FROM typed t LEFT JOIN wide w USING (doc_id)), "
    f"d1 AS (SELECT *, {_doc_errors()} AS n0 FROM d0), "
    "d2 AS (SELECT * REPLACE (CASE WHEN n0 > 0 THEN '2024-05-05' ELSE date END AS date, CASE WHEN "
    "n0 > 0 THEN 'Acme' ELSE vendor_name END AS vendor_name, date_falsy AND n0 = 0 AS date_falsy, "
    "n + CASE WHEN n0 > 0 THEN CAST(date IS NULL AS INT) + CAST(vendor_name IS NULL AS INT) ELSE 0 "
    "END AS n) FROM d1), "
    f"d3 AS (SELECT *, {_doc_errors()} AS n1 FROM d2), "
    "judged AS (SELECT doc_id, document_type, classification_confidence, classify_error, "
    "n AS n_values, n0, n1, "
    "n1 = 0 AS valid, CASE WHEN n0 = 0 THEN 0 WHEN n1 = 0 THEN 1 ELSE 3 END AS attempts FROM d3), "
    "failed AS (SELECT doc_id, " + failure(
        "Extraction", "j IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM bad)")
    + " AS extract_error FROM ex)"
)
_MS = (
    "CAST(n_chars * 0.25 + n_chars * 0.5 + n_chars * 0.25 + CASE WHEN attempts > 0 THEN 16.5 ELSE "
    "0 END AS DOUBLE)"
)
_JOINED = (
    "FROM judged JOIN failed USING (doc_id) JOIN masked USING (doc_id) JOIN (SELECT doc_id, "
    "n_chars, strlen(text) AS bytes FROM documents) USING (doc_id)"
)
CHAIN = f"WITH RECURSIVE {JUDGED}, {MERGED}"
ORACLE["processed_documents"] = (
    f"{CHAIN} SELECT doc_id, valid AS success, CASE WHEN valid THEN 'completed' ELSE "
    "'requires_review' END AS status, document_type, valid AS validation_passed, classify_error IS "
    "NOT NULL OR extract_error IS NOT NULL AS had_errors, CAST(n_values AS BIGINT) AS n_values, "
    "CAST(n1 AS BIGINT) AS n_errors, CAST(attempts AS BIGINT) AS attempts, total_pii_found AS "
    f"n_pii, {_MS} AS processing_time_ms, redacted_text {_JOINED}"
)
ORACLE["processed_summary"] = (
    f"{CHAIN} SELECT doc_id, 'd' || CAST(doc_id AS VARCHAR) || '.txt' AS file, 'Success' AS "
    "status, document_type AS type, CAST(n_values AS VARCHAR) AS fields, CAST(total_pii_found AS "
    f"VARCHAR) AS pii_found, format('{{:.1f}}', {_MS}) AS time_ms {_JOINED}"
)
ORACLE["processed_metrics"] = (
    f"{CHAIN}, m AS (SELECT *, {_MS} AS ms {_JOINED}), a AS (SELECT count(*) AS total_documents, "
    "count(*) FILTER (valid) AS successful_documents, count(*) FILTER (NOT valid) AS "
    "failed_documents, round(CAST(count(*) FILTER (valid) AS DOUBLE) / count(*), 6) AS "
    "workflow_success_rate, CAST(sum(n_values) AS BIGINT) AS fields_extracted, "
    "CAST(sum(total_pii_found) AS BIGINT) AS pii_total_detected, round(CAST(count(*) FILTER (valid)"
    " AS DOUBLE) / count(*), 6) AS validator_pass_rate, round(avg(ms), 6) AS avg_latency_ms, "
    f"{_points('m', 'ms')} FROM m) SELECT * RENAME (p50 AS p50_latency_ms, p95 AS p95_latency_ms, "
    "p99 AS p99_latency_ms), workflow_success_rate >= 0.9 AS meets_workflow_success, p95 <= 4000 "
    "AS meets_latency_p95 FROM a"
)
ORACLE["classifier_accuracy"] = (
    f"WITH {answers_cte()}, {TYPED}, c AS (SELECT quality, count(*) AS documents, count(*) FILTER "
    "(document_type = CASE WHEN doc_id % 2 = 0 THEN 'invoice' ELSE 'receipt' END) AS correct FROM "
    "typed RIGHT JOIN (SELECT DISTINCT doc_id, quality FROM labels) USING (doc_id) GROUP BY 1) "
    "SELECT *, round(CAST(correct AS DOUBLE) / documents, 6) AS classifier_accuracy FROM c"
)
ORACLE["field_accuracy"] = (
    f"WITH {answers_cte()}, {FIELDS}, want AS (SELECT doc_id, lang, unnest(['invoice_number', "
    "'date', 'total_amount']) AS name, unnest(['INV-' || CAST(doc_id AS VARCHAR), '2024-03-01', "
    "CAST(n_chars AS VARCHAR) || '.5']) AS value FROM documents), c AS (SELECT lang, count(*) AS "
    "fields_total, count(*) FILTER (f.value = w.value) AS fields_correct FROM want w LEFT JOIN "
    "fields f USING (doc_id, name) GROUP BY 1) SELECT *, round(CAST(fields_correct AS DOUBLE) / "
    "fields_total, 6) AS extraction_accuracy FROM c"
)

ORACLE["threshold_checks"] = (
    "SELECT round(a, 6) AS extraction_accuracy, round(r, 6) AS pii_recall, round(p, 6) AS "
    "pii_precision, a >= 0.9 AS meets_extraction_accuracy, r >= 0.95 AS meets_pii_recall, p >= 0.9 "
    "AS meets_pii_precision, meets_workflow_success, meets_latency_p95 FROM (SELECT "
    f"CAST(sum(fields_correct) AS DOUBLE) / sum(fields_total) AS a FROM ({ORACLE['field_accuracy']})), "
    "(SELECT CAST(sum(true_positives) AS DOUBLE) / sum(total_detected) AS p, CAST(sum(true_positives)"
    " AS DOUBLE) / (sum(true_positives) + sum(false_negatives)) AS r FROM "
    f"({ORACLE['pii_detection_scores']})), ({ORACLE['processed_metrics']})"
)
ORACLE["pii_window_spans"] = (
    "SELECT doc_id, place AS start_index, place + 1 AS end_index, 'email' AS pii_type FROM (SELECT doc_id, "
    f"part * {D.WINDOW_CHARS} + instr(piece, '@') - 1 AS place, piece FROM (SELECT doc_id, part, "
    f"substr(text, part * {D.WINDOW_CHARS} + 1, {D.WINDOW_CHARS}) AS piece FROM (SELECT doc_id, text, "
    f"unnest(range(CAST(ceil(length(text) / {D.WINDOW_CHARS}.0) AS BIGINT))) AS part FROM documents))) "
    "WHERE instr(piece, '@') > 0"
)
ORACLE["file_footer"] = (
    f"WITH {_files(1)} SELECT count(*) FILTER (load_error IS NULL) || '/' || count(*) AS done FROM e"
)
ORACLE["file_metrics_by_type"] = (
    f"WITH {_files(1)}, m AS (SELECT CASE WHEN load_error IS NULL THEN 'unknown' END AS "
    "document_type, load_error IS NULL AS valid, length(path) * 0.5::DOUBLE + length(file_name) % 3 "
    "AS ms FROM e), a AS (SELECT document_type, count(*) AS total_documents, count(*) FILTER (valid) "
    "AS successful_documents, count(*) FILTER (NOT valid) AS failed_documents, round(avg(CAST(valid "
    "AS DOUBLE)), 6) AS workflow_success_rate, round(avg(CAST(valid AS DOUBLE)), 6) AS "
    f"validator_pass_rate, round(avg(ms), 6) AS avg_latency_ms, {_points('m', 'ms')} FROM m GROUP BY 1)"
    " SELECT * RENAME (p50 AS p50_latency_ms, p95 AS p95_latency_ms, p99 AS p99_latency_ms) FROM a"
)

# Values after repair, in order: known keys keep their place, new ones follow.
_FINAL = (
    "shown AS (SELECT v.doc_id, name, pos, CASE WHEN n0 > 0 AND name = 'date' THEN '2024-05-05' "
    "WHEN n0 > 0 AND name = 'vendor_name' THEN 'Acme' ELSE value END AS value FROM vals v JOIN "
    "judged USING (doc_id) UNION ALL SELECT doc_id, a.name, a.pos, a.value FROM judged, "
    "(VALUES ('date', 100, '2024-05-05'), ('vendor_name', 101, 'Acme')) a(name, pos, value) "
    "WHERE n0 > 0 AND NOT EXISTS (SELECT 1 FROM vals v WHERE v.doc_id = judged.doc_id AND v.name = "
    "a.name)), "
    # Masked spans in output order, and their types by first appearance.
    "kept AS (SELECT doc_id, pii_type, row_number() OVER (PARTITION BY doc_id ORDER BY step DESC) "
    "AS ord FROM folded WHERE kept), "
    "per_type AS (SELECT doc_id, pii_type, count(*) AS n, min(ord) AS ord FROM kept GROUP BY 1, 2)"
)
ORACLE["processed_api_view"] = (
    f"{CHAIN}, {_FINAL}, e AS (SELECT doc_id, '{{' || string_agg(CAST(to_json(name) AS VARCHAR) || "
    "':' || CAST(to_json(value) AS VARCHAR), ',' ORDER BY pos) || '}' AS extracted_data FROM shown "
    "GROUP BY 1), t AS (SELECT doc_id, count(*) AS pii_types FROM per_type GROUP BY 1) SELECT "
    "doc_id, valid AS success, document_type, coalesce(extracted_data, '{}') AS extracted_data, "
    "coalesce(pii_types, 0) AS pii_types, valid AS validation_passed, concat_ws('; ', "
    f"classify_error, extract_error) AS errors, {_MS} AS processing_time_ms {_JOINED} "
    "LEFT JOIN e USING (doc_id) LEFT JOIN t USING (doc_id)"
)
ORACLE["processed_result_view"] = (
    f"{CHAIN}, {_FINAL}, b AS (SELECT doc_id, document_type, bytes, n_values {_JOINED}), "
    "lines AS (SELECT doc_id, 0 AS part, 0 AS pos, 'info' AS section, 'File' AS label, 'd' || "
    "CAST(doc_id AS VARCHAR) || '.txt' AS value FROM b UNION ALL SELECT doc_id, 0, 1, 'info', "
    "'Type', document_type FROM b UNION ALL SELECT doc_id, 0, 2, 'info', 'Size', "
    "format('{:.1f}', bytes / CAST(1024 AS DOUBLE)) || ' KB' FROM b UNION ALL "
    "SELECT doc_id, 1, r, 'data', name, coalesce(value, 'None') FROM "
    "(SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM "
    "shown) UNION ALL SELECT doc_id, 3, ord, "
    "'pii', pii_type, CAST(n AS VARCHAR) FROM per_type) SELECT doc_id, row_number() OVER "
    "(PARTITION BY doc_id ORDER BY part, pos) - 1 AS ord, section, label, value FROM lines"
)


_FACTS = (
    f"{_FINAL}, mean AS (SELECT doc_id, count(*) AS n_fields, list_reduce(list(CAST(confidence AS "
    "DOUBLE) ORDER BY ord), lambda a, b: a + b, CAST(0 AS DOUBLE)) / count(*) AS mean, "
    "string_agg(chr(39) || name || chr(39), ', ' ORDER BY ord) AS names FROM fields GROUP BY 1), "
    "kinds_found AS (SELECT doc_id, string_agg(chr(39) || pii_type || chr(39) || ': ' || "
    "CAST(n AS VARCHAR), ', ' ORDER BY ord) AS by_type FROM per_type GROUP BY 1), "
    "n_found AS (SELECT doc_id, count(*) AS n_found FROM spans GROUP BY 1), "
    "n_model AS (SELECT doc_id, count(*) AS n_model FROM model GROUP BY 1), "
    f"x AS (SELECT doc_id, document_type, classify_error, extract_error, n1, n_values, valid, "
    "attempts, total_pii_found AS n_pii, CAST(classification_confidence AS DOUBLE) AS conf, "
    "reasoning, coalesce(n_fields, 0) AS n_fields, coalesce(mean, CAST(0 AS DOUBLE)) AS mean, "
    "coalesce(names, '') AS names, coalesce(by_type, '') AS by_type, coalesce(n_found, 0) AS "
    "n_found, coalesce(n_model, 0) AS n_model, n_chars * CAST(0.25 AS DOUBLE) AS ms, "
    f"length(text) AS size, length(text) AS seen, length(text) AS read {_JOINED} "
    "JOIN (SELECT doc_id, reasoning FROM typed) USING (doc_id) JOIN (SELECT doc_id, text FROM "
    "documents) USING (doc_id) LEFT JOIN mean USING (doc_id) LEFT JOIN kinds_found USING (doc_id) "
    "LEFT JOIN n_found USING (doc_id) LEFT JOIN n_model USING (doc_id)), "
    "visits AS (SELECT *, unnest(CASE WHEN attempts = 3 THEN [1, 2, 3] ELSE [attempts] END) AS a "
    "FROM x)"
)


def _say(template: str) -> str:
    """SQL for a message with {column} holes; < and > stand for braces."""
    out = []
    for i, part in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2:
            out.append(f"CAST({part} AS VARCHAR)")
        elif part:
            out.append(text(part.replace("<", "{").replace(">", "}")))
    return " || ".join(out)


def _stage(part: int, agent: str, source: str, said: str, did: str, conf: str, why: str = "NULL",
           ms: str = "0", error: str = "NULL", pos: str = "0") -> str:
    name = {"classifier": "ClassifierAgent", "extractor": "ExtractorAgent",
            "validator": "ValidatorAgent", "redactor": "RedactorAgent",
            "reporter": "ReporterAgent"}[agent]
    return (
        f"SELECT doc_id, {part} AS part, {pos} AS pos, '{agent}' AS agent_type, '{name}' AS "
        f"agent_name, {said} AS input_summary, {did} AS output_summary, round(CAST({conf} AS "
        f"DOUBLE), 6) AS confidence, CAST({why} AS VARCHAR) AS reasoning, CAST({ms} AS DOUBLE) AS "
        f"duration_ms, CAST({error} AS VARCHAR) AS error_message FROM {source}"
    )


_SURE = "format('{:.2f}', conf)"
_MEAN = "format('{:.2f}', mean)"
_TRUE = "CASE WHEN {0} THEN 'True' ELSE 'False' END"
_FILE = _say("Document: d{doc_id}.txt")
_STAGES = [
    _stage(0, "classifier", "x WHERE classify_error IS NULL",
           _FILE + " || " + _say(" ({seen} chars)"),
           f"'Classified as ' || document_type || ' with ' || {_SURE} || ' confidence'", "conf",
           "reasoning", "ms"),
    _stage(0, "classifier", "x WHERE classify_error IS NOT NULL", _FILE,
           "'Classification failed'", "NULL", "NULL", "ms", "classify_error"),
    _stage(1, "extractor", "x WHERE extract_error IS NULL",
           _say("Document type: {document_type}, Content: {read} chars"),
           _say("Extracted {n_fields} fields with avg confidence ") + f" || {_MEAN}", "mean",
           _say("Extracted fields: [{names}]"), "ms * 2"),
    _stage(1, "extractor", "x WHERE extract_error IS NOT NULL",
           _say("Document type: {document_type}"), "'Extraction failed'", "NULL", "NULL",
           "ms * 2", "extract_error"),
    _stage(2, "validator", "visits", _say("Validating {n_values} fields for {document_type}"),
           f"'Valid: ' || {_TRUE.format('valid')} || " + _say(", Errors: {n1}, Warnings: 0"),
           "CASE WHEN valid THEN 1 ELSE 0.5 END", _say("Repair attempts: {a}"),
           "CASE WHEN a = 1 THEN 16.5 ELSE 0 END", pos="a"),
    _stage(3, "redactor", "x", _say("Text with {size} characters"),
           _say("Found {n_pii} PII entities: <{by_type}>"),
           "CASE WHEN n_pii > 0 THEN 0.95 ELSE 1 END",
           _say("Regex found: {n_found}, LLM found: {n_model}"), "ms"),
    _stage(4, "reporter",
           "(SELECT *, 3 + CASE WHEN attempts = 3 THEN 3 ELSE 1 END AS before FROM x)",
           _say("Processing state with {before} agent decisions"),
           f"'Report generated, success=' || {_TRUE.format('valid')}", "1"),
]
_LOGGED = [
    _stage(0, "classifier", "x WHERE classify_error IS NULL",
           _say("Document content ({seen} chars)"),
           f"'Type: ' || document_type || ', Confidence: ' || {_SURE}", "conf"),
    _stage(1, "extractor", "x WHERE extract_error IS NULL",
           _say("Document type: {document_type}"), _say("Extracted {n_fields} fields"), "mean"),
    _stage(2, "validator", "visits", _say("Document type: {document_type}"),
           f"'Valid: ' || {_TRUE.format('valid')}", "CASE WHEN valid THEN 1 ELSE 0.5 END",
           pos="a"),
    _stage(3, "redactor", "x", _say("Document with {size} chars"),
           _say("Redacted {n_pii} PII entities"), "0.95"),
]
_SEQ = "row_number() OVER (PARTITION BY doc_id ORDER BY part, pos) - 1 AS seq"
ORACLE["processed_trace"] = (
    f"{CHAIN}, {_FACTS}, s AS ({' UNION ALL '.join(_STAGES)}) SELECT doc_id, {_SEQ}, agent_type, "
    "agent_name, input_summary, output_summary, confidence, reasoning, duration_ms, error_message "
    "FROM s"
)
ORACLE["processed_audit"] = (
    f"{CHAIN}, {_FACTS}, s AS ({' UNION ALL '.join(_LOGGED)}) SELECT doc_id, {_SEQ}, agent_type, "
    "input_summary, output_summary, confidence FROM s"
)

# ---- tables of commits, streams, levels ---------------------------------------

ORACLE["scanned_files"] = (
    "WITH f AS (SELECT page_id, page_id % 2 AS run, coalesce(html, '') || chr(10) AS c, "
    "CAST(page_id AS VARCHAR) || '/' AS place FROM pages), h AS (SELECT *, sha256(c) AS source_hash FROM f), "
    "news AS (SELECT * FROM h WHERE run = 0 OR source_hash NOT IN (SELECT source_hash FROM h WHERE run = 0)) "
    "SELECT arg_min(page_id, place) AS page_id, run, 'txt' AS file_type, CAST(strlen(any_value(c)) AS BIGINT) AS "
    "file_size_bytes, source_hash, sha256(replace(replace(any_value(c), chr(13) || chr(10), chr(10)), chr(13), chr(10))) "
    "AS text_hash FROM news GROUP BY run, source_hash"
)
ORACLE["new_pages"] = (
    "WITH h AS (SELECT page_id, sha256(html) AS source_hash FROM pages WHERE html IS NOT NULL) SELECT min(page_id) AS "
    "page_id, source_hash FROM h WHERE source_hash NOT IN (SELECT source_hash FROM h WHERE page_id % 3 <> 0) GROUP BY 2"
)
ORACLE["committed_decisions"] = (
    f"WITH {DECISIONS} SELECT session_id, agent_type, count(*) AS decisions, count(DISTINCT doc_id) AS documents, "
    "round(sum(duration_ms), 4) AS total_duration_ms FROM decisions GROUP BY 1, 2"
)
ORACLE["committed_results"] = (
    "SELECT document_type, count(*) AS results, count(*) FILTER (is_valid) AS passed, CAST(sum(n_errors) AS BIGINT) AS "
    f"errors FROM ({ORACLE['record_verdicts']}) GROUP BY 1"
)
ORACLE["streamed_repairs"] = ORACLE["repair_rounds"]
ORACLE["pii_overlap_pairs"] = (
    f"WITH {TRUTH} SELECT f.doc_id, f.pii_type AS left_pii_type, CAST(f.s AS BIGINT) AS left_start_index, CAST(f.e AS "
    "BIGINT) AS left_end_index, t.pii_type AS right_pii_type, CAST(t.s AS BIGINT) AS right_start_index, CAST(t.e AS "
    "BIGINT) AS right_end_index FROM found f JOIN truth t ON t.doc_id = f.doc_id AND NOT (f.e <= t.s OR t.e <= f.s)"
)
_LEVEL = "CASE grouping(document_type, lang) WHEN 0 THEN 'document_type,lang' WHEN 1 THEN 'document_type' ELSE '' END"
ORACLE["metrics_by_level"] = (
    f"{CHAIN}, m AS (SELECT *, {_MS} AS ms {_JOINED} JOIN (SELECT doc_id, lang FROM documents) USING (doc_id)), a AS "
    f"(SELECT {_LEVEL} AS level, document_type, lang, count(*) AS total_documents, count(*) FILTER (valid) AS "
    "successful_documents, count(*) FILTER (NOT valid) AS failed_documents, round(CAST(count(*) FILTER (valid) AS DOUBLE) "
    "/ count(*), 6) AS workflow_success_rate, CAST(sum(n_values) AS BIGINT) AS fields_extracted, CAST(sum(total_pii_found) "
    "AS BIGINT) AS pii_total_detected, round(CAST(count(*) FILTER (valid) AS DOUBLE) / count(*), 6) AS "
    f"validator_pass_rate, round(avg(ms), 6) AS avg_latency_ms, {_points('m', 'ms')} FROM m GROUP BY GROUPING SETS "
    "((document_type, lang), (document_type), ())) SELECT * RENAME (p50 AS p50_latency_ms, p95 AS p95_latency_ms, "
    "p99 AS p99_latency_ms) FROM a"
)
ORACLE["running_audit"] = (
    f"WITH {DECISIONS} SELECT session_id, agent_type, count(*) AS decisions, round(sum(duration_ms), 4) AS "
    f"total_duration_ms, count(*) FILTER ({_BAD}) AS errors, round(CAST(count(*) FILTER ({_BAD}) AS DOUBLE) / count(*), 4) "
    "AS error_rate, round(sum(coalesce(confidence, 0)), 4) AS total_confidence FROM decisions GROUP BY 1, 2"
)
ORACLE["decision_periods"] = (
    f"WITH {DECISIONS}, days AS (SELECT DISTINCT agent_type, date_trunc('day', timestamp) AS d FROM decisions), "
    f"periods AS ({D.PERIOD_ROWS}) SELECT doc_id, decisions.agent_type, CASE WHEN end_at IS NULL OR timestamp < end_at THEN "
    "name END AS period, CASE WHEN end_at IS NULL OR timestamp < end_at THEN start_at END AS start_at FROM decisions "
    "ASOF LEFT JOIN periods ON decisions.agent_type = periods.agent_type AND decisions.timestamp >= periods.start_at"
)


def _state(source: str, keys: str, points: int) -> str:
    """The points of a quantile state and their weights, from values x with weight w."""
    return (
        f"(SELECT *, upto - coalesce(lag(upto) OVER (PARTITION BY {keys} ORDER BY x), 0) AS w FROM (SELECT {keys}, x, c, "
        f"CAST(sum(c) OVER (PARTITION BY {keys} ORDER BY x) AS BIGINT) AS upto, CAST(sum(c) OVER (PARTITION BY {keys}) AS BIGINT) AS n "
        f"FROM (SELECT {keys}, x, CAST(sum(w) AS BIGINT) AS c FROM {source} WHERE x IS NOT NULL GROUP BY ALL)) "
        f"WHERE (upto * {points}) // n > ((upto - c) * {points}) // n)"
    )


_AT = {"p50": "n // 2", "p95": "CAST(floor(n * CAST(0.95 AS DOUBLE)) AS BIGINT)", "p99": "CAST(floor(n * CAST(0.99 AS DOUBLE)) AS BIGINT)"}
ORACLE["latency_states"] = (
    f"WITH {DECISIONS}, raw AS (SELECT session_id, agent_type, CAST(duration_ms AS DOUBLE) AS x, 1 AS w FROM decisions), "
    f"s1 AS (SELECT * FROM {_state('raw', 'session_id, agent_type', 32)}), s2 AS (SELECT agent_type, x, w FROM {_state('s1', 'agent_type', 64)}), "
    "placed AS (SELECT *, sum(w) OVER (PARTITION BY agent_type ORDER BY x) AS upto, CAST(sum(w) OVER (PARTITION BY agent_type) AS BIGINT) AS n FROM s2), "
    "q AS (SELECT agent_type, max(n) AS n, " + ", ".join(f"min(x) FILTER (upto > {at}) AS {p}" for p, at in _AT.items())
    + " FROM placed GROUP BY 1), ranks AS (SELECT q.*, "
    + ", ".join(f"count(*) FILTER (x < {p}) AS {p}_lo, count(*) FILTER (x <= {p}) AS {p}_hi" for p in _AT)
    + " FROM raw JOIN q USING (agent_type) WHERE x IS NOT NULL GROUP BY ALL) SELECT agent_type, n, p50, p95, p99, "
    + ", ".join(f"CAST(greatest(0, {p}_lo - ({at}), ({at}) - {p}_hi + 1) AS BIGINT) AS {p}_off" for p, at in _AT.items())
    + " FROM ranks"
)
