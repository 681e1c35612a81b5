"""Request texts for the model stages (I1-I4). Wording is our own."""

from __future__ import annotations

from paperloom.functions.basics import lit
from paperloom.functions.fixed_values import (
    DOCUMENT_TYPES,
    EXTRACTION_FIELDS,
    PII_MASKS,
)

CLASSIFY_HEAD = (
    "Decide which kind of document follows. Kinds: "
    + ", ".join(DOCUMENT_TYPES)
    + ".\nAnswer with JSON: document_type, confidence (0 to 1), reasoning.\n\n"
)
EXTRACT_SHAPE = (
    "Answer with JSON: fields (a list of name, value, confidence, data_type) and "
    "structured_data (name to value). Write dates as YYYY-MM-DD and amounts as plain numbers.\n\n"
)
OPEN_EXTRACT_HEAD = (
    "Read out every name, date, amount, address and identifier in this document.\n" + EXTRACT_SHAPE
)
DETECT_HEAD = (
    "List the personal data in the text below. Types: "
    + ", ".join(PII_MASKS)
    + ".\nAnswer with JSON: pii_entities, a list of type, value, start, end, confidence.\n\n"
)
REPAIR_HEAD = (
    "These extracted values break validation rules. Answer with JSON: corrected_fields "
    "(name to value) and repair_notes.\n"
)


def extract_head(doc_type: str) -> str:
    names = ", ".join(EXTRACTION_FIELDS[doc_type])
    return f"Read these fields out of the {doc_type}: {names}.\n{EXTRACT_SHAPE}"


def windows(text: str, limit: int | None, overlap: int = 0) -> str:
    """The whole text as ``(part, offset, piece)``; pieces of ``limit`` characters if one is given.

    Each piece repeats the last ``overlap`` characters of the one before it.
    """
    if limit is None:
        return f"array(named_struct('part', 0, 'offset', 0, 'piece', {text}))"
    if not 0 <= overlap < limit:
        raise ValueError(f"overlap {overlap} does not fit windows of {limit}")
    step = limit - overlap
    last = f"greatest(0, CAST(ceil((length({text}) - {overlap}) / {step}) AS INT) - 1)"
    piece = f"substring({text}, i * {step} + 1, {limit})"
    return (
        f"transform(sequence(0, {last}), "
        f"i -> named_struct('part', i, 'offset', i * {step}, 'piece', {piece}))"
    )


def classify_request(text: str) -> str:
    return f"concat({lit(CLASSIFY_HEAD)}, {text})"


def extract_request(document_type: str, text: str) -> str:
    heads = " ".join(f"WHEN {lit(t)} THEN {lit(extract_head(t))}" for t in EXTRACTION_FIELDS)
    head = f"CASE {document_type} {heads} ELSE {lit(OPEN_EXTRACT_HEAD)} END"
    return f"concat({head}, {text})"


def detect_request(text: str) -> str:
    return f"concat({lit(DETECT_HEAD)}, {text})"


def error_lines(errors: str) -> str:
    """``- field: message (expected: pattern)``, one line per error."""
    expected = (
        "CASE WHEN coalesce(e.expected_value, '') <> '' "
        "THEN concat(' (expected: ', e.expected_value, ')') ELSE '' END"
    )
    line = f"concat('- ', e.field_name, ': ', e.error_message, {expected})"
    return f"array_join(transform({errors}, e -> {line}), {lit(chr(10))})"


def repair_request(data: str, errors: str, text: str) -> str:
    parts = [
        lit(REPAIR_HEAD + "\nValues:\n"),
        f"to_json({data})",
        lit("\nErrors:\n"),
        error_lines(errors),
        lit("\nDocument:\n"),
        f"coalesce({text}, '')",
    ]
    return f"concat({', '.join(parts)})"
