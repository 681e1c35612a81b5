"""Catalogue rules (V1-V8)."""

from __future__ import annotations

from paperloom.functions.basics import empty, let, lit, merge_maps, reads_as_float, struct
from paperloom.functions.fixed_values import DOCUMENT_RULES, INVOICE_NUMERIC, RECEIPT_NUMERIC

ERROR = (
    "struct<field_name:string,error_type:string,error_message:string,"
    "expected_value:string,actual_value:string,severity:string>"
)
VISIT = "struct<n_fields:int,is_valid:boolean,n_errors:int,attempts:int>"
FIX = "struct<data:map<string,string>,untruthy:array<string>>"
STATE = (
    "struct<data:map<string,string>,untruthy:array<string>,"
    f"errors:array<{ERROR}>,attempts:int,visits:array<{VISIT}>>"
)
_NONE = "CAST(NULL AS STRING)"


def _error(field: str, kind: str, message: str, expected: str = _NONE, actual: str = _NONE) -> str:
    return struct(
        field_name=lit(field),
        error_type=lit(kind),
        error_message=message,
        expected_value=expected,
        actual_value=actual,
        severity="'error'",
    )


def _checks(doc_type: str, rule: tuple, data: str, untruthy: str) -> list[str]:
    required, _, patterns = rule

    def value(field: str) -> str:
        return f"try_element_at({data}, {lit(field)})"

    def truthy(field: str) -> str:
        return (
            f"(coalesce({value(field)}, '') <> '' "
            f"AND NOT array_contains({untruthy}, {lit(field)}))"
        )

    def numeric(field: str, applies: str) -> str:
        stripped = f"replace(replace(coalesce({value(field)}, 'None'), ',', ''), '$', '')"
        error = _error(
            field, "invalid_type", lit(f"{field} must be numeric"), actual=value(field)
        )
        return f"CASE WHEN {applies} AND NOT {reads_as_float(stripped)} THEN {error} END"

    checks = []
    for field in required:
        error = _error(field, "missing_required",
                       lit(f"Required field '{field}' is missing or empty"))
        checks.append(f"CASE WHEN coalesce({value(field)}, '') = '' THEN {error} END")
    for field, pattern in patterns.items():
        opening = lit(f"Field '{field}' value '")
        closing = lit("' does not match expected pattern")
        error = _error(
            field,
            "pattern_mismatch",
            f"concat({opening}, {value(field)}, {closing})",
            expected=lit(pattern),
            actual=value(field),
        )
        fails = f"NOT ({value(field)} RLIKE {lit('(?Ud)' + pattern)})"
        checks.append(f"CASE WHEN {truthy(field)} AND {fails} THEN {error} END")
    if doc_type == "invoice":
        checks += [numeric(f, f"map_contains_key({data}, {lit(f)})") for f in INVOICE_NUMERIC]
    elif doc_type == "receipt":
        checks += [numeric(f, truthy(f)) for f in RECEIPT_NUMERIC]
    return checks


def rule_errors(
    document_type: str, data: str, untruthy: str, rules: dict = DOCUMENT_RULES
) -> str:
    """V1-V5: errors of one record, in catalogue order.

    ``data`` holds values as text; ``untruthy`` names the keys whose typed value
    was 0, false or an empty collection, which pattern rules skip. Types without
    rules have no errors; a NULL ``data`` is the one error ``missing_data``.
    """
    no_data = _error("extracted_data", "missing_data", lit("No extracted data to validate"))
    cases = [f"WHEN {data} IS NULL THEN array({no_data})"]
    for doc_type, rule in rules.items():
        checks = ", ".join(_checks(doc_type, rule, data, untruthy))
        cases.append(
            f"WHEN {document_type} = {lit(doc_type)} THEN array_compact(array({checks}))"
        )
    return f"CAST(CASE {' '.join(cases)} ELSE array() END AS array<{ERROR}>)"


def _visit(fields: str, errors: str, attempts: str) -> str:
    return "array(" + struct(
        n_fields=f"size({fields})",
        is_valid=f"size({errors}) = 0",
        n_errors=f"size({errors})",
        attempts=attempts,
    ) + ")"


def first_visit(data: str, untruthy: str, errors: str) -> str:
    """STATE of a record that is not repaired; a NULL ``data`` counts no visit."""
    visits = f"CASE WHEN {data} IS NULL THEN {empty(VISIT)} ELSE {_visit(data, errors, '0')} END"
    state = struct(data=data, untruthy=untruthy, errors=errors, attempts="0", visits=visits)
    return f"CAST({state} AS {STATE})"


def repair_rounds(
    document_type: str,
    data: str,
    untruthy: str,
    errors: str,
    fixes: str,
    rules: dict = DOCUMENT_RULES,
) -> str:
    """V7, V8: use one correction per round while errors remain. Gives STATE.

    ``errors`` are those of ``data``. ``fixes`` is an array of FIX, one per
    allowed attempt (NULL or an empty map where the attempt brought nothing). The
    bound is the length of that array, so the loop is a fold inside the row: no
    join and no pass over the data per round. Records without errors, and a NULL
    ``data``, never evaluate ``fixes``.
    """
    start = struct(
        data=data, untruthy=untruthy, errors=errors, attempts="0", visits=empty(VISIT)
    )
    used = "coalesce(size(fix.data) > 0, false)"
    candidate = struct(
        data=f"CASE WHEN {used} THEN {merge_maps('acc.data', 'fix.data')} ELSE acc.data END",
        untruthy=f"CASE WHEN {used} THEN array_union(array_except(acc.untruthy, "
                 "map_keys(fix.data)), fix.untruthy) ELSE acc.untruthy END",
    )
    checked = (
        f"CASE WHEN {used} THEN {rule_errors(document_type, 'c.data', 'c.untruthy', rules)} "
        f"ELSE acc.errors END"
    )
    after = struct(
        data="c.data",
        untruthy="c.untruthy",
        errors="e",
        attempts="acc.attempts + 1",
        visits=f"concat(acc.visits, {_visit('c.data', 'e', 'acc.attempts + 1')})",
    )
    attempt = (
        "CASE WHEN size(acc.errors) = 0 THEN acc "
        f"ELSE {let('c', candidate, let('e', checked, after))} END"
    )
    fold = f"aggregate(fx, CAST({start} AS {STATE}), (acc, fix) -> {attempt})"
    once = first_visit(data, untruthy, errors)
    rounds = let("fx", fixes, f"CASE WHEN size(fx) = 0 THEN {once} ELSE {fold} END")
    return (
        f"CASE WHEN {data} IS NULL OR size({errors}) = 0 THEN {once} ELSE {rounds} END"
    )
