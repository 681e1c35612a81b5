import pytest
from pyspark.sql import functions as F

from paperloom.functions.rules import FIX
from paperloom.operators import validate

GOOD = {
    "invoice_number": "INV-001", "date": "2024-11-15", "total_amount": "100.00",
    "vendor_name": "Test",
}
SCHEMA = "doc_id long, document_type string, structured_data map<string,string>"


def errors(spark, kind, data, untruthy=None):
    df = spark.createDataFrame(
        [(1, kind, data, untruthy or [])], SCHEMA + ", untruthy array<string>"
    )
    row = validate.validate(df, untruthy="untruthy").first()
    return [(e.field_name, e.error_type) for e in row.validation.errors]


@pytest.mark.parametrize(
    ("kind", "data", "want"),
    [
        ("invoice", GOOD, []),
        ("invoice", {}, [(f, "missing_required") for f in GOOD]),
        ("invoice", {**GOOD, "date": "November 15, 2024"}, [("date", "pattern_mismatch")]),
        ("invoice", {**GOOD, "total_amount": "$2,495.50"}, [("total_amount", "pattern_mismatch")]),
        ("invoice", {**GOOD, "total_amount": None},
         [("total_amount", "missing_required"), ("total_amount", "invalid_type")]),
        ("invoice", {**GOOD, "total_amount": ""},
         [("total_amount", "missing_required"), ("total_amount", "invalid_type")]),
        ("invoice", {**GOOD, "total_amount": "1d"},
         [("total_amount", "pattern_mismatch"), ("total_amount", "invalid_type")]),
        ("invoice", {**GOOD, "total_amount": "1_000"}, [("total_amount", "pattern_mismatch")]),
        ("invoice", {**GOOD, "total_amount": "inf"}, [("total_amount", "pattern_mismatch")]),
        ("invoice", {**GOOD, "date": "2024-11-15\n"}, []),
        ("invoice", {**GOOD, "invoice_number": "inv"}, [("invoice_number", "pattern_mismatch")]),
        ("receipt", {"date": "2024-01-01", "total_amount": "5", "merchant_name": "M",
                     "subtotal": "x", "tax_amount": ""}, [("subtotal", "invalid_type")]),
        ("contract", {"parties": "a", "effective_date": "soon", "terms": "t"},
         [("effective_date", "pattern_mismatch")]),
        ("report", {}, []),
        (None, {}, []),
        ("invoice", None, [("extracted_data", "missing_data")]),
    ],
)
def test_rules(spark, kind, data, want):
    assert errors(spark, kind, data) == want


def test_typed_falsy_values_are_present_but_skip_patterns(spark):
    assert errors(spark, "invoice", {**GOOD, "date": "0"}, ["date"]) == []
    assert errors(spark, "invoice", {**GOOD, "date": "0"}) == [("date", "pattern_mismatch")]


def test_error_texts(spark):
    df = spark.createDataFrame([(1, "contract", {"effective_date": "May 'x'"})], SCHEMA)
    got = validate.error_rows(validate.validate(df)).orderBy("ord").collect()
    assert got[0].error_message == "Required field 'parties' is missing or empty"
    last = got[-1]
    assert last.error_message == (
        "Field 'effective_date' value 'May 'x'' does not match expected pattern"
    )
    assert (last.expected_value, last.actual_value) == (r"^\d{4}-\d{2}-\d{2}$", "May 'x'")


def repair(spark, data, fixes):
    df = spark.createDataFrame(
        [(1, "invoice", data, [f and (f, []) for f in fixes])], f"{SCHEMA}, fixes array<{FIX}>"
    )
    row = validate.validate(df, "fixes").withColumn(
        "in_order", F.map_keys("structured_data")
    ).first()
    return row.validation, row.structured_data, row.in_order


def test_repair_stops_when_valid(spark):
    bad = {**GOOD, "date": "bad-date"}
    v, data, order = repair(spark, bad, [{"date": "still"}, {"date": "2024-01-02"}, {"date": "later"}])
    assert (v.is_valid, v.attempts, v.repair_attempted, v.repair_successful) == (True, 2, True, True)
    assert data["date"] == "2024-01-02"
    assert [(x.attempts, x.is_valid) for x in v.visits] == [(1, False), (2, True)]


def test_repair_is_bounded_and_failed_attempts_count(spark):
    v, data, order = repair(spark, {**GOOD, "date": "bad"}, [None, {}])
    assert (v.is_valid, v.attempts, v.repair_successful) == (False, 2, False)
    assert data["date"] == "bad" and len(v.visits) == 2


def test_repair_keeps_key_order_and_adds_new_keys_last(spark):
    v, data, order = repair(spark, {"date": "x", "total_amount": "1"},
                     [{"vendor_name": "V", "date": "2024-01-02", "invoice_number": "I"}])
    assert order == ["date", "total_amount", "vendor_name", "invoice_number"] and v.is_valid


def test_no_data_is_never_repaired(spark):
    v, _, _ = repair(spark, None, [{"date": "2024-01-02"}])
    assert (v.is_valid, v.attempts, v.visits) == (False, 0, [])


def test_report_counts(spark):
    df = spark.createDataFrame([(i, "resume", {"name": "n"}) for i in range(3)], SCHEMA)
    row = validate.error_report(validate.validate(df)).first()
    assert (row.field_name, row.error_type, row.n) == ("contact_info", "missing_required", 3)
