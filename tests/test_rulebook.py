"""Rules that are rows: the built-in table changes nothing, versions hold by date."""

from datetime import date

from paperloom.operators import rulebook, validate
from paperloom.plans import derived as D

RECORD = "doc_id string, document_type string, structured_data map<string,string>, issued date"


def errors(df):
    return sorted(
        (r.doc_id, str(r.rules_from), r.ord, r.field_name, r.error_type, r.expected_value)
        for r in rulebook.error_rows(df).collect()
    )


def test_the_built_in_table_gives_the_built_in_errors(spark, sf):
    records = D.records(spark, sf)
    want = validate.error_rows(validate.validate(records))
    got = rulebook.error_rows(rulebook.check(records, rulebook.built_in(spark))).drop("rules_from")
    assert got.columns == want.columns
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and not got.isEmpty()


def test_a_version_holds_from_its_day_to_the_next(spark):
    day = date(2024, 5, 1)
    rules = spark.createDataFrame(
        [
            ("memo", None, "title", "required", None, 0),
            ("memo", day, "title", "pattern", "^A", 0),
            ("memo", day, "title", "pattern", "^A", 0),  # twice, counts once
            ("memo", day, "n", "number", None, 0),
            ("memo", day, None, "required", None, 1),
            ("memo", day, "x", "pattern", None, 1),
            (None, day, "x", "required", None, 1),
            ("memo", date(2024, 6, 1), None, "none", None, 0),
        ],
        rulebook.RULES,
    )
    rows = [
        ("a", "memo", {"title": ""}, date(2024, 4, 30)),
        ("b", "memo", {"title": "B", "n": "1,x"}, day),
        ("c", "memo", {"title": "A", "n": "$1,000"}, date(2024, 5, 31)),
        ("d", "memo", {"title": ""}, date(2024, 6, 1)),
        ("e", "memo", {"title": "B"}, None),  # no date: the latest version
        ("f", "note", {}, day),
        ("g", None, {}, day),
        ("h", "memo", None, day),
    ]
    checked = rulebook.check(spark.createDataFrame(rows, RECORD), rules, on="issued")
    assert checked.count() == len(rows)
    assert errors(checked) == [
        ("a", "None", 0, "title", "missing_required", None),
        ("b", "2024-05-01", 0, "title", "pattern_mismatch", "^A"),
        ("b", "2024-05-01", 1, "n", "invalid_type", None),
        ("h", "2024-05-01", 0, "extracted_data", "missing_data", None),
    ]
    assert {r.doc_id: str(r.rules_from) for r in checked.collect()}["e"] == "2024-06-01"


def test_a_table_too_large_to_send(spark, sf, monkeypatch):
    records, rules = D.dated_records(spark, sf), D.rule_versions(spark)
    sent = errors(rulebook.check(records, rules, on="issued"))
    monkeypatch.setattr(rulebook, "MAX_SENT", 3)
    assert errors(rulebook.check(records, rules, on="issued")) == sent


def test_empty_tables(spark):
    rules = rulebook.built_in(spark)
    none = spark.createDataFrame([], RECORD)
    assert rulebook.check(none, rules, on="issued").count() == 0
    one = spark.createDataFrame([("a", "invoice", {}, None)], RECORD)
    assert errors(rulebook.check(one, rules.limit(0), on="issued")) == []


def test_a_newer_version_changes_rows(spark, sf):
    records = D.dated_records(spark, sf)
    old = rulebook.check(records, rulebook.built_in(spark), on="issued")
    new = rulebook.check(records, D.rule_versions(spark), on="issued")
    assert old.count() == new.count()
    changed = new.where("rules_from IS NOT NULL")
    assert not changed.isEmpty() and set(errors(new)) != set(errors(old))
