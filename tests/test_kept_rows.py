"""Rows that are easily lost: NULL groups, missing predictions, unlisted names, unread files."""

import pytest

from paperloom.operators import catalogue, evaluate, report, trace
from paperloom.operators.percentiles import exact_percentiles
from paperloom.sources import files


def test_a_null_group_keeps_its_percentiles(spark):
    rows = [(None, 10.0), (None, 10.0), ("a", 20.0)]
    df = spark.createDataFrame(rows, "kind string, x double")
    assert {r.kind: r.p50 for r in exact_percentiles(df, "x", ["kind"]).collect()} == {None: 10.0, "a": 20.0}


def test_metrics_of_a_null_group(spark):
    schema = "document_type string, success boolean, n_fields int, n_pii int, validation_passed boolean, processing_time_ms double"
    rows = [(None, False, 0, 0, False, 10.0), ("memo", True, 1, 2, True, 20.0)]
    got = report.metrics(spark.createDataFrame(rows, schema), by=["document_type"]).collect()
    assert {r.document_type: r.p50_latency_ms for r in got} == {None: 10.0, "memo": 20.0}


def test_accuracy_counts_documents_without_a_prediction(spark):
    truth = spark.createDataFrame([(1, "memo"), (2, "memo"), (3, "memo")], "doc_id long, document_type string")
    results = spark.createDataFrame([(1, "memo")], "doc_id long, document_type string")
    row = evaluate.score_types(results, truth).first()
    assert (row.documents, row.correct) == (3, 1) and row.classifier_accuracy == pytest.approx(1 / 3)


def test_audit_summary_keeps_every_agent(spark):
    schema = "session_id string, agent_type string, duration_ms double, error_message string"
    rows = [("s", "classifier", 1.0, None), ("s", "translator", 3.0, "bad"), ("s", None, None, "")]
    row = report.audit_summary(spark.createDataFrame(rows, schema)).first()
    assert row.decisions_by_agent == {"classifier": 1, "translator": 1, "(none)": 1}
    assert (row.total_decisions, row.avg_duration_ms, row.error_count) == (3, 2.0, 1)


def test_type_usage_adds_up(spark):
    df = spark.createDataFrame([("leaflet",), (None,), ("invoice",)], "document_type string")
    got = {r.document_type: r.records for r in catalogue.type_usage(df).collect()}
    assert got["invoice"] == got["(unlisted)"] == got["(none)"] == 1 and sum(got.values()) == 3


def test_a_file_that_scan_left_out_has_an_error(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "big.txt").write_text("x" * 1_600_000)
    (tmp_path / "small.txt").write_text("y")
    got = {r.file_name: r for r in files.ingest(files.scan(spark, str(tmp_path), max_mb=1)).collect()}
    assert got["small.txt"].load_error is None and got["big.txt"].load_error == "File too large: 1.53MB (max: 1MB)"
    unread = files.scan(spark, str(tmp_path), max_mb=1).drop("max_mb")
    errors = {r.file_name: r.load_error for r in files.ingest(unread).collect()}
    assert errors == {"small.txt": None, "big.txt": "File content was not read"}
    assert files.ingest(files.scan(spark, str(tmp_path))).where("text is not null").count() == 2


def test_nothing_is_cut_unless_asked(spark):
    row = ("classifier", "A", None, "x" * 900, "y" * 501, None, None, 1.0, None, None, 0, None)
    df = spark.createDataFrame([row], trace.DECISION[len("struct<"):-1])
    whole, short = trace.log_decisions(df, limit=None).first(), trace.log_decisions(df, limit=7).first()
    assert (len(whole.input_summary), len(whole.output_summary), len(short.output_summary)) == (900, 501, 7)


def test_a_whole_view_lists_all_fields(spark):
    data = {f"f{i:02}": "v" * (40 + i) for i in range(20)}
    schema = "doc_id int, file_name string, document_type string, file_size_bytes long, extracted_data map<string,string>, pii_summary map<string,int>"
    results = spark.createDataFrame([(1, "a.txt", "memo", 10, data, {})], schema)
    whole = {r.label: r.value for r in report.result_view(results, first=None, width=None).where("section = 'data'").collect()}
    assert whole == data
    cut = report.result_view(results, first=3, width=5).where("section = 'data'").orderBy("ord").collect()
    assert [r.value for r in cut] == ["vvvvv..."] * 3 + ["(17 more fields)"]
