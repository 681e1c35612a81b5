import random

import model
import pytest
from pyspark.sql import functions as F

from paperloom.functions.fixed_values import DOCUMENT_TYPES
from paperloom.operators import catalogue, evaluate, report
from paperloom.operators.percentiles import exact_percentiles
from paperloom.operators.trace import DECISION, log_decisions

DECISIONS = "agent_type string, duration_ms double, confidence double, error_message string"


def test_percentiles_of_skewed_and_tied_groups(spark):
    rnd = random.Random(3)
    groups = {
        "hot": [rnd.gauss(0, 50) for _ in range(4000)],
        "ties": [5.0] * 1500 + [7.0] * 3,
        "steps": [float(rnd.randint(1, 4)) for _ in range(700)],
        "one": [3.5],
        "two": [1.0, 2.0],
        "hundred": [float(i) for i in range(100)],
    }
    rows = [(g, x) for g, xs in groups.items() for x in xs]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: (r.p50, r.p95, r.p99) for r in exact_percentiles(df, "x", ("g",)).collect()}
    for g, xs in groups.items():
        xs, n = sorted(xs), len(xs)
        assert got[g] == (xs[n // 2], xs[int(n * 0.95)], xs[int(n * 0.99)]), g
    every = sorted(x for _, x in rows)
    n = len(every)
    whole = exact_percentiles(df, "x").first()
    assert tuple(whole) == (every[n // 2], every[int(n * 0.95)], every[int(n * 0.99)])


def test_percentiles_stay_exact_when_the_cuts_are_coarse(spark, monkeypatch):
    from paperloom.operators import percentiles

    monkeypatch.setattr(percentiles, "_HALVINGS", 1)
    monkeypatch.setattr(percentiles, "_ACCURACY", 1)
    xs = [float(i * 7919 % 5003) for i in range(5003)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    xs.sort()
    got = exact_percentiles(df, "x").first()
    assert tuple(got) == (xs[2501], xs[int(5003 * 0.95)], xs[int(5003 * 0.99)])


def test_percentiles_shuffle_raw_rows_once_and_keep_null_groups(spark):
    rows = [(None if i % 3 else "a", float(i % 50) if i % 7 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, x double")
    points = exact_percentiles(df, "x", ("g",))
    for r in points.collect():
        xs = sorted(x for g, x in rows if g == r.g and x is not None)
        assert (r.p50, r.p95, r.p99) == tuple(xs[i] for i in (len(xs) // 2, int(len(xs) * 0.95), int(len(xs) * 0.99)))
    plan = points._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation" not in plan and "Scan ExistingRDD" in points._jdf.queryExecution().executedPlan().toString()
    assert plan.count("LogicalRDD [g") >= 3  # the counts are read where the rows would be
    assert points.count() == 2 and exact_percentiles(df.where("false"), "x", ("g",)).count() == 0


def test_more_than_one_row_of_scores_is_an_error(spark):
    results = spark.createDataFrame([(True, {"a": "1"}, {"email": 1}, True, 5.0)], RESULT)
    score = "extraction_accuracy double, pii_recall double, pii_precision double"
    one = spark.createDataFrame([(0.95, 0.9, 0.9)], score)
    m = report.meets_thresholds(report.metrics(report.metric_inputs(results), scores=one)).first()
    assert (m.meets_extraction_accuracy, m.meets_pii_recall, m.meets_pii_precision) == (True, False, True)
    with pytest.raises(Exception, match="SCALAR_SUBQUERY_TOO_MANY_ROWS"):
        report.metrics(report.metric_inputs(results), scores=one.union(one)).collect()


RESULT = (
    "success boolean, extracted_data map<string,string>, pii_summary map<string,int>, "
    "validation_passed boolean, processing_time_ms double"
)


def test_metrics(spark):
    rows = [(i % 4 != 0, {"a": "1"}, {"email": 2, "ssn": 1}, i % 2 == 0, float(i))
            for i in range(40)]
    df = spark.createDataFrame(rows, RESULT)
    m = report.meets_thresholds(report.metrics(report.metric_inputs(df))).first()
    assert (m.total_documents, m.successful_documents, m.failed_documents) == (40, 30, 10)
    assert (m.workflow_success_rate, m.validator_pass_rate) == (0.75, 0.5)
    assert (m.fields_extracted, m.pii_total_detected, m.avg_latency_ms) == (40, 120, 19.5)
    assert (m.p50_latency_ms, m.p95_latency_ms, m.p99_latency_ms) == (20.0, 38.0, 39.0)
    assert (m.meets_workflow_success, m.meets_latency_p95, m.meets_pii_recall) == (False, True, None)


def test_metrics_of_nothing_are_zero(spark):
    m = report.metrics(report.metric_inputs(spark.createDataFrame([], RESULT))).first()
    assert (m.total_documents, m.workflow_success_rate, m.p95_latency_ms) == (0, 0.0, 0.0)


@pytest.mark.parametrize(
    ("values", "want"),
    [((0.92, 0.97, 0.93, 0.95, 3500.0), True), ((0.85, 0.90, 0.85, 0.80, 5000.0), False)],
)
def test_thresholds(spark, values, want):
    names = ("extraction_accuracy", "pii_recall", "pii_precision", "workflow_success_rate",
             "p95_latency_ms")
    df = spark.createDataFrame([values], ", ".join(f"{n} double" for n in names))
    got = report.meets_thresholds(df).first().asDict()
    assert {v for k, v in got.items() if k.startswith("meets_")} == {want}


def test_agent_report_and_summary(spark):
    rows = [("classifier", 10.0, 0.5, None), ("classifier", 20.0, None, "x"),
            ("redactor", 5.0, 1.0, "")]
    df = spark.createDataFrame(rows, DECISIONS).withColumn("session_id", F.lit("s"))
    by = {r.agent_type: r for r in report.agent_report(df).collect()}
    c = by["classifier"]
    assert (c.decisions, c.errors, c.error_rate, c.avg_confidence) == (2, 1, 0.5, 0.25)
    assert by["redactor"].errors == 0
    s = report.audit_summary(df).first()
    assert s.decisions_by_agent == {"classifier": 2, "redactor": 1}
    assert (s.total_duration_ms, s.error_count) == (35.0, 1)


def test_audit_copy_is_cut(spark):
    row = ("classifier", "A", None, "x" * 900, "y" * 500, None, None, 1.0, None, None, 0, None)
    df = spark.createDataFrame([row], DECISION[len("struct<"):-1])
    got = log_decisions(df).first()
    assert (len(got.input_summary), len(got.output_summary)) == (500, 500)


@pytest.mark.parametrize("seed", range(3))
def test_overlap_flags_match_brute_force(spark, seed):
    rnd = random.Random(seed)

    def some(n):
        out = []
        for _ in range(n):
            s = rnd.randint(0, 12000)
            out.append((1, "t", s, s + rnd.choice([0, 1, 3, 40, 5000])))
        return out + out[:5]

    left, right = some(120), some(25)
    schema = "doc_id long, pii_type string, start_index int, end_index int"
    got = evaluate.flag_overlaps(
        spark.createDataFrame(left, schema), spark.createDataFrame(right, schema),
        ("doc_id", "pii_type"),
    ).collect()
    want = model.overlapping({x[2:] for x in left}, {x[2:] for x in right})
    assert {(r.start_index, r.end_index) for r in got if r.overlapped} == want
    assert sum(r.n for r in got) == len(left)


def test_scores(spark):
    schema = "doc_id long, pii_type string, start_index int, end_index int"
    found = spark.createDataFrame([(1, "a", 0, 5), (1, "a", 20, 25), (2, "a", 0, 5)], schema)
    truth = spark.createDataFrame([(1, "a", 3, 9), (1, "b", 20, 25)], schema)
    s = evaluate.score_spans(found, truth).first()
    assert (s.true_positives, s.false_positives, s.false_negatives) == (1, 2, 1)
    assert (s.precision, s.recall) == (1 / 3, 0.5) and s.f1_score == pytest.approx(0.4)
    nothing = evaluate.score_spans(found.limit(0), truth.limit(0)).first()
    assert (nothing.precision, nothing.recall, nothing.f1_score) == (0.0, 0.0, 0.0)


def test_field_and_type_scores(spark):
    fields = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (1, "b", "y")],
                                   "doc_id long, name string, value string")
    truth = spark.createDataFrame([(1, "a", "x"), (1, "b", "z"), (2, "a", "x")],
                                  "doc_id long, name string, value string")
    r = evaluate.score_fields(fields, truth).first()
    assert (r.fields_total, r.fields_correct) == (3, 1)
    types = spark.createDataFrame([(1, "form"), (2, "memo")], "doc_id long, document_type string")
    want = spark.createDataFrame([(1, "form"), (2, "form")], "doc_id long, document_type string")
    assert evaluate.score_types(types, want).first().classifier_accuracy == 0.5


def test_catalogue(spark):
    types = {r.document_type: r for r in catalogue.type_table(spark).collect()}
    assert list(types) == DOCUMENT_TYPES
    assert types["invoice"].required_fields == "invoice_number, date, total_amount..."
    assert types["resume"].required_fields == "name, contact_info"
    assert types["letter"].required_fields == "-"
    kinds = {r.kind: r.n for r in catalogue.rule_table(spark).groupBy("kind")
             .agg(F.count("*").alias("n")).collect()}
    assert kinds == {"required": 23, "optional": 41, "pattern": 6}
