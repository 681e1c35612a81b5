import json

import pytest
from pyspark.sql import functions as F

from paperloom.functions import basics
from paperloom.functions import replies as R
from paperloom.operators import replies, requests

SCHEMA = "doc_id long, stage string, attempt int, reply string, error string"


def read(spark, stage, reply, error=None):
    df = spark.createDataFrame([(1, stage, 1, reply, error)], SCHEMA)
    gathered = replies.gather(df)
    step = {
        "classify": replies.read_classification,
        "extract": replies.read_extraction,
        "detect_pii": replies.read_detection,
        "repair": replies.read_repairs,
    }[stage]
    out = step(gathered)
    if stage == "extract":  # a collected map has no order
        out = out.withColumn("in_order", F.map_keys("structured_data"))
    return out.first()


@pytest.mark.parametrize(
    ("reply", "want"),
    [
        ('{"a": 1}', '{"a": 1}'),
        ('x ```json\n{"a": 1}\n``` y', '{"a": 1}'),
        ('x ```\n{"a": 1}``` y ```z```', '{"a": 1}'),
        ('```json{"a": 1}!', '{"a": 1}'),
        ('{"outputs": [{"text": "t"}]}', "t"),
        ('{"choices": [{"message": {"content": "c"}}]}', "c"),
        ('{"content": [{"text": "t"}]}', "t"),
        ('{"content": "c"}', "c"),
        ('{"\\u0063ontent": "c"}', "c"),
        ("plain", "plain"),
    ],
)
def test_payload(spark, reply, want):
    df = spark.createDataFrame([(reply,)], "r string")
    assert df.select(F.expr(R.payload("r"))).first()[0] == want


@pytest.mark.parametrize(
    ("payload", "ok"),
    [('{"a": 1}', True), ('{"a": 1} x', False), ("[1]", False), ("", False), ('{"a":', False),
     ('{"a": 1},{"b": 2}', False), ('{"a": 1}] [', False)],
)
def test_only_whole_objects_parse(spark, payload, ok):
    df = spark.createDataFrame([(payload,)], "p string")
    assert df.select(F.expr(R.parsed("p") + " IS NOT NULL")).first()[0] is ok


@pytest.mark.parametrize("x", [0.0, 1.0, -2.5, 100.0, 12345678.9, 1e7, 1e15, 1e16, 1.5e20, 5e-4,
                               1e-4, 1e-5, 1.25e-7, 123456789012.34, 0.1, 1e100, 2e-100])
def test_float_text_is_pythons(spark, x):
    df = spark.createDataFrame([(x,)], "x double")
    assert df.select(F.expr(basics.float_text("x"))).first()[0] == str(x)


@pytest.mark.parametrize("text", ["1", " 1.5 ", "1e5", "1d", "1_000", "_1", "1__0", "inf", "-Infinity",
                                  "nan", "", "abc", ".5", "5.", ".", "0x10", "+3", "1,000", "1e", "٣"])
def test_float_of_text_is_pythons(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(F.expr(basics.reads_as_float("t"))).first()[0]
    try:
        float(text)
        want = True
    except ValueError:
        want = False
    assert got is want


@pytest.mark.parametrize("x", [0.125, 0.005, 0.015, 0.375, 0.5, 1.0, 0.999, 2.675, 1234.567])
def test_fixed_point_is_pythons(spark, x):
    df = spark.createDataFrame([(x,)], "x double")
    assert df.select(F.expr(basics.fixed_point("x", 2))).first()[0] == f"{x:.2f}"


@pytest.mark.parametrize(
    ("reply", "error", "want"),
    [
        ('{"document_type": "Invoice", "confidence": 0.9, "reasoning": "r"}', None,
         ("invoice", 0.9, "r", None)),
        ('{"document_type": "memo"}', None, ("unknown", 0.5, "No reasoning provided", None)),
        ("{}", None, ("unknown", 0.5, "No reasoning provided", None)),
        ('{"document_type": "form", "confidence": "0.25"}', None,
         ("form", 0.25, "No reasoning provided", None)),
        ('{"document_type": "form", "confidence": 7}', None,
         ("form", 7.0, "No reasoning provided", None)),
        ('{"document_type": 3}', None, ("unknown", 0.0, None,
                                        "Classification failed: unusable reply")),
        ('{"document_type": "form", "confidence": "high"}', None,
         ("unknown", 0.0, None, "Classification failed: unusable reply")),
        ("not json", None, ("unknown", 0.0, None,
                            "Classification failed: Invalid JSON in response")),
        (None, "timed out", ("unknown", 0.0, None, "Classification failed: timed out")),
    ],
)
def test_classification(spark, reply, error, want):
    r = read(spark, "classify", reply, error)
    assert (r.document_type, r.classification_confidence, r.reasoning, r.classify_error) == want


def test_extraction_defaults_and_skips(spark):
    r = read(spark, "extract", json.dumps({"fields": [{"name": "a", "value": 1.50, "confidence": "0.5"},
                                                      "junk", {"value": True}, {}]}))
    assert [tuple(f) for f in r.fields] == [
        ("a", "1.5", 0.5, "string"), ("unknown", "True", 0.5, "string"),
        ("unknown", "", 0.5, "string"),
    ]
    assert r.structured_data == {"a": "1.5", "unknown": ""}
    assert r.extract_error is None and r.avg_confidence == 0.5


def test_extraction_own_data_keeps_written_order_and_types(spark):
    r = read(spark, "extract", '{"structured_data": {"z": "s", "a": 0, "m": [], "b": null, "f": false}}')
    assert r.in_order == ["z", "a", "m", "b", "f"]
    assert r.structured_data == {"z": "s", "a": "0", "m": "[]", "b": None, "f": "False"}
    assert sorted(r.untruthy) == ["a", "f", "m"] and r.fields == []


@pytest.mark.parametrize(
    "reply",
    ['{"fields": [{"name": "a", "confidence": 1.5}]}', '{"fields": [{"name": "a", "confidence": null}]}',
     '{"fields": [{"name": null}]}', '{"fields": null}', '{"fields": 3}', '{"structured_data": null}',
     '{"structured_data": "x"}', "[]"],
)
def test_one_bad_part_fails_the_extraction(spark, reply):
    r = read(spark, "extract", reply)
    assert r.fields == [] and r.structured_data == {} and r.extract_error is not None


def test_detection(spark):
    r = read(spark, "detect_pii", json.dumps({"pii_entities": [
        {"type": "Full Name", "value": "Ann"},
        {"type": "social security number", "value": "1", "confidence": 9},
        {"type": "DOB", "value": "x", "start": 2, "end": 9, "confidence": 0.3}, "junk"]}))
    got = [(s.pii_type, s.original_value, s.start_index, s.end_index, s.confidence)
           for s in r.model_spans]
    assert got == [("name", "Ann", 0, 3, 0.8), ("date_of_birth", "x", 2, 9, 0.3)]


@pytest.mark.parametrize("bad", [{"confidence": 1.2}, {"confidence": "x"}, {"value": 3}, {"start": "a"},
                                 {"start": 1.5}, {"end": None}, {"type": 4}])
def test_one_bad_span_empties_the_list(spark, bad):
    good = {"type": "name", "value": "Ann", "start": 0, "end": 3, "confidence": 0.9}
    reply = json.dumps({"pii_entities": [good, {**good, **bad}]})
    assert read(spark, "detect_pii", reply).model_spans == []


def test_repairs(spark):
    fix = read(spark, "repair", '{"corrected_fields": {"date": "2024-01-02", "a": 0}}').fixes[0]
    assert fix.data == {"date": "2024-01-02", "a": "0"} and fix.untruthy == ["a"]
    assert read(spark, "repair", "{}").fixes[0].data == {}
    assert read(spark, "repair", "oops").fixes[0] is None


def test_gather_keeps_the_last_attempt_and_one_row_per_document(spark):
    rows = [(1, "classify", 1, "old", None), (1, "classify", 2, "new", None),
            (2, "repair", 3, "third", None)] + [(1, "extract", 1, "same", None)] * 50
    got = {r.doc_id: r for r in replies.gather(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1].classify.reply == "new" and got[1].extract.reply == "same"
    assert [a and a.reply for a in got[2].repairs] == [None, None, "third"]


def test_requests_hold_whole_texts(spark):
    df = spark.createDataFrame([(1, "x" * 16000 + "y", "invoice"), (2, "", "memo"), (3, None, "memo")],
                               "doc_id long, text string, document_type string")
    classify = requests.classification_requests(df).where("doc_id = 1").collect()
    assert len(classify) == 1 and classify[0].request.endswith("x" * 16000 + "y")
    extract = {r.doc_id: r.request for r in requests.extraction_requests(df).collect()}
    assert extract[1].endswith("x" * 16000 + "y") and "due_date" in extract[1] and len(extract) == 3
    detect = requests.detection_requests(df).collect()
    assert [r.doc_id for r in detect] == [1] and detect[0].request.endswith("\n" + "x" * 16000 + "y")


def test_request_windows_join_up_to_the_text(spark):
    text = "".join(chr(97 + i % 26) for i in range(2001))
    df = spark.createDataFrame([(1, text), (2, "short"), (3, "z" * 500)], "doc_id long, text string")
    found = {}
    for r in sorted(requests.detection_requests(df, limit=500).collect(), key=lambda r: (r.doc_id, r.part)):
        piece = r.request.split("\n\n", 1)[1]
        assert r.offset == len(found.get(r.doc_id, "")) == r.part * 500
        found[r.doc_id] = found.get(r.doc_id, "") + piece
    assert found == {1: text, 2: "short", 3: "z" * 500}
