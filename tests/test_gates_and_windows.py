"""Pattern gates, long span lists, two-way comparison, windows and repeated keys."""

import random

import model
from pyspark.sql import functions as F

from paperloom.functions.basics import let
from paperloom.functions.spans import pattern_spans
from paperloom.operators import evaluate, redact, replies

REPLIES = "doc_id long, stage string, attempt int, reply string, error string"


def found(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    rows = df.select("id", F.expr(pattern_spans("text")).alias("s")).orderBy("id").collect()
    return [[(s.pii_type, s.original_value, s.start_index, s.end_index, s.confidence) for s in r.s] for r in rows]


def test_gates_let_every_match_through(spark):
    rnd = random.Random(11)
    parts = [
        "123-45-6789", "987 65 4321", "123456789", " ſocial ", " SECURITY ", " sSn ", "(555) 123-4567", "555.123.4567",
        "+1 555 123 4567", "555-1234", "5551234567", "4111-1111 1111-1111", "4111111111111111", "10.0.0.1", "a.b@c.de",
        "DOB: 1/2/1990", "Born March 5, 1988", "Bırthday 03-04-85", "BİRTHDAY: 1-2-1999", "AB1234567", "d123456",
        "12345", "x", " ", "\n", "-", ".", "١٢٣-٤٥-٦٧٨٩",
    ]
    texts = ["".join(rnd.choice(["", " "]) + rnd.choice(parts) for _ in range(rnd.randint(1, 7))) for _ in range(600)]
    texts += parts
    # Python folds neither letter to i without a dot; those texts are only looked at by Spark.
    odd = [t for t in texts if "ı" in t or "İ" in t]
    texts = [t for t in texts if t not in odd]
    for text, got in zip(texts, found(spark, texts), strict=True):
        assert got == model.find(text), repr(text)
    ungated = [[s for s in spans if s[0] == "date_of_birth"] for spans in found(spark, ["Bırthday 03-04-85", "BİRTHDAY: 1-2-1999"])]
    plain = r"'(?iUd)\\b(?:Birthday)[:\\s]*(\\d{1,2}[-/]\\d{1,2}[-/]\\d{2,4})\\b'"
    for spans, text in zip(ungated, ["Bırthday 03-04-85", "BİRTHDAY: 1-2-1999"], strict=True):
        assert bool(spans) == spark.sql(f"SELECT '{text}' RLIKE {plain}").first()[0]


def test_clean_masks_many_overlapping_spans(spark):
    rnd = random.Random(5)
    texts = []
    for n in (63, 64, 65, 128, 129, 700):
        texts.append(" ".join(rnd.choice(["4111111111111111", "+1 555-123-4567", "a@b.cd", "AB1234567"]) for _ in range(n)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in redact.redact(df, mode="clean").collect():
        text, kept = model.clean(texts[r.doc_id], model.find(texts[r.doc_id]))
        assert (r.redacted_text, r.total_pii_found) == (text, len(kept))


def test_both_directions_in_one_pass(spark):
    rnd = random.Random(2)

    def spans(n):
        out = []
        for _ in range(n):
            start = rnd.randint(0, 20000)
            out.append((rnd.randint(0, 2), start, start + rnd.choice([1, 5, 60, 9000])))
        return out + out[: n // 5]

    left, right = spans(60), spans(40)
    schema = "doc_id int, start_index int, end_index int"
    got = evaluate.compare_spans(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["doc_id"])
    seen = {(r.is_true, r.doc_id, r.start_index, r.end_index): (r.n, r.overlapped) for r in got.collect()}
    for is_true, mine, others in ((False, left, right), (True, right, left)):
        for s in mine:
            hit = any(o[0] == s[0] and o[1] < s[2] and s[1] < o[2] for o in others)
            assert seen[(is_true, *s)] == (mine.count(s), hit)
    assert len(seen) == len(set(left)) + len(set(right))
    empty = spark.createDataFrame([], schema)
    assert {r.overlapped for r in evaluate.compare_spans(empty, spark.createDataFrame(right, schema), ["doc_id"]).collect()} == {False}


def test_window_replies_move_to_their_place(spark):
    span = '{"pii_entities": [{"type": "email", "value": "a", "start": %d, "end": %d, "confidence": 0.9}]}'
    rows = [
        (1, 8000, 1, span % (5, 6), None), (1, 0, 1, span % (7, 8), None), (1, 0, 2, span % (3, 4), None),
        (2, 0, 1, "{", None), (3, 0, 1, None, "timed out"),
    ]
    df = spark.createDataFrame(rows, "doc_id int, offset int, attempt int, reply string, error string")
    got = {r.doc_id: [(s.start_index, s.end_index) for s in r.model_spans] for r in replies.window_detections(df).collect()}
    assert got == {1: [(3, 4), (8005, 8006)], 2: [], 3: []}


def test_a_repeated_key_keeps_its_last_value(spark):
    name = "spark.sql.variant.allowDuplicateKeys"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        rows = [
            (1, "classify", 1, '{"document_type": "letter", "document_type": "invoice", "confidence": 0.9}', None),
            (1, "extract", 1, '{"fields": [], "structured_data": {"x": "1", "y": "2", "x": "3"}}', None),
        ]
        gathered = replies.gather(spark.createDataFrame(rows, REPLIES))
        got = replies.read_extraction(replies.read_classification(gathered)).first()
        assert (got.document_type, got.classify_error, got.extract_error) == ("invoice", None, None)
        assert got.structured_data == {"x": "3", "y": "2"}
    finally:
        spark.conf.set(name, before)


def test_let_evaluates_once(spark):
    assert spark.sql(f"SELECT {let('v', '1 + 1', 'v * v')} AS x").first().x == 4
