"""Windows that overlap: a value across a cut is seen whole, and counted once."""

import pytest
from paperloom.operators import replies, requests


def test_a_value_across_a_cut_lies_whole_in_a_window(spark):
    value = "jane.roe@example.org"
    texts = [(i, "x" * (500 - i) + " " + value + " " + "y" * 900) for i in range(len(value) + 1)] + [(99, "short")]
    df = spark.createDataFrame(texts, "doc_id int, text string")
    whole = {r.doc_id for r in requests.detection_requests(df, limit=500).collect() if value in r.request}
    assert len(whole) < 5
    found = requests.detection_requests(df, limit=500, overlap=len(value)).collect()
    assert {r.doc_id for r in found if value in r.request} == set(range(len(value) + 1))
    head = len(next(r for r in found if r.doc_id == 99).request) - len("short")
    for i, text in texts:
        mine = sorted((r.offset, r.request[head:]) for r in found if r.doc_id == i)
        assert all(text[at : at + 500] == piece for at, piece in mine) and mine[-1][0] + len(mine[-1][1]) == len(text)
    with pytest.raises(ValueError):
        requests.detection_requests(df, limit=500, overlap=500)


def test_a_span_of_two_windows_counts_once(spark):
    def reply(*spans):
        made = ['{"type": "%s", "value": "a", "start": %d, "end": %d, "confidence": %s}' % s for s in spans]
        return '{"pii_entities": [%s]}' % ", ".join(made)

    rows = [
        (1, 0, 1, reply(("email", 485, 495, 0.5), ("email", 2, 9, 0.9)), None),
        (1, 480, 1, reply(("email", 5, 15, 0.8), ("phone", 5, 15, 0.7)), None),
        (2, 0, 1, reply(), None),
    ]
    df = spark.createDataFrame(rows, "doc_id int, offset int, attempt int, reply string, error string")
    got = {r.doc_id: [(s.pii_type, s.start_index, s.end_index, s.confidence) for s in r.model_spans] for r in replies.window_detections(df).collect()}
    assert got == {1: [("email", 485, 495, 0.8), ("email", 2, 9, 0.9), ("phone", 485, 495, 0.7)], 2: []}
