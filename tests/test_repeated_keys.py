"""JSON objects that repeat keys, without any setting of the session."""

import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from paperloom.functions import replies as R
from paperloom.operators import replies

REPLIES = "doc_id int, stage string, attempt int, reply string, error string"
TEXTS = [
    '{"a":1,"a":2}', '{"a":1}', '{"a": {"b":1,"b":[{"c":1,"c":"x\\"y\\\\"}]}, "z":[1,2,{"q":1}], "a":3}',
    '{"a":1,"\\u0061":2}', '{"a":nope,"a":2}', '{"a":1,"a":2}"', '{"a":1 2,"a":2}', '{"a":{"b":1,"b":2},"c":{"b":1}}',
    '[{"a":1,"a":2}]', '{"a\\\\":1,"a\\\\":"\\\\"}', '{"a":1,"a":2,}', '{"a":"x, y: {","a":"]}"}',
    '{"a":1,"a":2} x', "{}", "", None, '{"a":{"x":1},"a":{"x":2,"x":{"k":1,"k":[]}}}',
    '{"s":"' + "\\n" * 20_000 + '","s":1}', '{"s":' + '[' * 50 + '{"t":1,"t":2}' + ']' * 50 + "}",
]


def read(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.selectExpr("i", f"{R.parsed('t')} IS NOT NULL AS whole", f"{R.single_keys('t')} AS once").collect()
    return {r.i: (texts[r.i] if r.whole else r.once) for r in rows}


def expected(text):
    try:
        value = json.loads(text)
    except (TypeError, ValueError):
        return None
    return value if isinstance(value, dict) else None


def test_the_last_member_of_a_key_counts(spark):
    for i, once in read(spark, TEXTS).items():
        assert (None if once is None else json.loads(once)) == expected(TEXTS[i]), TEXTS[i]
        if once is not None:
            json.loads(once, object_pairs_hook=lambda pairs: [1 / (len(dict(pairs)) == len(pairs))])


def written(value):
    if isinstance(value, list) and value and isinstance(value[0], tuple):
        return "{" + ", ".join(json.dumps(k) + ":" + written(v) for k, v in value) + "}"
    return "[" + ",".join(map(written, value)) + "]" if isinstance(value, list) else json.dumps(value)


LEAF = st.one_of(st.integers(-9, 9), st.booleans(), st.none(), st.text('ab"\\\\{}[],: \n', max_size=6))
KEY = st.sampled_from(["a", "b", 'q"', "\\"])
VALUE = st.recursive(LEAF, lambda x: st.one_of(st.lists(x, max_size=3), st.lists(st.tuples(KEY, x), min_size=1, max_size=4)), max_leaves=12)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.tuples(KEY, VALUE), min_size=1, max_size=5), min_size=30, max_size=60))
def test_drawn_objects(spark, drawn):
    texts = [written(x) for x in drawn]
    for i, once in read(spark, texts).items():
        assert once is not None and json.loads(once) == json.loads(texts[i])


def test_replies_and_corrections(spark):
    rows = [
        (1, "classify", 1, '{"document_type": "letter", "document_type": "invoice", "confidence": 0.9}', None),
        (1, "extract", 1, '{"structured_data": {"q": "0"}, "fields": [], "structured_data": {"x": "1", "y": "2", "x": "3"}}', None),
        (1, "repair", 1, '```json\n{"corrected_fields": {"b": "1", "a": "2", "b": "3"}}\n```', None),
        (1, "repair", 2, '{"corrected_fields": {"b": oops, "b": "3"}}', None),
    ]
    gathered = replies.gather(spark.createDataFrame(rows, REPLIES))
    got = replies.read_repairs(replies.read_extraction(replies.read_classification(gathered))).first()
    assert (got.document_type, got.classify_error, got.extract_error) == ("invoice", None, None)
    assert got.structured_data == {"x": "3", "y": "2"}
    assert [f and f.data for f in got.fixes][:2] == [{"b": "3", "a": "2"}, None]
