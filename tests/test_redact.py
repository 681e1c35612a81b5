import random

import model
import pytest
from pyspark.sql import functions as F

from paperloom.functions.fixed_values import PII_MASKS
from paperloom.functions.spans import SPAN, may_hold_pii
from paperloom.operators import redact

INVOICE = """
    INVOICE
    Invoice Number: INV-2024-001234
    Date: 2024-11-15

    Bill To:
    John Smith
    Email: john.smith@email.com
    Phone: (555) 123-4567

    Total: $2,495.50

    SSN: 123-45-6789
    Credit Card: 4532-1234-5678-9012
    """


def run(spark, texts, mode="compat"):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = redact.redact(df, mode=mode).orderBy("doc_id").collect()
    return [(r.redacted_text, {k: v for k, v in r.pii_by_type.items()}) for r in rows]


def test_one_of_each(spark):
    texts = [
        "Contact me at test@example.com for details.",
        "SSN: 123-45-6789",
        "Card: 4532-1234-5678-9012",
        "This text contains no personal information.",
        "",
        "DOB: 01/02/1990, Born March 15, 1990",
        "ssn on file 123456789 for social security",
        "123456789\nssn",
    ]
    got = run(spark, texts)
    assert got[0] == ("Contact me at [EMAIL REDACTED] for details.", {"email": 1})
    assert got[1][0] == "SSN: ***-**-****"
    assert "****-****-****-****" in got[2][0]
    assert got[3] == (texts[3], {})
    assert got[4] == ("", {})
    assert got[5] == ("DOB: [DOB REDACTED], Born [DOB REDACTED]", {"date_of_birth": 2})
    assert got[6][1] == {"ssn": 1}
    assert got[7][1] == {}  # the word has to follow on the same line


def test_known_artefacts_of_compat_and_their_clean_form(spark):
    texts = [
        "Call us at (555) 123-4567 or 555-987-6543.",
        "Passport: AB1234567",
        "1234567812345678",
        "Bank Account: 1234567890",
    ]
    assert run(spark, texts) == [
        ("Call us at ([PHONE REDACTED]EDACTED] or [PHONE REDACTED]EDACTED].", {"phone": 4}),
        ("Passport: [DL REDACTED] REDACTED]", {"passport": 1, "drivers_license": 1}),
        ("****-****-****-*******", {"credit_card": 2}),
        ("Bank Account: [PHONE REDACTED]", {"phone": 1}),
    ]
    assert run(spark, texts, "clean") == [
        ("Call us at ([PHONE REDACTED] or [PHONE REDACTED].", {"phone": 2}),
        ("Passport: [PASSPORT REDACTED]", {"passport": 1}),
        ("****-****-****-****", {"credit_card": 1}),
        ("Bank Account: [PHONE REDACTED]", {"phone": 1}),
    ]


def test_long_text_and_invoice(spark):
    got = run(spark, ["Contact: test@email.com. " * 500, INVOICE])
    assert got[0][1] == {"email": 500}
    assert "test@email.com" not in got[0][0]
    assert len(got[1][1]) >= 2 and "john.smith@email.com" not in got[1][0]


def test_null_text_is_empty(spark):
    df = spark.createDataFrame([(1, None)], "doc_id long, text string")
    row = redact.redact(df).first()
    assert (row.redacted_text, row.total_pii_found) == ("", 0)


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        redact.redact(spark.createDataFrame([(1, "x")], "doc_id long, text string"), mode="x")


PARTS = [
    "123-45-6789", "123 45 6789", "123456789", " social ", "ssn", "a.b@c.org", "x|y@d.e|f",
    "(555) 123-4567", "555-123-4567", "+1 555 123 4567", "5551234567", "123-4567", "1+1-555-123-4567",
    "4532-1234-5678-9012", "4532123456789012", "10.0.0.1", "999.1.22.333", "DOB: 1/2/1990",
    "Born March 5, 1990", "Birthday 12-12-12", "AB1234567", "c12345678", "\n", " ", ". ", ",", "é",
    "٣٤٥-٦٧٨٩", "日本", "word", "1", "22", "@", "[", "]", "*",
]


def texts_for(seed, n):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 14))) for _ in range(n)]


def test_matches_the_model_on_random_texts(spark):
    texts = texts_for(1, 600)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = (
        redact.detect(redact.redact(df)).select(
            "doc_id", "pii_spans", "redacted_text", "pii_entities",
            F.expr(may_hold_pii("text")).alias("gate"),
        )
    ).collect()

    def plain(spans):
        return [
            (s.pii_type, s.original_value, s.start_index, s.end_index, s.confidence) for s in spans
        ]

    for r in rows:
        text = texts[r.doc_id]
        found = model.find(text)
        assert r.gate or not found, text
        assert plain(r.pii_spans) == found, text
        want, kept = model.mask(text, sorted(found, key=lambda s: s[2]))
        assert (r.redacted_text, plain(r.pii_entities)) == (want, kept), text


@pytest.mark.parametrize("mode", ["compat", "clean"])
def test_merging_matches_the_model(spark, mode):
    rnd = random.Random(7)
    texts = texts_for(2, 300)
    rows, modelled = [], []
    for i, text in enumerate(texts):
        spans = []
        for _ in range(rnd.randint(0, 5)):
            s = rnd.randint(0, len(text) + 3)
            e = s + rnd.randint(0, 9)
            value = text[s:e] if rnd.random() < 0.8 else rnd.choice(["", "zz", "1"])
            conf = rnd.choice([0.1, 0.8, 0.9, 0.95])
            spans.append((rnd.choice(list(PII_MASKS)), value, s, e, conf))
        modelled.append(spans)
        rows.append((i, text, [(k, v, PII_MASKS[k], s, e, c) for k, v, s, e, c in spans]))
    df = spark.createDataFrame(rows, f"doc_id long, text string, extra array<{SPAN}>")
    got = redact.redact(df, model_spans="extra", mode=mode).collect()
    for r in got:
        text = texts[r.doc_id]
        merged = model.merge(model.find(text), modelled[r.doc_id])
        if mode == "compat":
            want, kept = model.mask(text, merged)
        else:
            want, kept = model.clean(text, merged)
        assert r.redacted_text == want, (text, modelled[r.doc_id])
        assert [(s.pii_type, s.original_value) for s in r.pii_entities] == [k[:2] for k in kept]


def test_context_is_clipped(spark):
    df = spark.createDataFrame([(1, "ab a@b.com")], "doc_id long, text string")
    assert redact.spans_with_context(df).first().context == "ab a@b.com"


def test_detection_runs_once_per_row(spark):
    """No filter or second projection repeats the scan of the text."""
    df = spark.createDataFrame([(1, "a@b.com")], "doc_id long, text string")
    for out in (redact.span_rows(redact.detect(df), "pii_spans"), redact.redact(df)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(r"regexp_extract_all(coalesce(text") == 12 + 2 * 2


@pytest.mark.parametrize("mode", ["compat", "clean"])
def test_texts_full_of_spans_match_the_model(spark, mode):
    unique = " ".join(f"é t{i}@email.com at {i % 256}.1.2.{i % 200} {'x' * (i % 70)}" for i in range(400))
    repeated = "a@b.com (555) 123-4567\n" * 150
    texts = [unique, repeated, unique[:4096], "é" * 4096 + "a@b.com", "x" * 4090 + " a@b.com " + "y" * 9000]
    for text, (got, counts) in zip(texts, run(spark, texts, mode), strict=True):
        found = sorted(model.find(text), key=lambda s: s[2])
        want, kept = model.mask(text, found) if mode == "compat" else model.clean(text, found)
        assert got == want and sum(counts.values()) == len(kept)
