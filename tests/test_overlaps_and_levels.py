"""Overlap pairs against brute force, and metrics on several groupings."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators import overlaps, report

SPAN = "doc_id long, start_index int, end_index int, name string"


def pairs(spark, a, b, **options):
    got = overlaps.overlap_pairs(spark.createDataFrame(a, SPAN), spark.createDataFrame(b, SPAN), ("doc_id",), **options)
    return collections.Counter((r["doc_id"], *r["left"], *r["right"]) for r in got.collect())


def slow(a, b):
    return collections.Counter(
        (x[0], *x[1:], *y[1:])
        for x in a
        for y in b
        if None not in (x[0], x[1], x[2], y[0], y[1], y[2]) and x[0] == y[0] and not (x[2] <= y[1] or y[2] <= x[1])
    )


def drawn(draws, n, width, docs=3, long=40):
    out = []
    for k in range(n):
        start = draws.randrange(width)
        out.append((draws.randrange(docs), start, start + draws.randrange(-2, long), f"s{k % 50}"))
    return out


@pytest.mark.parametrize("widths, crowd", [((4096, 128, 4), 512), ((64, 16, 4), 5), ((64, 8), 3), ((16,), 2)])
def test_pairs_equal_brute_force(spark, widths, crowd):
    draws = random.Random(len(widths) * crowd)
    odd = [(None, 1, 5, "x"), (0, None, 5, "x"), (0, 1, None, "x"), (0, 0, 0, "empty"), (0, 5, 5, "inside"), (0, 9, 3, "turned"), (0, 4, 4000, "all"), (0, 4, 4000, "all")]
    a, b = drawn(draws, 150, 300) + odd, drawn(draws, 150, 300, long=9) + odd
    assert pairs(spark, a, b, widths=widths, crowd=crowd) == slow(a, b)
    assert pairs(spark, a, [], widths=widths, crowd=crowd) == collections.Counter()


def test_one_hot_document_is_spread(spark):
    """A document with all spans, a crowded place in it, and one place that holds hundreds of spans."""
    draws = random.Random(2)
    a = drawn(draws, 1200, 200_000, docs=1, long=12) + [(0, 777, 790, f"a{i}") for i in range(120)]
    b = drawn(draws, 1200, 200_000, docs=1, long=12) + [(0, 780, 795, f"b{i}") for i in range(120)]
    assert pairs(spark, a, b, crowd=32) == slow(a, b)
    left, right = (spark.createDataFrame(x, SPAN) for x in (a, b))
    got = overlaps.overlap_pairs(left, right, ("doc_id",), crowd=32)
    for name, value in (("adaptive.coalescePartitions.enabled", "false"), ("autoBroadcastJoinThreshold", "-1")):
        spark.conf.set(f"spark.sql.{name}", value)
    at = got.where("left.start_index = 777 AND right.start_index = 780").select(F.spark_partition_id().alias("p")).distinct().count()
    for name in ("adaptive.coalescePartitions.enabled", "autoBroadcastJoinThreshold"):
        spark.conf.unset(f"spark.sql.{name}")
    assert at > 1


def test_levels_equal_separate_groupings(spark):
    draws = random.Random(4)
    rows = [(draws.choice(["a", "b", None]), draws.choice(["x", None]), draws.random() < 0.5, True, k % 5, k % 3, draws.choice([None, float(k % 40)])) for k in range(600)]
    inputs = spark.createDataFrame(rows, "document_type string, lang string, success boolean, validation_passed boolean, n_fields int, n_pii int, processing_time_ms double")
    levels = (("document_type", "lang"), ("document_type",), ())
    got = report.metrics_by_levels(inputs, levels)
    found = {(r["level"], r["document_type"], r["lang"]): r.asDict() for r in got.collect()}
    assert len(found) == got.count() == 6 + 3 + 1  # the NULL groups and the total are told apart
    for level in levels:
        for r in report.metrics(inputs, level).collect():
            want = {k: v for k, v in r.asDict().items() if k not in ("extraction_accuracy", "pii_recall", "pii_precision")}
            mine = found[",".join(level), want.get("document_type"), want.get("lang")]
            assert {k: round(mine[k], 9) if isinstance(v, float) else mine[k] for k, v in want.items()} == {k: round(v, 9) if isinstance(v, float) else v for k, v in want.items()}
    assert report.metrics_by_levels(inputs.limit(0), levels).count() == 0
