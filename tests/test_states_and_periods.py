"""Quantile states, periods in force, and running totals against brute force."""

import datetime as dt
import random

import pytest

from paperloom.operators import periods, quantile_states
from paperloom.sources import commits, sinks

FRACTIONS = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
T0 = dt.datetime(2024, 1, 1)


def off(values, x, fraction):
    """Places between the wanted element and the nearest element equal to x."""
    values = sorted(values)
    at = len(values) // 2 if fraction == 0.5 else int(len(values) * fraction)
    lo, hi = sum(v < x for v in values), sum(v <= x for v in values)
    assert hi > lo  # the answer is one of the values
    return max(0, lo - at, at - hi + 1)


@pytest.mark.parametrize("points", [4, 16, 100])
def test_merged_days_stay_within_the_bound(spark, points):
    draws = random.Random(points)
    rows = []
    for day in range(9):
        for _ in range(draws.randrange(1, 400)):
            rows.append((day, draws.choice(["a", None]), draws.choice([draws.lognormvariate(0, 2), float(draws.randrange(20)), None])))
    df = spark.createDataFrame(rows, "day int, g string, x double")
    states = quantile_states.quantile_state(df, "x", ("day", "g"), points).cache()
    assert states.groupBy("day", "g").count().agg({"count": "max"}).first()[0] <= points
    for kept, merges in ((states, 0), (quantile_states.merged_state(states, ("g",), points), 1)):
        got = quantile_states.state_quantiles(kept, ("g",))
        errors = {r["g"]: r.asDict() for r in quantile_states.rank_errors(df, "x", got, ("g",)).collect()}
        for r in got.collect():
            xs = [x for _, g, x in rows if g == r["g"] and x is not None]
            assert r["n"] == len(xs)
            for name, f in FRACTIONS.items():
                assert off(xs, r[name], f) == errors[r["g"]][f"{name}_off"] <= (1 + merges) * len(xs) / points
    whole = quantile_states.state_quantiles(states).first()
    xs = [x for *_, x in rows if x is not None]
    assert all(off(xs, whole[name], f) <= len(xs) / points for name, f in FRACTIONS.items())


def test_states_of_few_equal_and_no_values(spark):
    df = spark.createDataFrame([(1, 5.0)] * 1000 + [(2, 1.0), (2, 2.0), (3, None)], "g int, x double")
    got = {(r["g"], r["point"], r["weight"]) for r in quantile_states.quantile_state(df, "x", ("g",), 8).collect()}
    assert got == {(1, 5.0, 1000), (2, 1.0, 1), (2, 2.0, 1)}
    assert quantile_states.quantile_state(df.limit(0), "x", ("g",)).count() == 0


def slow_period(told, at, agent):
    """Of the periods of an agent the last started counts, if it has not ended."""
    far = dt.datetime.max
    mine = [p for p in told if p[0] == agent and p[1] is not None and at is not None and p[1] <= at]
    if not mine:
        return None
    best = max(mine, key=lambda p: (p[1], p[2] or far, p[3] or ""))
    return best[3] if at < (best[2] or far) else None


@pytest.mark.parametrize("span, crowd", [(86_400, 1_000_000), (3600, 3), (7, 1)])
def test_periods_equal_brute_force(spark, span, crowd):
    draws = random.Random(span)
    told = []
    for _ in range(60):
        start = T0 + dt.timedelta(minutes=draws.randrange(0, 3000, 30))
        end = draws.choice([None, start + dt.timedelta(minutes=draws.randrange(0, 400, 10))])
        told.append((draws.choice(["a", "b", None]), draws.choice([start, start, start, None]), end, f"p{draws.randrange(40)}"))
    rows = [(k, draws.choice(["a", "b", "c", None]), draws.choice([T0 + dt.timedelta(minutes=draws.randrange(-200, 5000)), None] if k % 9 == 0 else [T0 + dt.timedelta(minutes=draws.randrange(0, 3100, 10))]), "x") for k in range(400)]
    rows += [(1000 + k, "a", T0 + dt.timedelta(minutes=600), "x") for k in range(50)] + rows[:3]
    left = spark.createDataFrame(rows, "doc_id long, agent_type string, timestamp timestamp, name string")
    right = spark.createDataFrame(told, "agent_type string, start_at timestamp, end_at timestamp, name string")
    got = periods.period_at(left, right, ("agent_type",), span=span, crowd=crowd)
    found = sorted(((r["doc_id"], r["period"] and r["period"]["name"]) for r in got.collect()), key=repr)
    assert found == sorted(((k, slow_period(told, at, agent)) for k, agent, at, _ in rows), key=repr)
    assert got.columns == [*left.columns, "period"]
    none = periods.period_at(left, right.limit(0), ("agent_type",), span=span, crowd=crowd)
    assert none.count() == len(rows) and none.where("period IS NOT NULL").count() == 0
    assert periods.period_at(left.limit(0), right, ("agent_type",)).count() == 0


def test_totals_follow_the_appends(spark, tmp_path):
    path = str(tmp_path / "audit")
    schema = "doc_id long, session_id string, agent_type string, duration_ms double, error_message string, confidence double"
    rows = [(i, f"s{i % 3}", "ab"[i % 2], None if i % 5 == 0 else float(i), "failed" if i % 4 == 0 else ("" if i % 4 == 1 else None), None if i % 7 == 0 else 0.5) for i in range(90)]
    df = spark.createDataFrame(rows, schema)
    for batch in (0, 1, 2, 1):
        part = df.where(f"doc_id % 3 = {batch}") if batch else df.where("doc_id % 3 = 0")
        if batch == 2:  # a job that died after the decisions were committed and before their sums
            sinks.append_decisions(part, path, None, "2")
        sinks.append_with_totals(part, path, str(batch))
        seen = commits.read_table(spark, path).collect()
        want = {}
        for r in seen:
            want.setdefault((r["session_id"], r["agent_type"]), []).append(r)
        got = {(r["session_id"], r["agent_type"]): r for r in sinks.running_totals(spark, path).collect()}
        assert set(got) == set(want)
        for key, mine in want.items():
            times = [r["duration_ms"] for r in mine if r["duration_ms"] is not None]
            assert got[key]["decisions"] == len(mine) and got[key]["errors"] == sum(r["error_message"] == "failed" for r in mine)
            assert got[key]["total_duration_ms"] == pytest.approx(sum(times)) and got[key]["avg_duration_ms"] == pytest.approx(sum(times) / len(times))
            assert got[key]["avg_confidence"] == pytest.approx(sum(r["confidence"] or 0 for r in mine) / len(mine))
    read = sinks.running_totals(spark, path).inputFiles()
    assert read and all("/audit/totals/" in f for f in read)
