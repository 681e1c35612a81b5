"""Exact percentiles of huge, skewed groups (M4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.functions.fixed_values import PERCENTILES
from paperloom.sources.sinks import settle

#: A sketch cuts the line of values into 2 ** _HALVINGS bins.
_HALVINGS = 7
_ACCURACY = 2000


def _index(n: Column, fraction: float) -> Column:
    if fraction == 0.5:
        return F.floor(n / 2)
    return F.floor(n.cast("double") * fraction)


def exact_percentiles(
    df: DataFrame,
    value: str,
    by: Sequence[str] = (),
    fractions: dict[str, float] = PERCENTILES,
    weight: str | None = None,
) -> DataFrame:
    """Element ``int(n*f)`` of each group's sorted values, one column per fraction.

    Equal values are counted together first and written to the checkpoint folder; that is the
    one shuffle of all rows, by group and value. Twice, the line of values is then cut into bins, and only the bins
    that hold a wanted element go on, so what is ranked at last is about a ten-thousandth of
    the values, whatever share of the rows a group has. The cuts decide the cost, never
    the result. NULL values do not count; NULL is a group like any other. A row stands for
    ``weight`` equal ones where that column is given.
    """
    keys = list(by) or ["_all"]
    rows = (df if by else df.withColumn("_all", F.lit(0))).select(
        *keys, F.col(value).cast("double").alias("_x"), (F.col(weight) if weight else F.lit(1)).alias("_w")
    )
    counted = rows.where("_x IS NOT NULL").groupBy(*keys, "_x").agg(F.sum("_w").alias("_c"))
    values = settle(counted)  # read by the cuts, the sums and the join of both rounds
    places = [
        F.struct(F.lit(name).alias("name"), _index(F.col("_n"), f).alias("at"))
        for name, f in fractions.items()
    ]
    given = F.struct(F.col("_name").alias("name"), F.col("_at").alias("at"))
    found = settle(_narrow(values, keys, F.explode(F.array(*places)), keys))
    found = _narrow(found, [*keys, "_name", "_at"], given, keys)
    upto = F.sum("_c").over(W.partitionBy(*keys, "_name").orderBy("_x"))
    return (
        found.withColumn("_upto", upto)
        .where("_upto > _at")
        .groupBy(*keys)
        .agg(*[F.min(F.when(F.col("_name") == n, F.col("_x"))).alias(n) for n in fractions])
        .select(*by, *fractions)
    )


def _narrow(values: DataFrame, keys: list[str], target: Column, kept: list[str]) -> DataFrame:
    """The values in the bins that hold a target, each with its ``_name`` and its place
    ``_at`` among the values of its bin. ``target`` may use the size ``_n`` of a group.
    """
    binned = _bins(values)
    sums = binned.groupBy(*keys, "_bin").agg(F.sum("_c").alias("_s"))
    group = W.partitionBy(*keys)  # at most 2 ** _HALVINGS rows
    asked = (
        sums.withColumn("_upto", F.sum("_s").over(group.orderBy("_bin")))
        .withColumn("_n", F.sum("_s").over(group))
        .select("*", target.alias("_t"))
        .where("_t.at < _upto AND _t.at >= _upto - _s")
    )
    chosen = asked.select(
        *keys, "_bin", F.col("_t.name").alias("_to"),
        (F.col("_t.at") - F.col("_upto") + F.col("_s")).alias("_place"),
    )
    return join_groups(binned, chosen, [*keys, "_bin"], "inner").select(
        *kept, "_x", "_c", F.col("_to").alias("_name"), F.col("_place").alias("_at")
    )


def _bins(values: DataFrame) -> DataFrame:
    """``values`` with ``_bin``, the number of cuts up to ``_x``, by a search in halves."""
    steps = 1 << _HALVINGS
    cuts = F.percentile_approx("_x", [i / steps for i in range(1, steps)], _ACCURACY)
    out = values.withColumn("_cuts", values.agg(F.array_sort(cuts).alias("cuts")).scalar())
    out = out.withColumn("_bin", F.lit(0))
    while steps := steps // 2:
        beyond = F.get("_cuts", F.col("_bin") + (steps - 1)) <= F.col("_x")
        out = out.withColumn("_bin", F.col("_bin") + F.when(beyond, steps).otherwise(0))
    return out.drop("_cuts")


def join_groups(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left"
) -> DataFrame:
    """Join on group keys where NULL is a group like any other; without keys both have one row."""
    if not keys:
        return left.join(F.broadcast(right), F.lit(True), how)
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(named, same, how).drop(*[f"_right_{k}" for k in keys])
