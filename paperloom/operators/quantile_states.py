"""Quantile states that are kept and merged (M4 without a second pass over old rows)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.functions.fixed_values import PERCENTILES
from paperloom.operators.percentiles import _index, join_groups

POINTS = 256
STATE = "point double, weight bigint"


def quantile_state(df: DataFrame, value: str, by: Sequence[str], points: int = POINTS, weight: str | None = None) -> DataFrame:
    """(by, point, weight): at most ``points`` values of each group, each standing for ``weight`` rows.

    A point stands for itself and the values above the point before it; points lie where the running
    count passes a multiple of n / points. So for any x the weights of the points up to x
    are no more than the rows up to x, and fewer by less than n / points. NULL values do not count, NULL is a group
    like any other. Deterministic: equal rows give equal states.
    """
    counts = F.col(weight) if weight else F.lit(1)
    rows = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("point")).agg(F.sum(counts).cast("long").alias("_c"))
    upto = F.sum("_c").over(W.partitionBy(*by).orderBy("point"))
    placed = rows.withColumns({"_upto": upto, "_n": F.sum("_c").over(W.partitionBy(*by))})
    kept = placed.where(f"(_upto * {points}) div _n > ((_upto - _c) * {points}) div _n")
    before = F.coalesce(F.lag("_upto").over(W.partitionBy(*by).orderBy("point")), F.lit(0))
    return kept.select(*by, "point", (F.col("_upto") - before).alias("weight"))


def merged_state(states: DataFrame, by: Sequence[str], points: int = POINTS) -> DataFrame:
    """One state for each group of ``by`` from states of finer groups; the errors add up."""
    return quantile_state(states, "point", by, points, "weight")


def state_quantiles(states: DataFrame, by: Sequence[str] = (), fractions: dict[str, float] = PERCENTILES) -> DataFrame:
    """(by, n, one column per fraction) from all states of a group, merged or not.

    The value for a fraction is the first point whose weights reach beyond element int(n * f). Some element
    of its value has a rank within N / points of that one, where N is the number of rows in all the states read
    here, plus N / points for every merge that led to them.
    """
    keys = list(by) or ["_all"]
    rows = (states if by else states.withColumn("_all", F.lit(0))).groupBy(*keys, "point").agg(F.sum("weight").alias("weight"))
    group = W.partitionBy(*keys)
    placed = rows.withColumns({"_upto": F.sum("weight").over(group.orderBy("point")), "n": F.sum("weight").over(group)})
    found = [F.min(F.when(F.col("_upto") > _index(F.col("n"), f), F.col("point"))).alias(name) for name, f in fractions.items()]
    return placed.groupBy(*keys).agg(F.max("n").alias("n"), *found).select(*by, "n", *fractions)


def rank_errors(df: DataFrame, value: str, found: DataFrame, by: Sequence[str], fractions: dict[str, float] = PERCENTILES) -> DataFrame:
    """``found`` with ``<name>_off`` for each fraction: places between the wanted element and the nearest equal to the value."""
    joined = join_groups(df.select(*by, F.col(value).cast("double").alias("_x")).where("_x IS NOT NULL"), found, by, "inner")
    sides = [x for name in fractions for x in (F.count_if(F.col("_x") < F.col(name)).alias(f"{name}_lo"), F.count_if(F.col("_x") <= F.col(name)).alias(f"{name}_hi"))]
    counted = joined.groupBy(*by, *[c for c in found.columns if c not in by]).agg(*sides)

    def off(name: str, f: float):
        at = _index(F.col("n"), f)
        return F.greatest(F.lit(0), F.col(f"{name}_lo") - at, at - F.col(f"{name}_hi") + 1).cast("long").alias(f"{name}_off")

    return counted.select(*found.columns, *[off(name, f) for name, f in fractions.items()])
