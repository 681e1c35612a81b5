"""Evaluation periods joined to the decisions made in them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.operators.percentiles import join_groups

#: Seconds of time whose decisions meet in one group.
SPAN = 86_400
#: Decisions of a key and span beyond which they are dealt to several tasks.
CROWD = 1_000_000


def period_at(decisions: DataFrame, periods: DataFrame, keys: Sequence[str], at: str = "timestamp", span: int = SPAN, crowd: int = CROWD) -> DataFrame:
    """``decisions`` with ``period``: the row of ``periods(keys, start_at, end_at, ...)`` in force at their time, or NULL.

    Of the periods of a key the one that started last, at or before the decision, is in force until its
    ``end_at`` (NULL: open), which is the first time outside; a period that was followed by another does not
    come back. Of periods with one start the one that ends last counts (NULL last of all), then the one
    with the greatest other columns. NULL is a key like any other. A decision without a time, or before all
    periods, has none; a period without a start is none.

    No pairs are formed: both sides are merged in order of time. Time is cut into spans, so that a key with
    many decisions is spread; the period in force where a span begins is carried into it, from the
    periods alone. Decisions that crowd in one span are dealt to several tasks, each with the span's periods.
    """
    others = [c for c in periods.columns if c not in (*keys, "start_at", "end_at")]
    force = F.struct(
        F.col("start_at").alias("start_at"), F.col("end_at").isNull().alias("open"), F.col("end_at").alias("end_at"), *[F.col(c) for c in others]
    )
    given = periods.where("start_at IS NOT NULL").groupBy(*keys, "start_at").agg(F.max(force).alias("_p"))
    slot = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / (span * 1_000_000)).cast("long")
    named = given.withColumn("_slot", slot(F.col("start_at")))
    asked = decisions.withColumn("_slot", slot(F.col(at)))
    sizes = asked.where("_slot IS NOT NULL").groupBy(*keys, "_slot").agg(F.ceil(F.count(F.lit(1)) / crowd).cast("int").alias("_parts"))

    # The period in force at the start of each span that has decisions, and those that begin in it.
    last = named.groupBy(*keys, "_slot").agg(F.max("_p").alias("_p"))
    marks = sizes.select(*keys, "_slot", F.lit(None).alias("_p")).unionByName(last)
    before = W.partitionBy(*keys).orderBy("_slot").rangeBetween(W.unboundedPreceding, -1)
    carried = marks.withColumn("_in", F.max("_p").over(before)).where("_p IS NULL AND _in IS NOT NULL").select(*keys, "_slot", F.col("_in").alias("_p"))
    within = carried.unionByName(named.select(*keys, "_slot", "_p"))
    sent = join_groups(within, sizes, [*keys, "_slot"], "inner").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    dealt = join_groups(asked, sizes, [*keys, "_slot"]).withColumn("_part", F.pmod(F.xxhash64(at, *[c for c in decisions.columns if dict(decisions.dtypes)[c] in ("bigint", "int", "string")]), F.coalesce("_parts", F.lit(1))).cast("int"))

    rows = dealt.select(*keys, "_slot", "_part", F.col(at).alias("_t"), F.struct(*decisions.columns).alias("_row"), F.lit(None).alias("_p"))
    rows = rows.unionByName(sent.select(*keys, "_slot", "_part", F.col("_p.start_at").alias("_t"), F.lit(None).alias("_row"), "_p"))
    upto = W.partitionBy(*keys, "_slot", "_part").orderBy("_t").rangeBetween(W.unboundedPreceding, W.currentRow)
    found = rows.withColumn("_f", F.max("_p").over(upto)).where("_row IS NOT NULL")
    live = F.col("_t").isNotNull() & F.col("_f").isNotNull() & (F.col("_f.open") | (F.col("_t") < F.col("_f.end_at")))
    return found.select("_row.*", F.when(live, F.struct("_f.start_at", "_f.end_at", *[F.col(f"_f.{c}") for c in others])).alias("period"))
