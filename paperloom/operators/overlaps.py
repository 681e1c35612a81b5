"""Pairs of overlapping spans as a join of two tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.sources.sinks import settle

#: Characters of a block; of a block inside a crowded one; of a block in which again many spans meet.
WIDTHS = (4096, 128, 4)
#: Spans of one side in a block beyond which it is crowded.
CROWD = 512


def _ends() -> tuple[Column, Column]:
    """First and last character that matter for an overlap, whichever way a span is written."""
    inner = F.col("end_index") - 1
    return F.least("start_index", inner), F.greatest("start_index", inner)


def _blocks(spans: DataFrame, width: int, within: int | None) -> DataFrame:
    """Spans once for each block of ``width`` they touch; ``within``, only those inside ``block``."""
    first, last = F.floor(F.col("lo") / width), F.floor(F.col("hi") / width)
    if within:
        per = within // width
        first, last = F.greatest(first, F.col("block") * per), F.least(last, F.col("block") * per + per - 1)
    return spans.withColumn("block", F.explode(F.sequence(first, last)))


def overlap_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], widths: Sequence[int] = WIDTHS, crowd: int = CROWD) -> DataFrame:
    """One row per pair of spans of ``left`` and ``right`` with equal ``keys`` that overlap.

    Spans are half-open: a pair overlaps unless one ends where or before the other starts. Columns:
    the keys, then ``left`` and ``right``, each the struct of its row's other columns. Rows with a NULL key or
    index overlap nothing; repeated rows pair each.

    Spans meet in blocks of text, so a long document is spread; a pair counts in the one block
    where the later of its two spans begins. A block with more than ``crowd`` spans of a side is cut into
    finer blocks, twice, so that spans that share a block mostly overlap and the work follows the
    pairs found. A finest block that is still crowded holds many spans on the same few characters:
    its left side is dealt to several tasks, its right side goes to each of them.
    """

    def side(df: DataFrame) -> DataFrame:
        lo, hi = _ends()
        others = [c for c in df.columns if c not in keys]
        rows = df.where(F.col("start_index").isNotNull() & F.col("end_index").isNotNull())
        for k in keys:
            rows = rows.where(F.col(k).isNotNull())
        return rows.select(*keys, F.struct(*others).alias("row"), F.col("start_index").alias("s"), F.col("end_index").alias("e"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))

    place = [*keys, "block"]
    a, b, found, within = settle(side(left)), settle(side(right)), None, None
    for level, width in enumerate(widths):
        a, b = _blocks(a, width, within), _blocks(b, width, within)
        count = F.count(F.lit(1))
        sizes = a.groupBy(*place).agg(count.alias("n"), F.lit(0).alias("m")).unionByName(b.groupBy(*place).agg(F.lit(0).alias("n"), count.alias("m")))
        crowded = sizes.groupBy(*place).agg(F.sum("n").alias("n"), F.sum("m").alias("m")).where(F.greatest("n", "m") > crowd).where("n > 0 AND m > 0")
        last = level == len(widths) - 1
        if last:
            parts = crowded.select(*place, F.ceil(F.col("n") / crowd).cast("int").alias("parts"))
            one = F.coalesce("parts", F.lit(1))
            dealt = a.join(parts, place, "left").withColumn("part", F.pmod(F.xxhash64("row"), one).cast("int")).drop("parts")
            sent = b.join(parts, place, "left").withColumn("part", F.explode(F.sequence(F.lit(0), one - 1))).drop("parts")
            pairs = _meet(dealt, sent, [*place, "part"], keys, width)
        else:
            pairs = _meet(a.join(crowded, place, "left_anti"), b.join(crowded, place, "left_anti"), place, keys, width)
            a, b = a.join(crowded, place, "left_semi"), b.join(crowded, place, "left_semi")
        found = pairs if found is None else found.unionByName(pairs)
        within = width
    return found


def _meet(a: DataFrame, b: DataFrame, place: Sequence[str], keys: Sequence[str], width: int) -> DataFrame:
    other = b.withColumnsRenamed({"row": "row2", "s": "s2", "e": "e2", "lo": "lo2", "hi": "hi2"})
    begins = F.floor(F.greatest("lo", "lo2") / width) == F.col("block")
    hit = a.join(other, list(place)).where("e > s2 AND e2 > s").where(begins)
    return hit.select(*keys, F.col("row").alias("left"), F.col("row2").alias("right"))
