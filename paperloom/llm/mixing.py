"""A mix of sources by target weights, drawn by cube-method balanced sampling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import settle

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Documents of a source that one flight moves; larger sources fly in several blocks.
BLOCK = 4096
EPS = 1e-9
#: Units that a block of a large source leaves to the next flight.
SPARE = 8
#: Units of a source that its landing may flip besides the fractional ones.
EXCHANGES = 16


def with_size(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns and ``size``, the number of words of the text (NULL: 0)."""
    kept = docs.select(*columns, F.col("text").cast("string").alias("text__"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema.fields[:-1]) + "size long"

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            sizes = [len((t.as_py() or "").encode("utf-8", "surrogatepass").split()) for t in frame.column("text__")]
            yield pa.RecordBatch.from_arrays([*frame.columns[:-1], pa.array(sizes, pa.int64())], [*columns, "size"])

    return kept.mapInArrow(batches, schema)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, code, docs, source_size, target) for every source of ``sizes(source, size)``.

    Sources in code point order, NULL last, weigh ``weights`` in turn and share ``share``
    of all words. A target stops at ``most`` times its source; the excess goes to the others
    by weight until none is above. One row per source; no text is read again.
    """
    grouped = settle(sizes.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size")), "sources")
    # One small row per source, already summed: the only table that is ordered as a whole.
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("code") % len(weights) + 1).cast("int"))
    coded = settle(grouped.withColumn("code", place).withColumn("weight", weight).withColumn("most", F.col("source_size") * float(most)), "source_codes")
    whole = coded.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:  # each round fixes the sources that are full; it ends when no more become full
        row = coded.agg(
            F.coalesce(F.sum(F.when(F.col("most") <= level * F.col("weight"), F.col("most"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(F.col("most") > level * F.col("weight"), F.col("weight"))), F.lit(0.0)),
            F.coalesce(F.sum((F.col("most") <= level * F.col("weight")).cast("int")), F.lit(0)),
        ).first()
        if row[1] == 0 or row[2] == full:
            break
        full = row[2]
        level = (whole * share - row[0]) / row[1]
    return coded.select("source", "code", "docs", "source_size", F.least("most", F.col("weight") * level).alias("target"))


def fly(chance: np.ndarray, size: np.ndarray, draws: np.random.Generator) -> np.ndarray:
    """Flight phase over units in the given order: all but at most two end at 0 or 1.

    Three fractional units move along the direction that leaves their sum and their sum
    of words as they are, up or down by chance, until one reaches 0 or 1.
    """
    chance = chance.copy()
    waiting = iter(np.flatnonzero((chance > EPS) & (chance < 1 - EPS)).tolist())
    active: list[int] = []
    while True:
        while len(active) < 3 and (unit := next(waiting, None)) is not None:
            active.append(unit)
        if len(active) == 3:
            a, b, c = (float(size[i]) for i in active)
            way = [b - c, c - a, a - b]
            if not any(way):
                way = [1.0, -1.0, 0.0]
        elif len(active) == 2 and size[active[0]] == size[active[1]]:
            way = [1.0, -1.0]
        else:
            return chance
        up = min((((1 - chance[i]) if w > 0 else chance[i]) / abs(w)) for i, w in zip(active, way) if w)
        down = min(((chance[i] if w > 0 else (1 - chance[i])) / abs(w)) for i, w in zip(active, way) if w)
        step = up if draws.random() * (up + down) < down else -down
        for i, w in zip(active, way):
            moved = chance[i] + step * w
            chance[i] = 0.0 if moved < EPS else 1.0 if moved > 1 - EPS else moved
        active = [i for i in active if 0 < chance[i] < 1]


def land(chance: np.ndarray, size: np.ndarray, wanted: float) -> np.ndarray:
    """Landing: the last units go to the whole numbers nearest in words, then a few are exchanged.

    ``wanted`` is the number of words that the units should give. While one more flip of
    a unit brings the sum nearer, the best one is made, so the sum ends within
    about the smallest unit of it.
    """
    chance = chance.copy()
    open_units = np.flatnonzero((chance > 0) & (chance < 1))
    chance[open_units] = np.round(chance[open_units])
    off = float(chance @ size) - wanted
    for _ in range(EXCHANGES):
        after = np.abs(off + np.where(chance > 0, -size, size))
        unit = int(after.argmin()) if len(after) else 0
        if not len(after) or after[unit] >= abs(off):
            break
        off += -size[unit] if chance[unit] > 0 else size[unit]
        chance[unit] = 1 - chance[unit]
    return chance


def _fly_blocks(rows: DataFrame, seed: int) -> DataFrame:
    """One level: every (code, block) flies; a source with one block lands as well."""

    def solve(key: tuple, rows: pa.Table) -> pa.Table:
        # Large documents first: what is left fractional at the end is small.
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("size", "descending"), ("doc_id", "ascending"), ("row", "ascending")]))
        start, size = rows.column("chance").to_numpy().astype(float), rows.column("size").to_numpy().astype(float)
        draws = np.random.default_rng([seed, key[0].as_py(), key[1].as_py(), len(size)])
        last = rows.column("blocks")[0].as_py() == 1
        # Units of all sizes wait for the last block, so that its landing has some to choose from.
        waits = np.linspace(0, len(size) - 1, 0 if last else min(SPARE, len(size) // 4)).round().astype(int)
        flies = np.setdiff1d(np.arange(len(size)), waits)
        chance = start.copy()
        chance[flies] = fly(start[flies], size[flies], draws)
        if last:
            chance = land(chance, size, float(start @ size))
        return rows.select(["row", "doc_id", "size", "salt", "code"]).append_column("chance", pa.array(chance))

    block = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"), F.col("salt")), F.col("blocks")).cast("int")
    return rows.withColumn("block", block).groupBy("code", "block").applyInArrow(solve, "row long, doc_id long, size long, salt long, code int, chance double")


def _salted(sizes: DataFrame) -> DataFrame:
    """``sizes`` with ``salt``: the row number where one id and size fill more than a block, else NULL.

    A NULL leaves the hash that deals rows to blocks as it is.
    """
    many = settle(sizes.groupBy("doc_id", "size").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK), "repeated")
    if not many.head(1):
        return sizes.withColumn("salt", F.lit(None).cast("long"))
    many = many.select(F.col("doc_id").alias("its_id"), F.col("size").alias("its_size"), "n")
    same = F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col("size") == F.col("its_size"))
    return sizes.join(many, same, "left").withColumn("salt", F.when(F.col("n").isNotNull(), F.col("row"))).drop("its_id", "its_size", "n")


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 7, row: str | None = None
) -> DataFrame:
    """(row, doc_id, size, source, source_size, target, copies, taken) for every row of ``docs(doc_id, text, source)``.

    ``row`` names a column of unique numbers in a settled table; without one, rows are
    numbered here.

    A document of a source with ratio r = target / source_size is taken floor(r) times, and
    once more with the inclusion probability r - floor(r), drawn by the cube method so that
    each source keeps its number of words and of documents: flights over blocks of at most
    about BLOCK documents, then flights over what they left, until one block per source is
    left and the last one or two units land. Every level is written to the shared folder, and
    draws depend on ids only, so reruns agree; row numbers tell rows of one id and size apart.
    No source is ever held by one task, nor are the rows of one id.

    NULL text has size 0; NULL source is a source of its own, last in order; a source without
    words has target 0 and takes nothing. Repeated rows are drawn one by one.
    """
    number = F.col(row).cast("long") if row else F.monotonically_increasing_id()
    return _drawn(settle(_sizes(docs, number), "sizes"), weights, share, most, seed)


def _sizes(docs: DataFrame, number: Column, *keys: Column) -> DataFrame:
    """(row, doc_id, source, size) and other columns of every row of ``docs``."""
    kept = docs.select(number.alias("row"), F.col("doc_id").cast("long"), F.col("source").cast("string"), *keys, "text")
    return with_size(kept, *kept.columns[:-1])


def _drawn(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 7) -> DataFrame:
    """The mix of a settled table ``sizes(row, doc_id, source, size)``; see mix."""
    sources = settle(source_targets(sizes, weights, share, most).withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)), "targets")
    rows = _salted(sizes).join(sources.select(F.col("source").alias("s"), "code", "docs", "ratio"), F.col("source").eqNullSafe(F.col("s"))).select(
        "row", "doc_id", "size", "salt", "code", "docs", F.floor("ratio").cast("double").alias("whole"), (F.col("ratio") - F.floor("ratio")).alias("chance")
    )
    sure = (F.col("chance") <= EPS) | (F.col("chance") >= 1 - EPS)
    done = [rows.where(sure).select("row", "doc_id", "size", "salt", "code", F.round("chance").alias("chance"))]
    open_rows = rows.where(~sure).select("row", "doc_id", "size", "salt", "code", "chance", F.ceil(F.col("docs") / F.lit(BLOCK)).cast("int").alias("blocks"))
    level = 0
    while True:
        flown = settle(_fly_blocks(open_rows, seed + level), "flight")
        done.append(flown.where("chance = 0 or chance = 1"))
        left = flown.where("chance > 0 and chance < 1")
        counts = settle(left.groupBy("code").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks")), "left")
        if not counts.head(1):
            break
        open_rows = left.join(counts, "code").select("row", "doc_id", "size", "salt", "code", "chance", "blocks")
        level += 1
    drawn = done[0]
    for part in done[1:]:
        drawn = drawn.unionByName(part)
    return drawn.join(sources, "code").select(
        "row",
        "doc_id",
        "size",
        "source",
        "source_size",
        "target",
        (F.floor("ratio") + F.col("chance")).cast("long").alias("copies"),
        (F.col("size") * (F.floor("ratio") + F.col("chance"))).cast("long").alias("taken"),
    )


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with all their columns, every row as often as the mix takes it.

    Each row meets its own draw: by its place in its file where ``docs`` are read from files,
    so that only numbers are written; else rows are numbered once, in the shared folder.
    """
    try:
        places = {"file__": F.xxhash64("_metadata.file_path"), "place__": F.col("_metadata.row_index")}
        placed = docs.withColumns(places)
    except AnalysisException:
        placed = settle(docs.withColumns({"file__": F.lit(0).cast("long"), "place__": F.monotonically_increasing_id()}), "numbered")
    sizes = settle(_sizes(placed, F.monotonically_increasing_id(), F.col("file__"), F.col("place__")), "sizes")
    drawn = _drawn(sizes.select("row", "doc_id", "source", "size"), **options).where("copies > 0").select("row", F.col("copies").alias("times__"))
    draws = sizes.select("row", F.col("file__").alias("drawn__"), F.col("place__").alias("at__")).join(drawn, "row")
    joined = placed.join(draws.drop("row"), (F.col("file__") == F.col("drawn__")) & (F.col("place__") == F.col("at__")))
    return joined.withColumn("copy__", F.explode(F.sequence(F.lit(1).cast("long"), "times__"))).select(*docs.columns)
