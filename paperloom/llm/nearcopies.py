"""Near copies by the Jaccard similarity of word shingles: SimHash links, MinHash candidates for the rest, exact check."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm import simhash
from paperloom.llm.common import settle, shuffle_partitions
from paperloom.llm.components import components

SHINGLE = 5
SEED = 42
#: Two texts link at a similarity of NEAR / OF or more.
NEAR, OF = 4, 5
#: A pair at similarity 0.8 shares none of 30 bands of 6 minima with probability 0.0001.
BANDS, ROWS = 30, 6
#: Minima (one byte of each is kept) that must agree before whole sets are fetched: at similarity 0.8
#: a pair agrees in 144 of 180 on average, and in fewer than LEAST with probability 0.0003.
LEAST = 126
#: Members of a bucket that are compared in one go; a larger bucket is dealt by pairs of blocks.
BLOCK = 2048
#: Groups of so many members give all their pairs at once.
SMALL = 4
#: Shingles that are hashed at a time.
STEP = 2048


def shingles(text: str | None, length: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the lower-cased shingles; a text of fewer words is one shingle."""
    return _distinct(simhash.hashes(text, length))


def _distinct(hashed: np.ndarray) -> np.ndarray:
    return np.unique(hashed) if len(hashed) else np.array([xxhash.xxh64_intdigest(b"", simhash.SEED)], np.uint64)


def _hashing(bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    draws = np.random.default_rng(SEED)
    many = draws.integers(0, 1 << 64, (2, bands * rows), np.uint64)
    return many[0] | np.uint64(1), many[1]


def _minima(found: np.ndarray, times: np.ndarray, plus: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set of hashes."""
    least = np.full(len(times), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), STEP):
        mixed = (found[at : at + STEP, None] ^ plus) * times
        mixed ^= mixed >> np.uint64(32)  # the low bits of a product depend on the low bits alone
        np.minimum(least, (mixed * times).min(axis=0), out=least)
    return least


def _key(text: str | None) -> bytes:
    """128-bit hash of the lower-cased words."""
    return xxhash.xxh3_128_digest(b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split()), SEED)


def _prints(docs: DataFrame, length: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, key, fp, n, cells, sketch): hash of the words, SimHash fingerprint, number of distinct shingles,
    a cell for each band of minima, and a byte of each minimum."""

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times, plus = _hashing(bands, rows)
        for frame in frames:
            keys, prints, sizes, cells, sketches = [], [], [], [], []
            for text in frame.column("text"):
                text = text.as_py()
                hashed = simhash.hashes(text, length)
                found = _distinct(hashed)
                least = _minima(found, times, plus)
                keys.append(_key(text))
                prints.append(simhash.majority(hashed))
                sizes.append(len(found))
                cells.append([xxhash.xxh64_intdigest(band.tobytes(), t) - (1 << 63) for t, band in enumerate(least.reshape(-1, rows))])
                sketches.append((least >> np.uint64(24)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [frame.column("doc_id"), pa.array(keys, pa.binary()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(cells, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                ["doc_id", "key", "fp", "n", "cells", "sketch"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        batches, "doc_id long, key binary, fp long, n long, cells array<long>, sketch binary"
    )


def _sets(docs: DataFrame, met: DataFrame, length: int) -> DataFrame:
    """(c, held): the shingle hashes of the classes ``met(doc_id, key, c)``, from one document of each."""

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            at, held = [], []
            for i, (text, key) in enumerate(zip(frame.column("text"), frame.column("key"))):
                if _key(text.as_py()) == key.as_py():  # an id may have several texts
                    at.append(i)
                    held.append(shingles(text.as_py(), length).view(np.int64))
            yield pa.RecordBatch.from_arrays([frame.column("c").take(pa.array(at, pa.int64())), pa.array(held, pa.list_(pa.int64()))], ["c", "held"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(met, "doc_id").select("c", "key", "text")
    return rows.mapInArrow(batches, "c long, held array<long>").dropDuplicates(["c"])


def _agreement(sketch: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bytes in which the sketches of rows x and y agree."""
    step = 1 << 14
    parts = [np.count_nonzero(sketch[x[at : at + step]] == sketch[y[at : at + step]], axis=1) for at in range(0, len(x), step)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _forest(many: int, x: np.ndarray, y: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Positions of the pairs (x, y) that make a spanning forest of largest values (Prim's algorithm)."""
    table = np.full((many, many), -1, np.int32)
    table[x, y] = table[y, x] = np.arange(len(x))
    worth = np.full((many, many), -1, np.int32)
    worth[x, y] = worth[y, x] = value
    best, by, out = np.full(many, -1), np.zeros(many, np.int64), []
    best[0] = 0
    for _ in range(many):
        at = int(best.argmax())
        if best[at] < 0:  # the next tree
            at = int(np.flatnonzero(best > -2)[0])
        elif len(out) or at:
            out.append(table[by[at], at])
        best[at] = -2
        nearer = (worth[at] > best) & (best > -2)
        best[nearer], by[nearer] = worth[at][nearer], at
    return np.array([k for k in out if k >= 0], np.int64)


def _meet(rows: pa.Table, near: int, of: int, least: int, forest: bool) -> pa.RecordBatch:
    """Pairs of classes that can link, of whole groups of rows, sorted by group."""
    cell, t, lo, hi, own, c, n, label = (rows.column(k).to_numpy() for k in ("cell", "t", "lo", "hi", "own", "c", "n", "label"))
    sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(len(c), -1)
    new = np.r_[True, (cell[1:] != cell[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]
    starts = np.flatnonzero(new)
    lengths = np.diff(np.r_[starts, len(c)])
    out = []

    def able(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ok = (label[x] != label[y]) & (n[x] * of >= n[y] * near) & (n[y] * of >= n[x] * near)
        ok &= ((own[x] == lo[x]) & (own[y] == hi[x])) | ((own[x] == hi[x]) & (own[y] == lo[x]))
        x, y = x[ok], y[ok]
        agree = _agreement(sketch, x, y)
        ok = agree >= least
        return x[ok], y[ok], agree[ok]

    short = np.repeat(lengths <= SMALL, lengths)
    left = np.repeat(lengths, lengths) - (np.arange(len(c)) - np.repeat(starts, lengths))  # rows from here to the group's end
    for shift in range(1, SMALL):
        at = np.flatnonzero(short & (left > shift))
        out.append(able(at, at + shift)[:2])
    for at, many in zip(starts[lengths > SMALL].tolist(), lengths[lengths > SMALL].tolist()):
        x, y = np.triu_indices(many, 1)
        x, y, agree = able(x + at, y + at)
        if forest:
            kept = _forest(many, x - at, y - at, agree)
            x, y = x[kept], y[kept]
        out.append((x, y))
    x, y = np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])
    if not forest:  # a pair counts in the first of the buckets that it shares
        cells = rows.column("cells").combine_chunks().flatten().to_numpy().reshape(len(c), -1)
        step, parts = 1 << 16, [np.zeros(0, bool)]
        for at in range(0, len(x), step):
            i, j = x[at : at + step], y[at : at + step]
            parts.append((cells[i] == cells[j]).argmax(axis=1) == t[i])
        kept = np.concatenate(parts)
        x, y = x[kept], y[kept]
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(c[x], c[y])), pa.array(np.maximum(c[x], c[y]))], ["a", "b"])


def _candidates(members: DataFrame, near: int, of: int, bands: int, rows: int, forest: bool) -> DataFrame:
    """(a, b): pairs of classes of ``members(cell, t, c, n, label, sketch, cells, many)`` that share a cell, have
    different labels, and can link by their sizes and sketches.

    The members of a cell meet in one task. A cell of ``many`` members is cut into blocks of about BLOCK,
    and each pair of blocks has a task; with ``forest``, each block alone, and of the pairs of a
    block only a spanning forest of the nearest ones comes back, fewer than its members.
    """
    blocks = F.ceil(F.col("many") / F.lit(BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("c", "cell"), blocks).cast("int")
    other = F.array(own) if forest else F.sequence(F.lit(0), blocks - 1)
    keys = ["cell", "lo", "hi"]
    kept = ["cell", "t", "c", "n", "label", "sketch"] + ["cells"] * (not forest)
    dealt = members.select(*kept, own.alias("own"), F.explode(other).alias("other")).select(
        *kept, "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")
    )
    least = LEAST * bands * rows // (BANDS * ROWS)

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for frame in frames:
            if not frame.num_rows:
                continue
            table = pa.Table.from_batches([frame])
            table = pa.concat_tables([held, table]).combine_chunks() if held else table
            last = np.zeros(table.num_rows, bool)  # rows before the group that may go on in the next batch
            for k in keys:
                column = table.column(k).to_numpy()
                last |= column != column[-1]
            cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
            held = table.slice(cut)
            if cut:
                yield _meet(table.slice(0, cut), near, of, least, forest)
        if held:
            yield _meet(held, near, of, least, forest)

    return dealt.repartition(shuffle_partitions(members.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(batches, "a long, b long").distinct()


def _simhash_links(classes: DataFrame) -> DataFrame:
    """(a, b): pairs of classes with equal fingerprints, and links of fingerprints by ``simhash.links``."""
    prints = settle(classes.groupBy("fp").agg(F.min("c").alias("rep")), "fingerprints")
    equal = classes.join(prints, "fp").where("c <> rep").select(F.col("rep").alias("a"), F.col("c").alias("b"))
    found = simhash.links(prints).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return equal.unionByName(found).distinct()


def near_copies(docs: DataFrame, length: int = SHINGLE, near: int = NEAR, of: int = OF, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, key, component_id) for every row of ``docs(doc_id, text)``.

    Texts link where their sets of lower-cased ``length``-word shingles have a Jaccard
    similarity of ``near / of`` or more; ``component_id`` is the smallest doc_id that links
    reach. Equal words are one class (128-bit hash); only classes are compared. Candidates
    are linked by their SimHash fingerprints or share a band of MinHash minima; each link is checked on the whole sets.

    First the fingerprints of the shingles link classes by the operator of ``simhash``. Few pairs at ``near / of``
    lie within its distance, so classes that it did not join meet in buckets too. Each bucket gives a spanning forest of its nearest pairs, by a byte of each minimum: that
    joins groups of copies by about as many comparisons of sets as they have members. Then, in
    buckets whose members are not all joined, all pairs of members that are not joined are compared by
    these bytes, and those that are near enough by their sets. So only pairs of different
    groups at similarity 0.7 to 0.8 or so cost more than their number of texts.

    NULL and empty texts are one class; a row with NULL doc_id gets the component of its
    class if another row of the class has an id. Repeated rows come back as often as they came.
    """
    prints = settle(_prints(docs, length, bands, rows), "prints")
    grouped = prints.where("doc_id is not null").groupBy("key").agg(
        F.min("doc_id").alias("rep"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("cells").alias("cells"), F.first("sketch").alias("sketch")
    )
    classes = settle(grouped.withColumn("c", F.monotonically_increasing_id()), "classes")
    cells = classes.select(F.posexplode("cells").alias("t", "cell"), "c", "n")
    shared = cells.groupBy("cell").agg(F.count("*").alias("many")).where("many > 1")
    live = settle(cells.join(shared, "cell"), "buckets")
    close = settle(_simhash_links(classes.select("fp", "c")), "close")
    met = live.select("c").union(close.select("a")).union(close.select("b")).distinct().join(classes, "c").select(F.col("rep").alias("doc_id"), "key", "c")
    sets = settle(_sets(docs, met, length), "sets")

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of classes whose sets are similar enough."""
        left = sets.select(F.col("c").alias("a"), F.col("held").alias("x"))
        right = sets.select(F.col("c").alias("b"), F.col("held").alias("y"))
        both = F.size(F.array_intersect("x", "y"))
        ok = both * (of + near) >= (F.size("x") + F.size("y")) * near
        return settle(pairs.join(left, "a").join(right, "b").where(ok).select("a", "b"), "links")

    sketches = classes.select("c", "sketch", "cells")
    alike = linked(close)
    joined = components(alike)
    begun = live.join(joined, live["c"] == joined["node"], "left").select(*live.columns, F.coalesce("root", "c").alias("label"))
    nearest = _candidates(begun.join(sketches, "c"), near, of, bands, rows, forest=True)
    labels = components(alike.unionByName(linked(nearest)))
    labelled = live.join(labels, live["c"] == labels["node"], "left").select("cell", "t", "c", "n", F.coalesce("root", "c").alias("label"))
    labelled = settle(labelled, "labelled")
    open_cells = labelled.groupBy("cell").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("many")).where("lo <> hi").select("cell", "many")
    found = linked(_candidates(labelled.join(open_cells, "cell").join(sketches, "c"), near, of, bands, rows, forest=False))
    first = labels.select(F.col("node").alias("c"), "root")
    ends = found.join(first.withColumnsRenamed({"c": "a", "root": "at"}), "a", "left").join(first.withColumnsRenamed({"c": "b", "root": "bt"}), "b", "left")
    more = components(ends.select(F.coalesce("at", "a").alias("a"), F.coalesce("bt", "b").alias("b")))
    rooted = classes.select("c", "key", "rep").join(first, "c", "left").select("key", "rep", F.coalesce("root", "c").alias("label"))
    rooted = settle(rooted.join(more, rooted["label"] == more["node"], "left").select("key", "rep", F.coalesce("root", "label").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = rooted.join(least, "root").select("key", "component_id")
    return prints.select("doc_id", "key").join(named, "key", "left").select("doc_id", "key", "component_id")


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, that have the smallest doc_id of their component.

    Rows of one doc_id are one document and stay or go together; rows with NULL doc_id stay.
    """
    found = near_copies(docs, **options)
    gone = settle(found.where("doc_id <> component_id").select("doc_id").distinct(), "copies")
    return docs.join(gone, docs["doc_id"].cast("long") == gone["doc_id"], "left_anti")
