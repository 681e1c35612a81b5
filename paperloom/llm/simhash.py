"""Near duplicates by 64-bit SimHash, linked through a popcount embedding."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import settle, shuffle_partitions
from paperloom.llm.components import components

SHINGLE = 4
SEED = 42
DISTANCE = 4
#: A bit pair is one segment; its count of set bits is 0, 1 or 2.
LOW_BITS = 0x5555555555555555
#: Bits of the consecutive groups of segments: 12, 10, 10, 10, 10 and 12.
GROUP_BITS = (12, 10, 10, 10, 10, 12)
#: A cell of more fingerprints than this is dealt to several tasks by blocks.
BLOCK = 4096
#: One in so many fingerprints is counted to find the cells to split.
SPLIT_SAMPLE = 8


def hashes(text: str | None, length: int = SHINGLE) -> np.ndarray:
    """Hashes of the lower-cased shingles, repeats included; a text of fewer words is one shingle, no word gives none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(words)
    if len(words) <= length:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)][: len(words)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - length].tolist(), ends[length - 1 :].tolist())], np.uint64)


def majority(hashed: np.ndarray) -> int:
    """The bits set in over half of the hashes, as an unsigned 64-bit number; no hash gives 0."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashed), 1 << 16):
        part = hashed[at : at + (1 << 16)].astype("<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (total * 2 > len(hashed)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, length: int = SHINGLE) -> int:
    """SimHash of one text, as an unsigned 64-bit number; no word gives 0."""
    return majority(hashes(text, length))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): one row per document, ``fp`` the fingerprint as a signed long."""

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            found = np.array([fingerprint(t.as_py()) for t in frame.column("text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([frame.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(batches, "doc_id long, fp long")


def _counts(fp: Column) -> Column:
    """The embedding: 32 segment counts, packed two bits each."""
    low, other = F.lit(LOW_BITS), F.shiftrightunsigned(fp, 1)
    odd = fp.bitwiseXOR(other).bitwiseAND(low)
    return odd.bitwiseOR(F.shiftleft(fp.bitwiseAND(other).bitwiseAND(low), 1))


def _masks() -> list[int]:
    groups, at = [], 0
    for bits in GROUP_BITS:
        groups.append(((1 << bits) - 1) << at)
        at += bits
    return [np.array(a | b, dtype=np.uint64).view(np.int64).item() for a, b in combinations(groups, 2)]


def _cells(classes: DataFrame) -> DataFrame:
    """The unit cells of the grid in which a class lies, one per projection.

    Two fingerprints at distance 4 or less are at Manhattan distance 4 or less in the
    embedding, so at least two of the six groups of segments have equal counts: the two
    share a cell in at least one of the fifteen projections on two groups.
    """
    keys = F.array(*[F.struct(F.lit(t).alias("t"), _counts(F.col("fp")).bitwiseAND(F.lit(m)).alias("cell")) for t, m in enumerate(_masks())])
    return classes.select("fp", "rep", F.explode(keys).alias("k")).select("k.t", "k.cell", "fp", "rep")


def _split(cells: DataFrame) -> DataFrame:
    """Deal large cells by pairs of blocks, so that no task holds one alone.

    The sample only decides how finely a cell is cut; every pair of its rows still
    meets in the group of their two blocks.
    """
    heavy = (
        cells.where(F.pmod(F.xxhash64(F.lit("heavy"), "fp"), F.lit(SPLIT_SAMPLE)) == 0)
        .groupBy("t", "cell")
        .agg(F.ceil(F.count("*") * SPLIT_SAMPLE / F.lit(BLOCK)).cast("int").alias("blocks"))
        .where("blocks > 1")
    )
    blocks = F.coalesce("blocks", F.lit(1))
    own = F.pmod(F.xxhash64(F.lit("block"), "fp"), blocks).cast("int")
    return (
        cells.join(settle(heavy, "heavy_cells"), ["t", "cell"], "left")
        .select("t", "cell", "fp", "rep", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        .select("t", "cell", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp", "rep")
    )


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where two fingerprints link: Manhattan bound on the counts, then exact distance."""
    low = np.uint64(LOW_BITS)
    one = np.uint64(1)
    x = ((a & low) + ((a >> one) & low)) ^ ((b & low) + ((b >> one) & low))
    odd, two = x & low, (x >> one) & low
    near = np.bitwise_count(odd) + 2 * np.bitwise_count(two & ~odd) <= DISTANCE
    near[near] = np.bitwise_count((a ^ b)[near]) <= DISTANCE
    return near


def _large_run(fp: np.ndarray, rep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of one large cell as (rep, smallest rep it reaches in the cell)."""
    label = np.arange(len(fp))
    order = np.argsort(rep, kind="stable")
    fp, rep = fp[order], rep[order]
    step = max(1, (1 << 21) // len(fp))
    left, right = [], []
    for at in range(0, len(fp), step):
        part = fp[at : at + step, None]
        a, b = np.nonzero(_near(np.broadcast_to(part, (len(part), len(fp))), np.broadcast_to(fp, (len(part), len(fp)))))
        keep = a + at < b
        left.append((a + at)[keep])
        right.append(b[keep])
        if sum(map(len, left)) > 1 << 22:
            label = _spread(label, np.concatenate(left), np.concatenate(right))
            left, right = [], []
    if left:
        label = _spread(label, np.concatenate(left), np.concatenate(right))
    moved = label != np.arange(len(fp))
    return rep[moved], rep[label[moved]]


def _spread(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the pairs (a, b): the smallest position of each component."""
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while not np.array_equal(again := new[new], new):
            new = again
        if np.array_equal(new, label):
            return label
        label = new


def _links(fp: np.ndarray, rep: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links inside the runs of equal cells; ``run`` numbers them in ascending order."""
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    lengths = np.diff(np.r_[starts, len(run)])
    out = []
    for at, n in zip(starts[lengths > 64], lengths[lengths > 64]):
        out.append(_large_run(fp[at : at + n], rep[at : at + n]))
    left = np.repeat(lengths, lengths) - (np.arange(len(run)) - np.repeat(starts, lengths))  # rows from here to the run's end
    left[np.repeat(lengths > 64, lengths)] = 0
    for shift in range(1, 64):
        at = np.flatnonzero(left > shift)
        if not len(at):
            break
        near = at[_near(fp[at], fp[at + shift])]
        out.append((rep[near], rep[near + shift]))
    if not out:
        return rep[:0], rep[:0]
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def links(classes: DataFrame) -> DataFrame:
    """Edges (a, b) between representatives, enough to give every component of ``classes(fp, rep)``."""
    spark = classes.sparkSession
    keys = ["t", "cell", "lo", "hi"]
    dealt = _split(_cells(classes)).repartition(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys)

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def solve(rows: pa.Table) -> pa.RecordBatch:
            cols = [rows.column(k).to_numpy() for k in keys]
            new = np.zeros(rows.num_rows, bool)
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            a, b = _links(rows.column("fp").to_numpy().view(np.uint64), rows.column("rep").to_numpy(), np.cumsum(new))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for frame in frames:
            rows = pa.concat_tables([*held, pa.Table.from_batches([frame])]).combine_chunks()
            last = np.zeros(rows.num_rows, bool)  # rows before the cell that may go on in the next batch
            for k in keys:
                c = rows.column(k).to_numpy()
                last |= c != c[-1] if len(c) else last
            if not last.any():
                held = [rows]
                continue
            cut = int(np.flatnonzero(last)[-1]) + 1
            held = [rows.slice(cut)]
            yield solve(rows.slice(0, cut))
        if held and held[0].num_rows:
            yield solve(held[0])

    return dealt.mapInArrow(batches, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs(doc_id, text)``.

    Fingerprints of lower-cased four-word shingles (XXH64, seed 42) link at 4 or fewer
    differing bits; ``component_id`` is the smallest doc_id that links reach. Equal
    fingerprints are one class; only classes are compared. NULL and empty texts have
    fingerprint zero and link like any other. A row with NULL doc_id keeps its fingerprint
    and gets the component of its class if another row of the class has an id; it links no
    classes itself. Repeated rows come back as often as they came. Other columns are ignored.
    """
    prints = settle(fingerprints(docs), "fingerprints")
    classes = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep is not null"), "classes")
    roots = components(links(classes))
    named = classes.join(roots, classes["rep"] == roots["node"], "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return prints.join(settle(named, "named"), "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that have the smallest doc_id of their component.

    Rows of one doc_id are one document and stay or go together; rows with NULL doc_id stay.
    """
    found = near_duplicates(docs)
    gone = settle(found.where("doc_id <> component_id").select("doc_id").distinct(), "copies")
    return docs.join(gone, docs["doc_id"].cast("long") == gone["doc_id"], "left_anti")
