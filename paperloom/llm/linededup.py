"""Repeated lines found through sharded minimal perfect hash functions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import settle

MIN_CHARS = 40
MIN_DOCS = 5
#: Keys in one shard of the hash function, about.
SHARD_KEYS = 32768
#: Bits per key on each level of the function.
GAMMA = 2
#: Bytes of arrays that one pass over the texts may broadcast. More arrays, more passes.
PASS_BYTES = 64 << 20
#: Stands for a NULL doc_id in the arrays.
NO_ID = -(1 << 63)
BLANKS = b" \t\n\x0b\x0c\r"


def long_keys(text: str | None, min_chars: int) -> Iterator[tuple[int, bytes]]:
    """(line number, key) of the lines of a text whose key has ``min_chars`` code points."""
    for number, line in enumerate((text or "").encode("utf-8", "surrogatepass").split(b"\n")):
        if len(line) >= min_chars:
            key = line.strip(BLANKS).lower()  # bytes: A-Z only
            if len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "surrogatepass")) >= min_chars):
                yield number, key


key_hash = xxhash.xxh3_128_digest


def _pairs(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 2)


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(hi, lo, doc_id): 128-bit hash of each long line of a document, once per document."""

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            digests, ids = [], []
            for at, text in enumerate(frame.column("text")):
                found = {key_hash(key) for _, key in long_keys(text.as_py(), min_chars)}
                digests.extend(found)
                ids.extend([at] * len(found))
            pairs = _pairs(digests)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pairs[:, 0].view(np.int64)), pa.array(pairs[:, 1].view(np.int64)), frame.column("doc_id").take(pa.array(ids, pa.int32()))],
                ["hi", "lo", "doc_id"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(batches, "hi long, lo long, doc_id long")


def repeated_keys(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(hi, lo, n, keeper) of keys in at least ``min_docs`` documents; keeper has the largest doc_id.

    Rows of one doc_id are one document, and rows without an id are none. A key's ids are told apart
    first, dealt by key and id, so that a line of a third of all documents is spread; its
    counts are then summed in each task before the second shuffle.
    """
    held = line_keys(docs, min_chars).where("doc_id IS NOT NULL").distinct()
    grouped = held.groupBy("hi", "lo").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"))
    return grouped.where(F.col("n") >= min_docs)


def _slots(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    """Position of each key on a level: another mix of its 128 bits for each level."""
    x = keys[:, 0] ^ (keys[:, 1] * np.uint64(0x9E3779B97F4A7C15 + 2 * level & 0xFFFFFFFFFFFFFFFF))
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(32)) ^ np.uint64(level)
    return (x % np.uint64(bits)).astype(np.int64)


@dataclass
class Shard:
    """One minimal perfect hash function and the arrays that it indexes.

    A level is a bit array; a key sits on the first level where it had a position to
    itself, and its index is the number of set bits before that position.
    """

    levels: list[np.ndarray]  # bit arrays
    ranks: list[np.ndarray]  # set bits before each 64-bit word, over all levels
    prints: np.ndarray
    counts: np.ndarray
    keepers: np.ndarray

    @classmethod
    def build(cls, keys: np.ndarray, counts: np.ndarray, keepers: np.ndarray) -> Shard:
        levels, ranks, place, seen = [], [], np.zeros(len(keys), np.int64), 0
        left = np.arange(len(keys))
        while len(left):
            bits = max(64, -(-GAMMA * len(left) // 64) * 64)
            at = _slots(keys[left], len(levels), bits)
            alone = np.bincount(at, minlength=bits) == 1
            words = np.packbits(alone, bitorder="little").view("<u8")
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))
            levels.append(words)
            ranks.append(before[:-1] + seen)
            sits = alone[at]
            place[left[sits]] = seen + np.cumsum(alone)[at[sits]] - 1
            seen += int(before[-1])
            left = left[~sits]
        order = np.empty(len(keys), np.int64)
        order[place] = np.arange(len(keys))
        return cls(levels, ranks, keys[order, 1], counts[order], keepers[order])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, -1 where its fingerprint is not in the array."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        one, low = np.uint64(1), np.uint64(63)
        for level, (words, before) in enumerate(zip(self.levels, self.ranks)):
            if not len(left):
                break
            at = _slots(keys[left], level, len(words) * 64).astype(np.uint64)
            word = words[(at >> np.uint64(6)).astype(np.int64)]
            hit = (word >> (at & low)) & one == one
            below = np.bitwise_count(word[hit] & ((one << (at[hit] & low)) - one))
            out[left[hit]] = before[(at[hit] >> np.uint64(6)).astype(np.int64)] + below
            left = left[~hit]
        known = out >= 0
        out[known] = np.where(self.prints[out[known]] == keys[known, 1], out[known], -1)
        return out

    def pack(self) -> bytes:
        parts = [np.array([len(self.levels), len(self.prints), *map(len, self.levels)], np.int64)]
        parts += [*self.levels, self.prints, self.counts, self.keepers]
        return b"".join(p.tobytes() for p in parts)

    @classmethod
    def unpack(cls, data: bytes) -> Shard:
        words = np.frombuffer(data, "<u8")
        n_levels, n = int(words[0]), int(words[1])
        sizes, at, seen, levels, ranks = words[2 : 2 + n_levels].astype(int), 2 + n_levels, 0, [], []
        for size in sizes:
            levels.append(words[at : at + size])
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(levels[-1]), dtype=np.int64)))
            ranks.append(before[:-1] + seen)
            seen += int(before[-1])
            at += size
        arrays = words[at : at + 3 * n].reshape(3, n)
        return cls(levels, ranks, arrays[0], arrays[1].view(np.int64), arrays[2].view(np.int64))


def build_index(keys: DataFrame, shards: int) -> DataFrame:
    """(shard, data, bytes): one hash function with its arrays per shard of ``keys``."""

    def build(rows: pa.Table) -> pa.Table:
        columns = {c: rows.column(c).to_numpy() for c in ("hi", "lo", "n", "keeper")}
        pairs = np.stack([columns["hi"].view(np.uint64), columns["lo"].view(np.uint64)], axis=1)
        data = Shard.build(pairs, columns["n"].astype(np.int64), columns["keeper"].astype(np.int64)).pack()
        return pa.table({"shard": rows.column("shard")[:1].cast(pa.int32()), "data": pa.array([data], pa.binary()), "bytes": pa.array([len(data)], pa.int64())})

    dealt = keys.withColumn("shard", F.pmod("hi", F.lit(shards)).cast("int")).withColumn("keeper", F.coalesce("keeper", F.lit(NO_ID)))
    return dealt.groupBy("shard").applyInArrow(build, "shard int, data binary, bytes long")


def _passes(sizes: list[tuple[int, int]]) -> list[list[int]]:
    """Shards in groups of at most PASS_BYTES, each a broadcast of its own."""
    groups: list[list[int]] = []
    room = 0
    for number, size in sizes:
        if not groups or size > room:
            groups.append([])
            room = PASS_BYTES
        groups[-1].append(number)
        room -= size
    return groups or [[]]


def _mark(docs: DataFrame, index: DataFrame, numbers: list[int], shards: int, min_chars: int, last: bool) -> DataFrame:
    """Add to ``dropped`` the lines of each document that these shards drop; the last pass drops them."""
    spark = docs.sparkSession
    # At most PASS_BYTES by the sizes measured before.
    arrays = spark.sparkContext.broadcast({r["shard"]: bytes(r["data"]) for r in index.where(F.col("shard").isin(numbers)).collect()})
    schema = "doc_id long, n_lines long, n_dropped long, kept string" if last else "doc_id long, text string, dropped array<int>"
    names = [part.split(" ")[0] for part in schema.split(", ")]

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        functions = {number: Shard.unpack(data) for number, data in arrays.value.items()}
        for frame in frames:
            ids, texts = frame.column("doc_id").to_pylist(), frame.column("text").to_pylist()
            digests, rows, lines = [], [], []
            for at, text in enumerate(texts):
                for number, key in long_keys(text, min_chars):
                    digests.append(key_hash(key))
                    rows.append(at)
                    lines.append(number)
            pairs = _pairs(digests)
            of = np.mod(pairs[:, 0].view(np.int64), shards)
            dropped = frame.column("dropped").to_pylist()
            for number, function in functions.items():
                mine = np.flatnonzero(of == number)
                found = function.find(pairs[mine])
                for m, keeper in zip(mine[found >= 0].tolist(), function.keepers[found[found >= 0]].tolist()):
                    if ids[rows[m]] != keeper and not (ids[rows[m]] is None and keeper == NO_ID):
                        dropped[rows[m]].append(lines[m])
            if not last:
                yield pa.RecordBatch.from_arrays([frame.column("doc_id"), frame.column("text"), pa.array(dropped, pa.list_(pa.int32()))], names)
                continue
            total, kept = [], []
            for text, numbers in zip(texts, dropped):
                parts, gone = (text or "").split("\n"), set(numbers)
                total.append(len(parts))
                kept.append("\n".join(line for at, line in enumerate(parts) if at not in gone) if gone else text or "")
            yield pa.RecordBatch.from_arrays(
                [frame.column("doc_id"), pa.array(total, pa.int64()), pa.array(list(map(len, dropped)), pa.int64()), pa.array(kept, pa.string())], names
            )

    return docs.mapInArrow(batches, schema)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): every row of ``docs(doc_id, text)`` without its repeated lines.

    A key is the line without blanks at its ends, in ASCII lower case. Keys of at least
    ``min_chars`` code points in at least ``min_docs`` rows lose all their lines but those
    in the largest doc_id that holds them; all rows of that doc_id keep them, and a NULL
    doc_id is smaller than any. The hash functions cover all repeated keys; a line that is
    not repeated is told apart by its 64-bit fingerprint. Their arrays are sent to the tasks
    in groups of at most PASS_BYTES, with a pass over the texts for each.

    NULL and empty texts are one empty line. Other columns are ignored; an empty table
    gives an empty table.
    """
    keys = settle(repeated_keys(docs, min_chars, min_docs), "line_keys")
    n_keys = keys.count()
    shards = max(1, -(-n_keys // SHARD_KEYS))
    index = settle(build_index(keys, shards), "line_index")
    sizes = [(r["shard"], r["bytes"]) for r in index.select("shard", "bytes").orderBy("shard").collect()]
    groups = _passes(sizes)
    marked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.array().cast("array<int>").alias("dropped"))
    for number, group in enumerate(groups):
        last = number == len(groups) - 1
        marked = _mark(marked, index, group, shards, min_chars, last)
        if not last:
            marked = settle(marked, "line_marks")
    return marked
