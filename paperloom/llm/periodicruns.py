"""Periodic runs of words: common extensions over a difference cover, a harmonic grid of positions."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Every distance modulo CYCLE is a difference of two of these residues.
COVER, CYCLE = (1, 5, 11, 24, 25, 27), 31
#: A run holds its period so many times or more, and so many words or more.
TIMES, SHORTEST = 4, 6
#: Short texts are searched together, up to so many words; a longer text is searched alone.
TOGETHER = 200_000
#: Pairs of grid positions that are looked at in one go.
AT_ONCE = 500_000


def _meeting() -> np.ndarray:
    """For two residues, the words to go on until both positions are sampled."""
    sampled = np.isin(np.arange(2 * CYCLE) % CYCLE, COVER)
    ahead = np.array([[sampled[a + d] for d in range(CYCLE)] for a in range(CYCLE)])
    return (ahead[:, None, :] & ahead[None, :, :]).argmax(axis=2)


MEETING = _meeting()


class Extensions:
    """How many symbols agree from two positions of a sequence on, for many pairs at a time.

    Only suffixes at positions whose residue is in ``COVER`` are sorted: blocks of ``CYCLE``
    symbols get names in their order, and names are doubled along each residue until all
    suffixes are told apart. Neighbours in that order get the length of what they share, and a
    sparse table answers minima over ranges of it. A pair of positions is compared symbol by
    symbol for fewer than ``CYCLE`` steps, until both positions are sampled ones.
    """

    def __init__(self, symbols: np.ndarray) -> None:
        n = len(symbols)
        self.text = np.zeros(n + 3 * CYCLE, np.uint32)  # 0 lies past the end
        self.text[:n] = symbols.astype(np.uint32) + 1
        rows = [np.arange(r, max(n, r) + CYCLE, CYCLE) for r in COVER]  # the last one is past the end
        rows = [x[: np.searchsorted(x, n) + 1] for x in rows]
        sizes = np.array([len(x) for x in rows])
        starts = np.cumsum(sizes) - sizes
        self.first = np.zeros(CYCLE, np.int64)
        self.first[list(COVER)] = starts
        at = np.concatenate(rows)
        ends = np.repeat(starts + sizes, sizes)
        levels = self._names(at, ends)
        self.rank, shared = self._order(levels, at, n)
        width = max(1, len(at).bit_length())
        self.least = np.empty((width, len(at)), np.int32)
        self.least[0] = shared
        for k in range(1, width):
            half = 1 << (k - 1)
            self.least[k] = self.least[k - 1]
            np.minimum(self.least[k - 1][:-half], self.least[k - 1][half:], out=self.least[k][:-half])

    def _names(self, at: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """Ranks of the first 1, 2, 4, ... blocks of each sampled suffix, until no more are told apart."""
        windows = np.lib.stride_tricks.sliding_window_view(self.text.astype(">u4"), CYCLE)
        blocks = np.ascontiguousarray(windows[at]).view(np.dtype((np.void, 4 * CYCLE))).ravel()
        found, names = np.unique(blocks, return_inverse=True)  # big-endian bytes compare as the symbols do
        levels, many = [names.astype(np.int64)], len(found)
        place, step = np.arange(len(at)), 1
        while many < len(at):
            after = place + step
            inside = after < ends
            nexts = np.where(inside, levels[-1][np.where(inside, after, 0)] + 1, 0)
            found, names = np.unique(levels[-1] * (len(at) + 2) + nexts, return_inverse=True)
            if len(found) == many:
                break
            many, step = len(found), 2 * step
            levels.append(names.astype(np.int64))
        return levels

    def _order(self, levels: list[np.ndarray], at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each sampled suffix, and the symbols that each rank shares with the one before it."""
        order = np.argsort(levels[-1], kind="stable")
        rank = np.empty(len(at), np.int64)
        rank[order] = np.arange(len(at))
        shared = np.zeros(len(at), np.int64)
        pairs = np.flatnonzero(at[order[:-1]] < n) + 1  # suffixes past the end come first and share nothing
        a, b = order[pairs - 1].copy(), order[pairs].copy()
        last = len(at) - 1
        for k in range(len(levels) - 1, -1, -1):
            same = levels[k][np.minimum(a, last)] == levels[k][np.minimum(b, last)]
            a[same] += 1 << k
            b[same] += 1 << k
            shared[pairs[same]] += CYCLE << k
        x, y = at[a], at[b]
        open_ = np.arange(len(pairs))
        for t in range(CYCLE):
            open_ = open_[self.text[x[open_] + t] == self.text[y[open_] + t]]
            if not len(open_):
                break
            shared[pairs[open_]] += 1
        return rank, shared

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Symbols that agree from ``i`` and from ``j`` on; i and j differ and are at most the length."""
        gap = MEETING[i % CYCLE, j % CYCLE]
        out = gap.copy()
        open_ = np.arange(len(i))
        met = np.ones(len(i), bool)
        for t in range(CYCLE):
            open_ = open_[gap[open_] > t]
            if not len(open_):
                break
            same = self.text[i[open_] + t] == self.text[j[open_] + t]
            out[open_[~same]] = t
            met[open_[~same]] = False
            open_ = open_[same]
        met = np.flatnonzero(met)
        x, y = i[met] + gap[met], j[met] + gap[met]
        x, y = self.rank[self.first[x % CYCLE] + x // CYCLE], self.rank[self.first[y % CYCLE] + y // CYCLE]
        low, high = np.minimum(x, y) + 1, np.maximum(x, y) + 1
        k = np.frexp((high - low).astype(float))[1] - 1
        out[met] += np.minimum(self.least[k, low], self.least[k, high - (np.int64(1) << k)])
        return out


def _grid(n: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(position, period) for every period up to ``longest``: each multiple of TIMES - 1 periods.

    A run of period q and TIMES * q symbols or more holds such a position together with the
    one q further on. Over all periods these are harmonically many, n log n.
    """
    q = 1
    while q <= longest:
        until = min(longest + 1, q + max(1, AT_ONCE * (TIMES - 1) * q // max(n, 1)))
        periods = np.arange(q, until)
        counts = (n - 1) // ((TIMES - 1) * periods) + 1
        each = np.repeat(periods, counts)
        k = np.arange(len(each)) - np.repeat(np.cumsum(counts) - counts, counts)
        yield k * each * (TIMES - 1), each
        q = until


def runs(symbols: np.ndarray, longest: int) -> np.ndarray:
    """Rows (start, length, period) of all runs with a period up to ``longest``, by start, then period.

    A run is a maximal stretch whose symbols equal those one smallest period on, of
    max(SHORTEST, TIMES * period) symbols or more.
    """
    n = len(symbols)
    longest = min(longest, n // TIMES)
    if longest < 1:
        return np.empty((0, 3), np.int64)
    onward, back, found = None, None, []
    for i, q in _grid(n, longest):
        inside = np.flatnonzero(i + q < n)
        inside = inside[symbols[i[inside]] == symbols[(i + q)[inside]]]
        if not len(inside):
            continue
        if onward is None:
            onward, back = Extensions(symbols), Extensions(symbols[::-1])
        i, q = i[inside], q[inside]
        right, left = onward.of(i, i + q), back.of(n - i, n - i - q)
        long_ = left + q + right >= np.maximum(SHORTEST, TIMES * q)
        found.append(np.stack([(i - left)[long_], (left + q + right)[long_], q[long_]], axis=1))
    if not found:
        return np.empty((0, 3), np.int64)
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), bool)  # of equal stretches the smallest period is the run's
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[first]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _search(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, str]]:
    """(number of words, runs, collapsed text) of each of some texts, which are searched as one sequence."""
    names: defaultdict[bytes, int] = defaultdict(count().__next__)
    parts, sizes = [], []
    for text in texts:
        found = text.split()  # bytes are split at 0x20 and 0x09 to 0x0D
        parts.append(np.fromiter(map(names.__getitem__, found), np.int64, len(found)))
        sizes.append(len(found))
    ends = np.arange(len(texts)) + len(names)  # a symbol of its own ends each text
    symbols = np.concatenate([x for part, end in zip(parts, ends) for x in (part, [end])])
    every = runs(symbols, max(sizes) // TIMES)
    starts = np.cumsum(np.array(sizes) + 1) - np.array(sizes) - 1
    cuts = np.searchsorted(every[:, 0], [*starts, len(symbols)])
    words = list(names)
    for part, start, a, b in zip(parts, starts, cuts, cuts[1:]):
        own = every[a:b] - [start, 0, 0]
        step = np.zeros(len(part) + 1, np.int64)
        np.add.at(step, own[:, 0] + own[:, 2], 1)
        np.add.at(step, own[:, 0] + own[:, 1], -1)
        kept = part[np.cumsum(step[:-1]) == 0]
        yield len(part), own, b" ".join(map(words.__getitem__, kept.tolist())).decode("utf-8", "replace")


def _groups(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Neighbouring texts of together about TOGETHER words at most, or one longer text."""
    group, size = [], 0
    for text in texts:
        most = (len(text) + 1) // 2
        if group and size + most > 3 * TOGETHER:  # a word and its blank take some six bytes
            yield group
            group, size = [], 0
        group.append(text)
        size += most
    if group:
        yield group


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row of ``docs(doc_id, text)``.

    ``runs`` lists (start, length, period) in words, by start, then period: each stretch of
    consecutive words with smallest period ``period`` (words that far apart are identical) and
    max(6, 4 * period) words or more that no neighbouring word extends. ``collapsed`` holds the
    words that no run contains after its first ``period`` words, joined by one blank. Words are
    stretches of other bytes than 0x20 and 0x09 to 0x0D and compare byte by byte.

    Whole texts are searched. NULL and empty texts have no words, no runs and an empty
    ``collapsed``. Rows with NULL or repeated ids come back each; other columns are ignored;
    no rows give no rows. Rows are independent: nothing is shuffled, a lost task is run again.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            texts = [t or b"" for t in frame.column("text").cast(pa.binary()).to_pylist()]
            ids, done = frame.column("doc_id"), 0
            for group in _groups(texts):
                found = list(_search(group))
                cuts = np.cumsum([0, *(len(own) for _, own, _ in found)])
                every = np.concatenate([own for _, own, _ in found])
                flat = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(every[:, c])) for c in range(3)], fields=list(kind.value_type))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids[done : done + len(group)],
                        pa.array([n for n, _, _ in found], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), flat),
                        pa.array([text for _, _, text in found], pa.string()),
                    ],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )
                done += len(group)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(batches, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): texts of which about a tenth, by crc32 of the id, repeat their words from some word on.

    With h the crc32 and g = h / 10, a text of n words with h % 10 = 0 goes on from word
    a = g % n with the words a, a + 1, ..., a + p - 1 over and over, p = 1 + (n - a) / (3 + g % 8).
    Its words are joined by one blank. Other texts, and those with NULL id, stay as they are.
    """
    words = F.expr(r"CASE WHEN h % 10 = 0 THEN regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0) END")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("h", F.expr("crc32(CAST(doc_id AS STRING))"))
    rows = rows.withColumn("w", words).withColumn("g", F.expr("h div 10")).withColumn("n", F.expr("size(w)"))
    rows = rows.withColumn("a", F.expr("CASE WHEN n > 0 THEN g % n END")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    again = "array_join(transform(sequence(0L, n - 1L), i -> w[int(if(i < a, i, a + (i - a) % p))]), ' ')"
    return rows.select("doc_id", F.expr(f"CASE WHEN n > 0 THEN {again} ELSE text END").alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Number of runs, the longest run and digests of runs and collapsed text, of ``periodic_runs``."""
    top = "array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period)))"
    listed = r"concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')))"
    return found.select("doc_id", F.expr("CAST(size(runs) AS BIGINT)").alias("n_runs"), F.expr(top).alias("top"), F.expr(f"sha2({listed}, 256)").alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id",
        "n_runs",
        F.expr("-top.start").alias("start"),
        F.col("top.length").alias("length"),
        F.expr("-top.period").alias("period"),
        F.expr("(1000 * top.length) div -top.period").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )
