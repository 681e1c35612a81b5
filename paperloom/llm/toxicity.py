"""Toxicity scores from non-negative positive-unlabelled learning."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import remainder, settle, shuffle_partitions

#: Documented bounds of the training sample, in rows: confirmed toxic, and unlabelled.
MAX_POSITIVE = 3000
MAX_UNLABELLED = 6000
#: Lengths of the beginnings of words that count as stems.
PREFIXES = (4, 5, 6)
#: Features are counted under so many hashes; at most KEPT of them get a weight.
BUCKETS = 1 << 20
KEPT = 4096
#: A feature is kept if its count among the toxic is at least so many standard errors off.
Z_KEPT = 3.0
#: A feature counts in at least so many texts of the sample.
LEAST = 3
#: Words over which a single hit counts in full.
WINDOW = 50
THRESHOLD = 0.7
_WORD = re.compile(r"[^\W_]+")


def counted(text: str | None) -> tuple[Counter[str], int]:
    """Words of a text with their counts, and how many there are in all."""
    found = _WORD.findall((text or "").lower())
    return Counter(found), len(found)


def features(text: str | None) -> dict[str, float]:
    """Words and beginnings of words (marked; stems, whatever the ending) with their density.

    Density is the count per WINDOW words, 1 at most: one hit in a long text is little.
    """
    found, total = counted(text)
    out = Counter(found)
    for k in PREFIXES:
        for w, n in found.items():
            if len(w) >= k:
                out[w[:k] + "-"] += n
    return {w: min(1.0, n * WINDOW / total) for w, n in out.items()}


def hashed(found: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and density of the features of a text; the largest density where hashes meet."""
    codes = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) & BUCKETS - 1 for w in found), np.int64, len(found))
    values = np.fromiter(found.values(), float, len(found))
    order = np.lexsort((-values, codes))
    codes, values = codes[order], values[order]
    first = np.r_[True, codes[1:] != codes[:-1]] if len(codes) else np.zeros(0, bool)
    return codes[first], values[first]


class Model:
    """Weights of features; a score is their sum, each by its density in the text."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.bias = bias
        self.words = {w: v for w, v in weights.items() if not w.endswith("-")}
        self.stems = {k: {w[:k]: v for w, v in weights.items() if w.endswith("-") and len(w) == k + 1} for k in PREFIXES}

    def score(self, text: str | None) -> float:
        found, total = counted(text)
        hits = [(self.words, {w: found[w] for w in self.words.keys() & found.keys()})]
        for k, stems in self.stems.items():
            seen: Counter[str] = Counter()
            for w in found:
                if w[:k] in stems and len(w) >= k:
                    seen[w[:k]] += found[w]
            hits.append((stems, seen))
        z = self.bias + sum(sum(weights[w] * min(1.0, seen[w] * WINDOW / total) for w in sorted(seen)) for weights, seen in hits)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


#: Feature hashes of texts and their densities.
Rows = list[tuple[np.ndarray, np.ndarray]]


def _matrix(rows: Rows, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row starts, column numbers and densities of the kept features."""
    place = np.full(BUCKETS, -1, np.int32)
    place[kept] = np.arange(len(kept))
    columns, values = [], []
    for codes, density in rows:
        found = place[codes]
        columns.append(found[found >= 0])
        values.append(density[found >= 0])
    lengths = np.array([len(c) for c in columns], np.int64)
    return np.concatenate(([0], np.cumsum(lengths))), np.concatenate(columns), np.concatenate(values)


def _sums(rows: Rows) -> np.ndarray:
    out = np.zeros(BUCKETS)
    for codes, density in rows:
        out[codes] += density  # a hash comes once in a text
    return out


def fit(positive: Rows, unlabelled: Rows, prior: float, rounds: int = 300, rate: float = 0.1, ridge: float = 1e-5) -> tuple[np.ndarray, np.ndarray, float]:
    """(feature hashes, weights, bias) of the linear classifier that minimises the non-negative risk estimate.

    The risk is prior * R(positive as 1) + max(0, R(unlabelled as 0) - prior * R(positive
    as 0)) with the logistic loss: the second part estimates the clean texts, which no one
    labelled; where it falls below zero the model fits single unlabelled texts, and
    the step goes the other way. Adam steps over the whole bounded sample.
    """
    if not positive or not unlabelled:
        return np.empty(0, np.int64), np.empty(0), float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    n_pos, n_all = len(positive), len(unlabelled)
    in_pos, in_all = _sums(positive), _sums(unlabelled)
    share = (in_pos + in_all) / (n_pos + n_all)
    spread = np.sqrt(np.maximum(n_pos * share * (1 - share), 1e-12))
    z = (in_pos - n_pos * share) / np.maximum(spread, 0.5)
    z[in_pos + in_all < LEAST] = 0
    kept = np.flatnonzero(np.abs(z) >= Z_KEPT)
    kept = np.sort(kept[np.argsort(-np.abs(z[kept]), kind="stable")[:KEPT]])
    (pos_starts, pos_cols, pos_values), (all_starts, all_cols, all_values) = _matrix(positive, kept), _matrix(unlabelled, kept)

    def forward(starts: np.ndarray, cols: np.ndarray, values: np.ndarray, weights: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0.0], np.cumsum(weights[cols] * values)))
        return sums[starts[1:]] - sums[starts[:-1]]

    def backward(starts: np.ndarray, cols: np.ndarray, values: np.ndarray, slope: np.ndarray) -> np.ndarray:
        return np.bincount(cols, np.repeat(slope, np.diff(starts)) * values, minlength=len(kept)) if len(cols) else np.zeros(len(kept))

    state = np.zeros(len(kept) + 1)
    state[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(state), np.zeros_like(state)
    for step in range(1, rounds + 1):
        weights, bias = state[:-1], state[-1]
        z_pos, z_all = forward(pos_starts, pos_cols, pos_values, weights) + bias, forward(all_starts, all_cols, all_values, weights) + bias
        p_pos, p_all = 1 / (1 + np.exp(-np.clip(z_pos, -30, 30))), 1 / (1 + np.exp(-np.clip(z_all, -30, 30)))
        rest = np.logaddexp(0, z_all).mean() - prior * np.logaddexp(0, z_pos).mean()
        to_one = prior * (p_pos - 1) / n_pos  # slope of prior * R(positive as 1)
        neg_pos, neg_all = -prior * p_pos / n_pos, p_all / n_all
        if rest < 0:
            to_one, neg_pos, neg_all = np.zeros_like(to_one), -neg_pos, -neg_all
        slope_pos = to_one + neg_pos
        slope = np.append(
            backward(pos_starts, pos_cols, pos_values, slope_pos) + backward(all_starts, all_cols, all_values, neg_all) + ridge * weights,
            slope_pos.sum() + neg_all.sum(),
        )
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        state = state - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return kept, state[:-1].copy(), float(state[-1])


def train(docs: DataFrame, labels: DataFrame, fold: int = 3, held: int = 1, prior: float | None = None) -> Model:
    """Model from the rows of ``docs(doc_id, text)`` whose id is not in the held-out fold.

    Positive: labelled toxic. Unlabelled: any row, its label not looked at. At most
    MAX_POSITIVE and MAX_UNLABELLED rows, those with the smallest hashes of id and text, are brought to
    the driver as hashed words; so many rows of one id, or equal rows, do not exceed that. ``prior`` is the share of toxic texts; if not given, it is
    the share among the labelled rows outside the fold. A document with several labels is
    toxic if one of them says so; NULL labels are none.
    """
    seen = remainder("doc_id", fold) != held
    marks = (
        labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"))
        .where(seen & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where(seen)
    marks = settle(marks, "marks")
    counted = marks.agg(F.count("*"), F.sum("toxic")).first()
    n_marks, n_pos = counted[0], counted[1] or 0
    if prior is None:
        prior = float(np.clip(n_pos / n_marks if n_marks else 0.05, 0.005, 0.5))
    toxic = _at_most(texts, MAX_POSITIVE, marks.where("toxic = 1").select("doc_id"))
    mixed = _at_most(texts, MAX_UNLABELLED)
    both = toxic.withColumn("positive", F.lit(True)).unionByName(mixed.withColumn("positive", F.lit(False)))
    sample = settle(both.repartition(shuffle_partitions(docs.sparkSession)), "toxicity_sample")
    kept, weights, bias = fit(_hashes(sample.where("positive")), _hashes(sample.where("not positive")), prior)
    return Model(_names(sample, dict(zip(kept.tolist(), weights.tolist()))), bias)


def _at_most(texts: DataFrame, most: int, ids: DataFrame | None = None) -> DataFrame:
    """The ``most`` rows of ``texts(doc_id, text)`` with the smallest hashes, of those with an id in ``ids``.

    The hashes alone are sorted, at most ``most`` a task. Rows with the last hash that counts are equal
    ones (but for a clash of hashes), so it does not matter which of them make up the number.
    """
    rows = texts.withColumn("_h", F.xxhash64(F.lit("sample"), "doc_id", "text"))
    keyed = rows.join(ids, "doc_id", "left_semi") if ids is not None else rows
    least = keyed.select("_h").orderBy("_h").limit(most)
    last = least.groupBy("_h").count().orderBy(F.desc("_h")).first()
    if last is None:
        return texts.limit(0)
    near = rows.where(F.col("_h") <= last["_h"])
    near = near.join(ids, "doc_id", "left_semi") if ids is not None else near
    equal = near.where(F.col("_h") == last["_h"]).limit(last["count"])
    return near.where(F.col("_h") < last["_h"]).unionByName(equal).select(*texts.columns)


def _hashes(texts: DataFrame) -> Rows:
    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            found = [hashed(features(t.as_py())) for t in frame.column("text")]
            codes = pa.array([c.astype("<i4").tobytes() for c, _ in found], pa.binary())
            values = pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary())
            yield pa.RecordBatch.from_arrays([frame.column("doc_id"), codes, values], ["doc_id", "codes", "values"])

    rows = texts.select("doc_id", "text").mapInArrow(batches, "doc_id long, codes binary, values binary").toArrow()
    rows = rows.sort_by([("doc_id", "ascending"), ("codes", "ascending"), ("values", "ascending")])
    return [(np.frombuffer(c.as_py(), "<i4"), np.frombuffer(v.as_py(), "<f4")) for c, v in zip(rows.column("codes"), rows.column("values"))]


def _names(texts: DataFrame, kept: dict[int, float]) -> dict[str, float]:
    """Weight of each feature of the sample whose hash has one, so that unseen words weigh nothing."""

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for frame in frames:
            for text in frame.column("text"):
                seen |= {w for w in features(text.as_py()).keys() - seen if zlib.crc32(w.encode("utf-8", "surrogatepass")) & BUCKETS - 1 in kept}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.string())], ["word"])

    found = texts.select("text").mapInArrow(batches, "word string").distinct().collect()  # words of at most KEPT hashes
    return {r["word"]: kept[zlib.crc32(r["word"].encode("utf-8", "surrogatepass")) & BUCKETS - 1] for r in found}


def score_column(model: Model) -> Callable[[str], Column]:
    """A column function: score of the text in a column, by Arrow batches."""
    parts = (model.words, model.stems, model.bias)  # words of at most KEPT hashes

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model({}, 0.0)
        own.words, own.stems, own.bias = parts
        for texts in batches:
            yield pd.Series([own.score(t) for t in texts], dtype=float)

    return lambda column: scored(F.col(column).cast("string"))


def score(docs: DataFrame, model: Model, fold: int = 3, held: int = 1, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs(doc_id, text)``.

    The whole text is read; NULL and empty texts get the score of no word. NULL doc_id is in
    fold 0. Repeated rows score alike. Other columns are ignored; no rows give no rows.
    """
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score_column(model)("text").alias("score"))
    return scored.select("doc_id", (remainder("doc_id", fold) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is below the threshold."""
    return docs.where(score_column(train(docs, labels))("text") < threshold)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on ``labels`` and score every document; see train and score."""
    return score(docs, train(docs, labels))
