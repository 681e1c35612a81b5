"""Language proportions of documents by expectation-maximisation over n-gram likelihoods."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import hash_share, remainder, shuffle_partitions

#: Documented bound of the training sample: rows per language, about.
MAX_ROWS = 3000
#: n-grams of three characters, hashed to so many columns.
COLUMNS = 1 << 16
#: Languages that a model may hold: it is sent to every task, 256 KB per language.
MAX_LANGUAGES = 512
UNKNOWN = "und"
#: Characters that are worked on at once.
CHUNK = 1 << 19
ROUNDS = 8
#: What a further language must add to the log-likelihood, besides log(words) / 2.
PENALTY = 4.0
#: Characters whose words are held at once; a longer text is held alone.
BATCH = 1 << 22


def letter_table() -> np.ndarray:
    """Code point -> lower-case letter code, 0 for anything but letters."""
    out = np.zeros(0x110000, np.uint32)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            low = char.lower()
            out[code] = ord(low) if len(low) == 1 else code
    return out


def chunks(texts: list[str | None], table: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(n-gram column of each letter, first letter of each word, text of each word) by about CHUNK characters.

    The n-gram of a letter is the letter with its neighbours, where 0 stands for a word's
    edge. A text longer than a chunk comes in several pieces, cut inside gaps where it has any.
    """
    run: list[tuple[int, str]] = []
    held = 0

    def solve() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        joined = "\0" + "\0".join(p for _, p in run) + "\0"
        codes = table[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")]
        owner = np.repeat(np.array([i for i, _ in run], np.int64), [len(p) + 1 for _, p in run])
        at = np.flatnonzero(codes)
        mixed = np.full(len(at), 0x9E3779B97F4A7C15, np.uint64)
        for shift in (-1, 0, 1):
            mixed = (mixed ^ codes[at + shift]) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(29)
        starts = np.flatnonzero(codes[at - 1] == 0)
        return (mixed % np.uint64(COLUMNS)).astype(np.int64), starts, owner[at[starts] - 1]

    for number, text in enumerate(texts):
        text, begin = text or "", 0
        while begin < len(text):
            end = begin + CHUNK
            if end < len(text):
                gap = max(text.rfind(" ", begin + 1, end), text.rfind("\n", begin + 1, end))
                end = gap if gap > begin else end
            run.append((number, text[begin:end]))
            held += min(end, len(text)) - begin + 1
            begin = end
            if held >= CHUNK:
                yield solve()
                run, held = [], 0
    if run:
        yield solve()


@dataclass
class Model:
    languages: list[str]
    likelihood: np.ndarray  # languages x COLUMNS
    letters: np.ndarray  # see letter_table


def train(docs: DataFrame, fold: int = 4, held: int = 2, max_rows: int = MAX_ROWS) -> Model:
    """n-gram likelihoods per language from ``docs(doc_id, text, lang)`` outside the held-out fold.

    Of each language about ``max_rows`` rows are read, chosen by a hash of the id; texts that
    occur twice among them count once. Rows with NULL lang or text teach nothing. Counts are
    summed by Spark; only the table of languages x COLUMNS comes to the driver.
    """
    known = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder("doc_id", fold) != held)
    )
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = [r["lang"] for r in sizes]
    if not languages:
        return Model([], np.ones((0, COLUMNS)), letter_table())
    chosen = F.lit(False)
    for r in sizes:
        chosen = chosen | ((F.col("lang") == r["lang"]) & hash_share("doc_id", max_rows / r["n"]))
    letters = letter_table()
    sent = docs.sparkSession.sparkContext.broadcast(letters)
    sample = known.where(chosen).select("lang", "text").repartition(shuffle_partitions(docs.sparkSession), "lang", "text").dropDuplicates()

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            number = {name: i for i, name in enumerate(languages)}
            of = np.array([number[x] for x in frame.column("lang").to_pylist()], np.int64)
            total = np.zeros((len(languages), COLUMNS))
            for columns, starts, owner in chunks(frame.column("text").to_pylist(), sent.value):
                language = np.repeat(of[owner], np.diff(np.r_[starts, len(columns)]))
                total += np.bincount(language * COLUMNS + columns, minlength=total.size).reshape(total.shape)
            rows, columns = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array(columns.astype(np.int32)), pa.array(total[rows, columns])], ["l", "c", "n"])

    counted = sample.mapInArrow(count, "l int, c int, n double").groupBy("l", "c").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(languages), COLUMNS))
    counts[counted.column("l").to_numpy(), counted.column("c").to_numpy()] = counted.column("n").to_numpy()
    counts += 0.1 + counts.sum(axis=0) / max(counts.sum(), 1) * 20  # shared grams smooth the rare ones
    return Model(languages, counts / counts.sum(axis=1, keepdims=True), letters)


def word_likelihoods(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text of each word, log-likelihood of each word under each language)."""
    table = np.log(model.likelihood).T.astype(np.float32)
    owners, values = [], []
    for columns, starts, owner in chunks(texts, model.letters):
        if len(starts):
            owners.append(owner)
            values.append(np.add.reduceat(table[columns], starts, axis=0))
    if not owners:
        return np.empty(0, np.int64), np.empty((0, len(model.languages)), np.float32)
    return np.concatenate(owners), np.concatenate(values)


def _mixture(odds: np.ndarray, starts: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM for many texts at once: (proportions, log-likelihood); words of a text are consecutive."""
    lengths = np.diff(np.r_[starts, len(odds)])
    for _ in range(ROUNDS):
        joint = odds * np.repeat(share, lengths, axis=0)
        joint /= joint.sum(axis=1, keepdims=True)
        share = np.add.reduceat(joint, starts, axis=0) / lengths[:, None]
    mixed = np.einsum("ij,ij->i", odds, np.repeat(share, lengths, axis=0))
    return share, np.add.reduceat(np.log(np.maximum(mixed, 1e-300)), starts)


def _bound(odds: np.ndarray, starts: np.ndarray, share: np.ndarray) -> np.ndarray:
    """What the log-likelihood of no proportions can exceed: its tangent at ``share``, which is concave."""
    lengths = np.diff(np.r_[starts, len(odds)])
    mixed = np.einsum("ij,ij->i", odds, np.repeat(share, lengths, axis=0))
    value = np.add.reduceat(np.log(np.maximum(mixed, 1e-300)), starts)
    pull = np.add.reduceat(odds / np.maximum(mixed, 1e-300)[:, None], starts, axis=0)
    return value + pull.max(axis=1) - lengths


def infer(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, number of languages) of each text; both zero where nothing is known.

    A word is drawn from one language, by the likelihood of its n-grams. Candidate sets are
    the most probable 1, 2, ... languages of the full mixture. A set of k languages is charged
    (k - 1) / 2 * log(words) + (k - 1) * PENALTY; the best set after its charge wins. No set can
    fit better than the full mixture, so texts that it cannot pull away from one language are
    done after the first step.
    """
    n_languages = len(model.languages)
    out, chosen = np.zeros((len(texts), n_languages)), np.zeros(len(texts), np.int64)
    if not n_languages:
        return out, chosen
    rows, logs = word_likelihoods(model, texts)
    if not len(rows):
        return out, chosen
    present, starts = np.unique(rows, return_index=True)
    lengths = np.diff(np.r_[starts, len(rows)])
    charge = np.log(lengths) / 2 + PENALTY
    top = logs.max(axis=1, keepdims=True)
    odds = np.exp((logs - top).astype(np.float64))
    base = np.add.reduceat(top[:, 0].astype(np.float64), starts)
    single = np.add.reduceat(logs.astype(np.float64), starts, axis=0) - base[:, None]
    share = np.eye(n_languages)[single.argmax(axis=1)]
    worth, size = single.max(axis=1), np.ones(len(present), np.int64)
    if n_languages > 1:
        near = share * (1 - 0.01 * n_languages) + 0.01
        opened = _bound(odds, starts, near) - charge > worth
        full, fit = share.copy(), worth.copy()
        if opened.any():
            even = np.full((int(opened.sum()), n_languages), 1 / n_languages)
            full[opened], fit[opened] = _mixture(odds[np.repeat(opened, lengths)], np.r_[0, np.cumsum(lengths[opened])[:-1]], even)
        order = np.argsort(-full, axis=1, kind="stable")
        for k in range(2, n_languages + 1):
            open_rows = fit - (k - 1) * charge > worth
            if not open_rows.any():
                break
            some = np.r_[0, np.cumsum(lengths[open_rows])[:-1]]
            start = np.zeros((int(open_rows.sum()), n_languages))
            np.put_along_axis(start, order[open_rows, :k], np.take_along_axis(full[open_rows], order[open_rows, :k], axis=1) + 1e-3, axis=1)
            start /= start.sum(axis=1, keepdims=True)
            mixed, value = _mixture(np.maximum(odds[np.repeat(open_rows, lengths)], 1e-300), some, start)
            value = value - (k - 1) * charge[open_rows]
            wins = value > worth[open_rows]
            better = np.flatnonzero(open_rows)[wins]
            share[better], worth[better], size[better] = mixed[wins], value[wins], k
    out[present], chosen[present] = share, size
    return out, chosen


def _parts(texts: list[str | None]) -> Iterator[list[str | None]]:
    begin = held = 0
    for at, text in enumerate(texts):
        held += len(text or "")
        if held >= BATCH or at == len(texts) - 1:
            yield texts[begin : at + 1]
            begin, held = at + 1, 0


def predict(docs: DataFrame, model: Model, fold: int = 4, held: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, mixture) for every row of ``docs(doc_id, text)``.

    ``lang_pred`` has the largest proportion (ties: the first by name), ``score`` is that
    proportion and ``mixture`` maps each selected language to its own. A text that is NULL or
    has no letter is ``und`` with score 0 and an empty map, and so is any text if no language was
    learned. Whole texts are read. NULL doc_id is in fold 0; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.likelihood, model.letters))

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*sent.value)
        names = model.languages
        for frame in frames:
            if not frame.num_rows:
                continue
            share, size = (np.concatenate(x) for x in zip(*(infer(model, part) for part in _parts(frame.column("text").to_pylist()))))
            known = size > 0
            best = share.argmax(axis=1) if len(names) else np.zeros(len(size), np.int64)
            label = [names[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())]
            top = [float(min(share[i, b], 1.0)) if k else 0.0 for i, (b, k) in enumerate(zip(best.tolist(), known.tolist()))]
            maps = [[(names[j], float(share[i, j])) for j in np.flatnonzero(share[i] > 0)] if k else [] for i, k in enumerate(known.tolist())]
            yield pa.RecordBatch.from_arrays(
                [frame.column("doc_id"), pa.array(label, pa.string()), pa.array(top, pa.float64()), pa.array(maps, pa.map_(pa.string(), pa.float64()))],
                ["doc_id", "lang_pred", "score", "mixture"],
            )

    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(batches, "doc_id long, lang_pred string, score double, mixture map<string,double>")
    return found.select("doc_id", (remainder("doc_id", fold) == held).alias("held_out"), "lang_pred", "score", "mixture")


def language_mixture(docs: DataFrame) -> DataFrame:
    """Train on the labelled rows of ``docs`` and infer the languages of all; see train and predict."""
    return predict(docs, train(docs))
