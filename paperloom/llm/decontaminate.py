"""Test items found in documents with errors: pigeonhole pieces, then bit-parallel distance."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import settle

#: Errors allowed per character of a test item.
ERROR_RATE = 0.08
#: Pieces that are first checked together, within their own share of the budget.
GROUP = 2
#: Characters of test items that one pass over the documents looks for.
PASS_CHARS = 4_000_000
_GAPS = re.compile(r"[\W_]+")
#: ASCII bytes to lower case, all but letters and digits to blanks.
_ASCII = bytes(ord(chr(c).lower()) if chr(c).isalnum() and c < 128 else 32 for c in range(256))


def normal(text: str | None) -> str:
    """Lower case, with one blank for every run of other than letters and digits."""
    text = text or ""
    if text.isascii():
        return b" ".join(text.encode().translate(_ASCII).split()).decode()
    return _GAPS.sub(" ", text.lower()).strip()


def least_distance(pattern: str, text: str) -> int:
    """Smallest edit distance of the pattern to any part of the text (Myers, bit-parallel)."""
    size = len(pattern)
    masks: dict[str, int] = {}
    for at, char in enumerate(pattern):
        masks[char] = masks.get(char, 0) | 1 << at
    full, last = (1 << size) - 1, 1 << size - 1
    up, down, score = full, 0, size
    best = score
    for char in text:
        match = masks.get(char, 0)
        diagonal = (((match & up) + up) ^ up) | match | down
        right = down | ~(diagonal | up) & full
        left = up & diagonal
        if right & last:
            score += 1
        elif left & last:
            score -= 1
        right = right << 1 & full
        left = left << 1 & full
        up = left | ~(diagonal | right) & full
        down = right & diagonal
        if score < best:
            best = score
    return best


class Matcher:
    """Finds items with at most their error budget in normalised texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items: dict[int, tuple[str, int]] = {}
        pieces: dict[str, list[tuple[int, int, int, int, int]]] = {}
        for item, text in items:
            if not text:
                continue
            budget = min(int(len(text) * rate), len(text) - 1)
            number = len(self.items)
            self.items[number] = (text, budget, item)
            n = budget + 1
            cuts = [len(text) * k // n for k in range(n + 1)]
            for k in range(n):
                first = k // GROUP * GROUP
                until = min(first + GROUP, n)
                # Some group of p pieces has at most p - 1 errors, and in it some piece has none.
                pieces.setdefault(text[cuts[k] : cuts[k + 1]], []).append((number, cuts[k], cuts[first], cuts[until], until - first - 1))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        if pieces:
            self.automaton.make_automaton()

    def find(self, text: str) -> dict[int, int]:
        """{item_id: smallest distance found} for a normalised text."""
        found: dict[int, int] = {}
        if not self.items or not text:
            return found
        tried: set[tuple[int, int]] = set()
        for end, (size, places) in self.automaton.iter(text):
            start = end - size + 1
            for number, offset, first, until, errors in places:
                pattern, budget, item = self.items[number]
                if found.get(item, budget + 1) == 0 or (number, start - offset) in tried:
                    continue
                begin = start - offset
                if text.startswith(pattern, begin) if begin >= 0 else False:
                    found[item] = 0
                    continue
                near = text[max(0, begin + first - errors) : begin + until + errors]
                if least_distance(pattern[first:until], near) > errors:
                    continue
                tried.add((number, begin))
                distance = least_distance(pattern, text[max(0, begin - budget) : begin + len(pattern) + budget])
                if distance <= budget and distance < found.get(item, budget + 1):
                    found[item] = distance
        return found


def edit_matches(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """(doc_id, item_id, distance): documents that hold a test item within its error budget.

    Both sides are compared in lower case with one blank for every run of other characters
    than letters and digits. The budget of an item is ``rate`` times its length. The item is cut
    into budget + 1 pieces, of which one must occur exactly; places of a piece are checked with
    its neighbours first, then as a whole. Whole documents are searched; the items come in
    blocks of at most PASS_CHARS characters, a pass each, and only a block is sent to the tasks.

    Items that are NULL or hold no letter or digit match nothing, and so do such documents. Items
    with equal ids are searched each, and the smallest distance is returned. One row per
    document row and item; NULL ids come back as NULL. Other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    wanted = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null").dropDuplicates()
    result = spark.createDataFrame([], "doc_id long, item_id long, distance int")
    for block in _blocks(wanted):
        sent = spark.sparkContext.broadcast(block)

        def batches(frames: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value, rate)
            for frame in frames:
                rows, found, far = [], [], []
                for at, text in enumerate(frame.column("text")):
                    for item, distance in matcher.find(normal(text.as_py())).items():
                        rows.append(at)
                        found.append(item)
                        far.append(distance)
                yield pa.RecordBatch.from_arrays([frame.column("doc_id").take(pa.array(rows, pa.int32())), pa.array(found, pa.int64()), pa.array(far, pa.int32())], ["doc_id", "item_id", "distance"])

        result = result.unionByName(texts.mapInArrow(batches, "doc_id long, item_id long, distance int"))
    return result


def keep_clean(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no test item; rows with NULL doc_id stay."""
    gone = settle(edit_matches(docs, items, rate).select("doc_id").distinct(), "contaminated")
    return docs.join(gone, docs["doc_id"].cast("long") == gone["doc_id"], "left_anti")


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of bounded size, streamed through the driver one partition at a time."""
    block, size = [], 0
    for row in items.orderBy("item_id", "text").toLocalIterator():
        text = normal(row["text"])
        if block and size + len(text) > PASS_CHARS:
            yield block
            block, size = [], 0
        block.append((row["item_id"], text))
        size += len(text)
    if block:
        yield block
