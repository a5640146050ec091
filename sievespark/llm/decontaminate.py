"""Benchmark passages in documents, found by pigeonhole edit matching.

An item of m characters may differ from a passage by an edit distance of up to e = floor(m * error_rate). Cut
into e + 1 pieces, at least one piece is then in the passage unchanged. All pieces of a block of items are
sought in one pass over a text; around each hit the item is aligned by Myers' bit-parallel distance. An edit
changes at most q of an item's strings of q characters, so a window that lacks more of them than that is passed
over before the alignment; no match is lost by it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import islice

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, own_caches

#: Share of an item's characters that may be inserted, deleted or replaced.
ERROR_RATE = 0.1
#: Length of the strings that the count before the distance looks at.
GRAM = 5
#: Characters of items in one automaton, and automata that a task holds at once; beyond that texts are read again.
BLOCK_CHARS, BLOCKS_AT_ONCE = 4_000_000, 4


def normalise(text: str) -> str:
    """Lower case, runs of white space as one space, none at the ends."""
    return " ".join(text.lower().split())


def budget_of(item: str, error_rate: float = ERROR_RATE) -> int:
    """Edits allowed for a normalised item, by the same rate for all lengths."""
    return int(len(item) * error_rate)


def pieces(item: str, error_rate: float = ERROR_RATE) -> tuple[int, list[tuple[int, str]]]:
    """Error budget and the budget + 1 pieces with their offsets, of lengths that differ by one at most."""
    budget = budget_of(item, error_rate)
    cuts = [i * len(item) // (budget + 1) for i in range(budget + 2)]
    return budget, [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def peq(item: str) -> dict[str, int]:
    """For each character the bits of its places in the item."""
    found: dict[str, int] = {}
    for i, c in enumerate(item):
        found[c] = found.get(c, 0) | 1 << i
    return found


def myers(masks: dict[str, int], length: int, text: str, budget: int) -> tuple[int, int] | None:
    """Least edit distance of the item to any substring of ``text`` and the end of the first best one.

    None if the distance is over ``budget``. One integer holds a column of the distance matrix; the column's
    first row is zero, so a match may start anywhere.
    """
    full, top = (1 << length) - 1, 1 << (length - 1)
    plus, minus, score, best, at = full, 0, length, budget + 1, 0
    get = masks.get
    for end, c in enumerate(text, 1):
        eq = get(c, 0)
        zero = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | ~(zero | plus)
        down = plus & zero
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            if score < best:
                best, at = score, end
                if not best:
                    break
        up <<= 1
        plus = ((down << 1) | ~(zero | up)) & full
        minus = up & zero & full
    return (best, at) if best <= budget else None


class Matcher:
    """The pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float, whole_words_below: int = 0):
        self.whole_words_below = whole_words_below
        self.items = [(key, text, budget, peq(text)) for key, text in items for budget in [budget_of(text, error_rate)]]
        self.grams = [[text[i : i + GRAM] for i in range(len(text) - GRAM + 1)] for _, text in items]
        where: dict[str, list[tuple[int, int]]] = {}
        for at, (_, text, _, _) in enumerate(self.items):
            for offset, piece in pieces(text, error_rate)[1]:
                where.setdefault(piece, []).append((at, offset + len(piece)))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, places)
        if where:
            self.automaton.make_automaton()

    def search(self, text: str) -> list[tuple[int, int, int]]:
        """``(item's key, distance, end)`` for each item that the normalised text holds, the best place each."""
        if not self.items:
            return []
        hits: dict[int, list[int]] = {}
        for end, places in self.automaton.iter(text):
            for at, used in places:
                hits.setdefault(at, []).append(end + 1 - used)
        found = []
        for at, starts in hits.items():
            key, item, budget, masks = self.items[at]
            grams, best = self.grams[at], None
            fewest = len(grams) - GRAM * budget
            for low, high in _merged(sorted(starts), len(item), budget):
                window = text[max(0, low) : high]
                if fewest > 0:
                    there = {window[i : i + GRAM] for i in range(len(window) - GRAM + 1)}
                    if sum(map(there.__contains__, grams)) < fewest:
                        continue
                if len(item) < self.whole_words_below and not self.stands_whole(item, window, text, max(0, low)):
                    continue
                near = myers(masks, len(item), window, budget)
                if near and (best is None or near[0] < best[0]):
                    best = near[0], max(0, low) + near[1]
                    if not best[0]:
                        break
            if best:
                found.append((key, *best))
        return found


    @staticmethod
    def stands_whole(item: str, window: str, text: str, at: int) -> bool:
        """The window holds the item unchanged, with no word going on at its ends."""
        found = window.find(item)
        while found >= 0:
            if _whole_words(text, at + found, at + found + len(item)):
                return True
            found = window.find(item, found + 1)
        return False


def _whole_words(text: str, low: int, high: int) -> bool:
    return not (low and text[low - 1].isalnum() and text[low].isalnum() or high < len(text) and text[high].isalnum() and text[high - 1].isalnum())


def _merged(starts: list[int], length: int, budget: int) -> Iterator[tuple[int, int]]:
    """Windows that hold every passage aligned at one of the starts; overlapping ones become one."""
    low = high = None
    for s in starts:
        a, b = s - budget, s + length + budget
        if high is not None and a <= high:
            high = b
            continue
        if high is not None:
            yield low, high
        low, high = a, b
    if high is not None:
        yield low, high


def blocks(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int, shortest_item: int = 0) -> Iterator[list[tuple[int, str]]]:
    """The stated query set in blocks of bounded size; rows with a null id or no text are no items."""
    block, size = [], 0
    for row in benchmark.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(id_col, text_col).toLocalIterator():
        text = normalise(row[1])
        if text and len(text) >= shortest_item:
            block.append((row[0], text))
            size += len(text)
            if size >= block_chars:
                yield block
                block, size = [], 0
    if block:
        yield block


def _passes(spark, found: Iterator[list[tuple[int, str]]]) -> Iterator[list]:
    """Broadcasts of up to ``BLOCKS_AT_ONCE`` blocks, which one pass over the texts looks for."""
    while part := list(islice(found, BLOCKS_AT_ONCE)):
        yield [spark.sparkContext.broadcast((uuid.uuid4().hex, block)) for block in part]


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS, shortest_item: int = 0, whole_words_below: int = 0) -> DataFrame:
    """``(doc_id, item_id, distance, end)``: a row for each document and item that it holds within the budget.

    ``end`` is the place in the normalised text where the best passage ends. Null texts match nothing. Items of
    any length have the same rate of edits, so one below 1 / ``error_rate`` characters must stand there unchanged, be it
    inside a word. Items below ``whole_words_below`` characters count only where they stand unchanged as whole words,
    and ``shortest_item`` leaves short ones out; by default neither leaves out anything. Repeated rows and items each give their rows. Documents stay where they are, the items
    go to them in blocks, several a pass, and nothing is shuffled.
    """
    spark = docs.sparkSession
    kind, item_kind = (t.schema[c].dataType.simpleString() for t, c in ((docs, id_col), (benchmark, item_id_col)))
    schema = f"doc_id {kind}, item_id {item_kind}, distance int, end int"
    arrow_item = pa.int64() if item_kind == "bigint" else pa.int32() if item_kind == "int" else pa.string()
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = None
    for shared in _passes(spark, blocks(benchmark, item_id_col, item_text_col, block_chars, shortest_item)):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matchers = _matchers(shared, error_rate, whole_words_below)
            for batch in batches:
                rows = [(at, *m) for at, x in enumerate(batch.column(1)) for text in [normalise(x.as_py())] for matcher in matchers for m in matcher.search(text)]
                if rows:
                    at, item, distance, end = zip(*rows)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(item, arrow_item), pa.array(distance, pa.int32()), pa.array(end, pa.int32())], names=["doc_id", "item_id", "distance", "end"])

        part = texts.mapInArrow(run, schema)
        found = part if found is None else found.union(part)
    return spark.createDataFrame([], schema) if found is None else found


def clean_rows(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS, shortest_item: int = 0, whole_words_below: int = 0) -> DataFrame:
    """The rows of ``docs``, unchanged, whose own text holds no benchmark item; null texts stay.

    With more blocks than a task holds the rows left are written between the passes, so that no task ever
    holds more.
    """
    kept, first = docs, True
    for shared in _passes(docs.sparkSession, blocks(benchmark, item_id_col, item_text_col, block_chars, shortest_item)):
        kept = (kept if first else materialize(kept, "not-yet-found")).where(_without(shared, error_rate, whole_words_below)(F.col(text_col)))
        first = False
    return kept


def _without(shared: list, error_rate: float, whole_words_below: int):
    @F.pandas_udf("boolean")
    def fine(texts: pd.Series) -> pd.Series:
        matchers = _matchers(shared, error_rate, whole_words_below)
        return texts.map(lambda x: x is None or not any(m.search(text) for text in [normalise(x)] for m in matchers)).astype(bool)

    return fine


_MATCHERS: dict[tuple[str, float, int], Matcher] = {}


def _matchers(shared: list, error_rate: float, whole_words_below: int = 0) -> list[Matcher]:
    """One automaton per worker process and block of the pass; those of other passes go."""
    own_caches("decontaminate", _MATCHERS.clear)
    wanted = {(b.value[0], error_rate, whole_words_below): b.value[1] for b in shared}
    for key in _MATCHERS.keys() - wanted.keys():
        del _MATCHERS[key]
    for key in wanted.keys() - _MATCHERS.keys():
        _MATCHERS[key] = Matcher(wanted[key], error_rate, whole_words_below)
    return [_MATCHERS[key] for key in wanted]
