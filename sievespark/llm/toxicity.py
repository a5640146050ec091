"""Toxicity scores by FTRL-proximal logistic regression over hashed words, bigrams and skip-grams.

Features are hashes of single words, of neighbouring words and of words with one or two words between them,
each counted once a document. Training visits the labelled documents one by one with a learning rate per
coordinate; the L1 term leaves most coordinates at exactly zero, so the weights are a short list of slots
that every task can hold.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import own_caches

_WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_KNOWN_WORDS = 100_000
#: Log-odds of every text where there is nothing to learn from.
UNLABELLED = -1.0


@dataclass(frozen=True)
class Settings:
    """``bits``: hash slots as a power of two. ``skips``: words left out between the two of a skip-gram.

    ``max_labelled``: the documents fitted on, those with the smallest hashed ids; the other settings are
    those of the optimiser. ``context`` scales the part of bigrams and skip-grams as against single words.
    """

    bits: int = 20
    skips: tuple[int, ...] = (1, 2)
    max_labelled: int = 10_000
    epochs: int = 4
    alpha: float = 5.0
    beta: float = 1.0
    l1: float = 20.0
    l2: float = 0.2
    context: float = 0.25
    positive_weight: float = 3.0


@dataclass(frozen=True)
class Model:
    """Intercept and the non-zero weights by slot; single words take slots below ``1 << bits``, pairs the rest."""

    bits: int
    skips: tuple[int, ...]
    context: float
    bias: float
    slots: np.ndarray
    weights: np.ndarray

    @cached_property
    def dense(self) -> np.ndarray:
        out = np.zeros(2 << self.bits, np.float32)
        out[self.slots] = self.weights
        return out

    def margin(self, text: str) -> float:
        """Log-odds of one whole text."""
        return self.margin_of(features(text, self.bits, self.skips))

    def margin_of(self, slots: np.ndarray) -> float:
        """Log-odds of a text's sorted slots."""
        found = self.dense[slots].astype(np.float64)
        cut = np.searchsorted(slots, 1 << self.bits)
        return float(self.bias + found[:cut].sum() + self.context * found[cut:].sum())


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= _KNOWN_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


_HASHES = _Hashes()


def _begin() -> None:
    own_caches("toxicity", _HASHES.clear)


def features(text: str, bits: int, skips: tuple[int, ...]) -> np.ndarray:
    """Distinct slots of one whole text, sorted; none for a text without words."""
    words = _WORD.findall(text.lower())
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    shift = np.uint64(64 - bits)
    parts = [(h * _MIX) >> shift]
    for gap in (0, *skips):
        a, b = h[: -gap - 1], h[gap + 1 :]
        parts.append((((a * _MIX) ^ (b + np.uint64(gap + 1))) * _MIX >> shift) + np.uint64(1 << bits))
    return np.unique(np.concatenate(parts)).astype(np.int32)


def ftrl(rows: list[tuple[np.ndarray, int]], s: Settings) -> Model:
    """One weight vector from labelled slot lists, visited in the given order ``epochs`` times.

    A slot in so few documents that its gradients can't add up to ``l1`` keeps weight zero whatever happens, and
    is left out from the start. The intercept is free of ``l1``, so that few labels still tell how rare label 1 is.
    """
    size = (2 << s.bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    last = size - 1
    scale = np.ones(size, np.float32)
    scale[1 << s.bits :] = s.context
    scale[last] = 1.0

    def weight(i: np.ndarray) -> np.ndarray:
        zi, least = z[i], np.where(i == last, 0.0, s.l1)
        w = (np.sign(zi) * least - zi) / ((s.beta + np.sqrt(n[i])) / s.alpha + s.l2)
        return np.where(np.abs(zi) <= least, 0.0, w)

    seen = np.zeros(size - 1, np.int32)
    for slots, _ in rows:
        seen[slots] += 1
    matters = seen * scale[:-1] * (s.epochs * max(1.0, s.positive_weight)) > s.l1
    rows = [(slots[matters[slots]], label) for slots, label in rows]

    for _ in range(s.epochs):
        for slots, label in rows:
            i = np.append(slots, last)
            w, x = weight(i), scale[i]
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label) * (s.positive_weight if label else 1.0) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / s.alpha
            z[i] += g - sigma * w
            n[i] += g * g
    slots = np.flatnonzero(np.abs(z[:-1]) > s.l1)
    return Model(s.bits, s.skips, s.context, float(weight(np.array([last]))[0]), slots.astype(np.int32), weight(slots).astype(np.float32))


def _slot_lists(labelled: DataFrame, id_col: str, text_col: str, label_col: str, s: Settings) -> DataFrame:
    """``(at, label, slots)`` of the labelled rows in one partition, by hashed id; features are made where texts lie."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin()
        for batch in batches:
            found = [features(x.as_py(), s.bits, s.skips) for x in batch.column(2)]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            flat = pa.array(np.concatenate([*found, np.zeros(0, np.int32)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, flat)], names=["at", "label", "slots"])

    rows = labelled.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    rows = rows.select(F.xxhash64(F.col(id_col).cast("string")).alias("at"), F.col(label_col).cast("int").alias("label"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(slots, "at bigint, label int, slots array<int>").repartition(1).sortWithinPartitions("at", "label")


def _gathered(batches: Iterator[pa.RecordBatch]) -> list[tuple[int, np.ndarray, int]]:
    rows = []
    for batch in batches:
        at, lists, labels = batch.column(0).to_pylist(), batch.column(2), batch.column(1).to_pylist()
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        rows += [(i, flat[a:b].copy(), y) for i, a, b, y in zip(at, ends, ends[1:], labels)]
    return rows


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", settings: Settings = Settings()) -> Model:
    """Model from labelled rows; rows with a null id or label are left out, an empty table gives a model without
    weights that takes nothing for toxic.

    Features are made where the texts lie; at most ``max_labelled`` slot lists, a bound that doesn't grow with
    the corpus, meet in the one task that visits them in order of their hashed ids. Only the model comes back.
    """
    s = settings

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = ftrl([(slots, y) for _, slots, y in _gathered(batches)], s)
        yield pa.RecordBatch.from_arrays([pa.array([m.bias]), pa.array([m.slots.tolist()], pa.list_(pa.int32())), pa.array([m.weights.tolist()], pa.list_(pa.float32()))], names=["bias", "slots", "weights"])

    first = _slot_lists(labelled, id_col, text_col, label_col, s).mapInArrow(train, "bias double, slots array<int>, weights array<float>").first()
    if first is None:
        return Model(s.bits, s.skips, s.context, UNLABELLED, np.zeros(0, np.int32), np.zeros(0, np.float32))
    return Model(s.bits, s.skips, s.context, first.bias, np.array(first.slots, np.int32), np.array(first.weights, np.float32))


def choose(labelled: DataFrame, grid: list[Settings], id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 4) -> list[tuple[Settings, float]]:
    """The settings of ``grid``, best first, with the F1 of label 1 from ``folds`` parts of the labelled rows, each
    predicted by a model of the others. Meant for rows of ``labelled_sample``: what is held out is never looked at.

    All settings must make the same features. The rows are bounded by ``max_labelled`` and meet in one task.
    """
    if len({(s.bits, s.skips) for s in grid}) != 1:
        raise ValueError("the settings to choose from must share bits and skips")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _gathered(batches)
        for n, s in enumerate(grid):
            right = wrong = missed = 0
            for fold in range(folds):
                m = ftrl([(x, y) for i, x, y in rows if i % folds != fold], s)
                for i, x, y in rows:
                    if i % folds == fold:
                        says = m.margin_of(x) >= 0
                        right, wrong, missed = right + (says and y), wrong + (says and not y), missed + (y and not says)
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([2 * right / max(1, 2 * right + wrong + missed)])], names=["n", "f1"])

    found = _slot_lists(labelled, id_col, text_col, label_col, grid[0]).mapInArrow(compare, "n int, f1 double").collect()
    return [(grid[r["n"]], r["f1"]) for r in sorted(found, key=lambda r: (-r["f1"], r["n"]))]


def held_out(id_col: str = "doc_id") -> Column:
    """One document in five, by the CRC-32 of its id's decimal string, is never learnt from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = Settings.max_labelled) -> DataFrame:
    """``(id, text, label)`` of at most ``max_labelled`` documents outside the held-out part, smallest hashed ids first.

    A document with several labels counts as toxic if one of them says so; of rows that repeat an id the first
    text in order counts. The ids are few by that bound, so they are broadcast to the texts, and only the texts
    chosen are shuffled.
    """
    marked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).where(~held_out(id_col))
    marked = marked.groupBy(id_col).agg(F.max(label_col).alias(label_col))
    few = marked.orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col).limit(max_labelled)
    found = docs.select(id_col, text_col).join(F.broadcast(few), id_col)
    return found.groupBy(id_col).agg(F.min(text_col).alias(text_col), F.max(label_col).alias(label_col))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` per row of ``docs``, each from its whole text; a null or empty text gets the intercept's score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin()
        margin = shared.value.margin
        for batch in batches:
            out = np.fromiter((margin(x.as_py()) for x in batch.column(1)), np.float64, batch.num_rows)
            out = 1.0 / (1.0 + np.exp(-np.clip(out, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, f"id {kind}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", settings: Settings = Settings()) -> DataFrame:
    """``(id, held_out, score, predicted)`` per row of ``docs``; fitted on the rows of ``labels`` outside the held-out part.

    Ids, languages and sources are never features. A null id counts as not held out. Without labels all
    scores are the same and below 0.5. Repeated rows each keep a row.
    """
    model = fit(labelled_sample(docs, labels, id_col, text_col, label_col, settings.max_labelled), id_col, text_col, label_col, settings)
    found = score(docs, model, id_col, text_col)
    return found.select("id", F.coalesce(held_out("id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs``, unchanged, whose own text is not predicted toxic."""
    model = fit(labelled_sample(docs, labels, id_col, text_col, label_col, settings.max_labelled), id_col, text_col, label_col, settings)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def fine(texts: pd.Series) -> pd.Series:
        _begin()
        margin = shared.value.margin
        return texts.map(lambda x: margin(x) < 0).astype(bool)

    return docs.where(fine(F.coalesce(F.col(text_col), F.lit(""))))
