"""SimHash near-duplicates found by pigeonring chains.

The 64 bits form a ring of ``segments`` segments. If two fingerprints differ in at most ``k`` bits, some
chain of consecutive segments starts where every prefix of length l holds at most floor(l*k/segments)
differences. The leading prefixes whose budget is zero must be equal, which makes them a join key; the
longer prefixes prune the candidates of a key before the last one, the whole ring, is the Hamming check.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, materialize_narrow, own_caches, sized_broadcast, text_bytes
from .components import connected_components

BITS = 64
_BLOCK = 1 << 16


def fingerprint_bytes(raw: bytes, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of one text: A-Z lower-cased, words cut at ASCII white space, repeated shingles counted."""
    words = raw.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return digest(b" ".join(words), seed)
    grams = zip(*(words[i:] for i in range(shingle)))
    total, counts = len(words) - shingle + 1, np.zeros(BITS, np.int64)
    for at in range(0, total, _BLOCK):
        size = min(_BLOCK, total - at)
        hashes = np.fromiter((digest(b" ".join(g), seed) for _, g in zip(range(size), grams)), np.uint64, size)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """``(id, fp)`` per row, fp being the signed 64-bit fingerprint; a null or blank text has fp 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_caches("simhash")
        for batch in batches:
            fp = np.fromiter((fingerprint_bytes(x.as_py(), shingle, seed) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("raw")).mapInArrow(run, f"id {kind}, fp bigint")


def ring(segments: int, k: int) -> list[list[tuple[int, int]]]:
    """For every start, the masks of its chain prefixes of 1..segments segments with their budgets."""
    cuts = [round(i * BITS / segments) for i in range(segments + 1)]
    masks = [sum(1 << b for b in range(cuts[i], cuts[i + 1])) for i in range(segments)]
    out = []
    for start in range(segments):
        chain, grown = [], 0
        for length in range(1, segments + 1):
            grown |= masks[(start + length - 1) % segments]
            chain.append((grown, length * k // segments))
        out.append(chain)
    return out


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _key_masks(chains: list[list[tuple[int, int]]]) -> list[int]:
    return [max((m for m, budget in chain if budget == 0), default=0) for chain in chains]


def _within(chains: list[list[tuple[int, int]]], start: Column, diff: Column) -> Column:
    """Every prefix of the chain at ``start`` stays within its budget."""
    test = F.lit(False)
    for i, chain in enumerate(chains):
        ok = F.lit(True)
        for mask, budget in chain:
            if budget:
                ok = ok & (F.bit_count(diff.bitwiseAND(F.lit(_signed(mask)))) <= budget)
        test = F.when(start == i, ok).otherwise(test)
    return test


def fingerprint_links(distinct: DataFrame, k: int = 2, segments: int = 5, bucket: int = 32) -> DataFrame:
    """Links ``(a, b)`` that connect all distinct ``fp`` at Hamming distance ``k`` = 2 or less.

    Keys with up to ``bucket`` fingerprints compare them pairwise under the chain budgets and give every
    link. In larger ones each fingerprint visits its neighbours at distance one outside the key: two
    fingerprints at distance two or less meet in one of them, and all that meet link to the smallest,
    which is at distance two or less as well. So a hot key costs rows in proportion to its size, every
    row is a true link, and whatever is linked directly stays connected.
    """
    if k != 2:
        raise ValueError("the neighbour step of large keys is exact for k = 2 only")
    chains = ring(segments, k)
    masks = _key_masks(chains)
    keys = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("c", "key"))
    sizes = materialize_narrow(keys.groupBy("c", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "key-sizes")
    live = materialize_narrow(keys.join(sizes, ["c", "key"]), "live-keys")

    few = live.where(F.col("n") <= bucket)
    x, y = few.select("c", "key", F.col("fp").alias("a")), few.select("c", "key", F.col("fp").alias("b"))
    diff = F.col("a").bitwiseXOR(F.col("b"))
    pairs = x.join(y, ["c", "key"]).where((F.col("a") < F.col("b")) & _within(chains, F.col("c"), diff)).select("a", "b")

    flips = F.lit(None).cast("array<bigint>")
    for i, mask in enumerate(masks):
        free = [0] + [1 << b for b in range(BITS) if not mask >> b & 1]
        flips = F.when(F.col("c") == i, F.array(*[F.lit(_signed(f)) for f in free])).otherwise(flips)
    near = live.where(F.col("n") > bucket).select("c", "fp", F.explode(flips).alias("flip"))
    near = near.select("c", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("at"))
    met = near.groupBy("c", "at").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    stars = met.select("a", F.explode("all").alias("b")).where("a != b")
    return pairs.union(stars).distinct()


def classes_of(prints: DataFrame, links: DataFrame, distinct: DataFrame | None = None) -> DataFrame:
    """``(id, fp, component)`` per row of ``prints``, component being the smallest id that ``links`` between fp reach."""
    distinct = distinct or materialize_narrow(prints.groupBy("fp").agg(F.min("id").alias("first")), "distinct-fingerprints")
    roots = connected_components(links, "a", "b")
    linked = materialize_narrow(distinct.join(roots, distinct.fp == roots.node).select("fp", "root", "first"), "linked")
    lowest = materialize_narrow(linked.groupBy("root").agg(F.min("first").alias("lowest")), "lowest")
    classes = materialize_narrow(linked.join(lowest, "root").select("fp", "lowest"), "classes")
    every = materialize_narrow(distinct.join(classes, "fp", "left").select("fp", F.coalesce("lowest", "first").alias("component")), "components")
    return prints.join(every, "fp", "left").select("id", "fp", "component")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, k: int = 2, segments: int = 5, bucket: int = 32) -> DataFrame:
    """``(id, fp, component)`` per row of ``docs``; component is the smallest id reachable over links.

    Blank and null texts share fingerprint zero and link like any other. Rows with a null id keep their
    row; a component of null ids only is null. Equal rows each keep a row. An empty table gives none.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = materialize_narrow(prints.groupBy("fp").agg(F.min("id").alias("first")), "distinct-fingerprints")
    return classes_of(prints, fingerprint_links(distinct, k, segments, bucket), distinct)


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its near-duplicate class; the columns stay as they are.

    Rows with a null id have no class and stay. Rows that repeat the smallest id all stay.
    """
    ids = near_duplicates(docs, id_col, text_col, **options)
    drop = sized_broadcast(ids.where(F.col("id") != F.col("component")).select(F.col("id").alias(id_col)).distinct())
    return docs.join(drop, id_col, "left_anti").select(*docs.columns)
