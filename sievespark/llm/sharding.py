"""Shards cut from a Hilbert-curve order of several metadata dimensions.

Each dimension is quantised to a few bits (numbers by the corpus' quantiles, strings by their rank among hash
buckets), the cell's place on the Hilbert curve is the sort key, and the sorted rows are cut into runs of equal
length. Rows that are close in all dimensions land in few files, so that a filter on any of them prunes files.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_bytes


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``cells`` (rows by dimensions, values below ``1 << bits``).

    Works from the highest bit down: the reflections and exchanges that the curve makes in each sub-cube are
    undone, a Gray code remains, and its bits interleaved and decoded give the place.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        bit, below = 1 << level, (1 << level) - 1
        for d in range(dims):
            turned = (x[d] & bit) != 0
            swap = np.where(turned, 0, (x[0] ^ x[d]) & below)
            x[0] ^= np.where(turned, below, swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    fix = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        fix ^= np.where((x[dims - 1] & (1 << level)) != 0, (1 << level) - 1, 0)
    x ^= fix
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            out = out << 1 | (x[d] >> level & 1)
    return out


def quantile_cuts(df: DataFrame, columns: list[str], bits: int) -> dict[str, list[float]]:
    """For each numeric column up to ``2**bits - 1`` distinct cut points from one pass of mergeable sketches."""
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), F.array(*map(F.lit, shares)), F.lit(2000)).alias(c) for c in columns]).first()
    return {c: sorted({*(row[c] or [])}) for c in columns}


def with_hilbert(df: DataFrame, numbers: list[str], strings: list[str], bits: int = 6, out_col: str = "curve") -> DataFrame:
    """Adds ``out_col``, the place on the curve of the given columns; nulls take cell 0."""
    cuts = quantile_cuts(df, numbers, bits) if numbers else {}
    edges = [np.array(cuts[c]) for c in numbers]
    top = (1 << bits) - 1

    @F.pandas_udf("bigint")
    def place(values: pd.DataFrame) -> pd.Series:
        cells = np.zeros((len(values), values.shape[1]), np.int64)
        for i in range(values.shape[1]):
            v = values.iloc[:, i].to_numpy(np.float64, na_value=np.nan)
            known = np.isfinite(v)
            cells[known, i] = np.minimum(top, np.searchsorted(edges[i], v[known], "left") if i < len(edges) else v[known].astype(np.int64))
        return pd.Series(hilbert_index(cells, bits))

    buckets = [F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(1 << bits)).cast("double") for c in strings]
    inputs = [F.col(c).cast("double").alias(c) for c in numbers] + [F.when(F.col(c).isNotNull(), b).alias(c) for c, b in zip(strings, buckets)]
    return df.withColumn(out_col, place(F.struct(*inputs)))


def cut_runs(df: DataFrame, order: list[str], shards: int) -> DataFrame:
    """Adds ``shard`` (0 to ``shards`` - 1, row counts at most one apart) and ``slot`` (gapless from 0 in the shard).

    The rows are range-partitioned and sorted by ``order``; a row's rank is its place in its partition plus the
    rows of the partitions before it. Only one count per partition is gathered. Ties get any order, once: the
    sorted rows are written before they are counted.
    """
    placed = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    placed = placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_row", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    total, starts = 0, []
    for part in sorted(counts):
        starts.append((part, total))
        total += counts[part]
    before = df.sparkSession.createDataFrame(starts, "_part bigint, _before bigint")
    ranked = placed.join(F.broadcast(before), "_part").withColumn("_rank", F.col("_before") + F.col("_row"))
    long, size = total % shards, total // shards
    head = long * (size + 1)
    rank, tail = F.col("_rank"), F.col("_rank") - head
    shard = F.when(rank < head, F.floor(rank / (size + 1))).otherwise(long + F.floor(tail / max(size, 1)))
    slot = F.when(rank < head, rank % (size + 1)).otherwise(tail % max(size, 1))
    return ranked.withColumn("shard", shard.cast("int")).withColumn("slot", slot.cast("bigint")).drop("_at", "_part", "_row", "_before", "_rank")


def text_size(text_col: str) -> Column:
    """UTF-8 bytes of a text plus one; a null text has none."""
    return (F.octet_length(text_bytes(text_col)) + 1).cast("bigint")


def shard_rows(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", strings: tuple[str, ...] = ("lang", "source"), bits: int = 6) -> DataFrame:
    """``(id, size, text_crc32, curve, shard, slot)`` per row of ``docs``, law ``rows``.

    The curve runs through the text's size and the given string columns. A null text has size 1 and CRC 0;
    null ids and metadata are a value of their own; repeated rows each get a slot; an empty table gives none.
    Texts are read once for size and CRC and never shuffled.
    """
    raw = text_bytes(text_col)
    named = [f"_s{i}" for i in range(len(strings))]
    slim = docs.select(F.col(id_col).alias("id"), *[F.col(c).alias(n) for c, n in zip(strings, named)], text_size(text_col).alias("size"), F.crc32(raw).alias("text_crc32"))
    slim = materialize(slim, "metadata")
    placed = with_hilbert(slim, ["size"], named, bits).drop(*named)
    return cut_runs(placed, ["curve", "size", "text_crc32", "id"], shards)


def write_shards(docs: DataFrame, path: str, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", strings: tuple[str, ...] = ("lang", "source"), bits: int = 6, rows_per_file: int = 1_000_000) -> None:
    """Write ``docs`` as one folder ``shard=N`` per shard, each file a run of the curve, for pruning by its statistics.

    Whole rows are sorted and cut, so each is written once, null and repeated ids too. Where ``docs`` has a column
    called shard, the folders are ``curve_shard=N``.
    """
    named = [f"_s{i}" for i in range(len(strings))]
    marks = [text_size(text_col).alias("size"), F.crc32(text_bytes(text_col)).alias("text_crc32"), F.col(id_col).alias("id")]
    whole = docs.select(F.struct(*docs.columns).alias("row"), *marks, *[F.col(c).alias(n) for c, n in zip(strings, named)])
    cut = cut_runs(with_hilbert(whole, ["size"], named, bits), ["curve", "size", "text_crc32", "id"], shards)
    folder = "curve_shard" if "shard" in [c.lower() for c in docs.columns] else "shard"
    rows = cut.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").select("row.*", F.col("shard").alias(folder))
    rows.write.option("maxRecordsPerFile", rows_per_file).partitionBy(folder).parquet(path)
