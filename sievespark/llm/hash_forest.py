"""Nearest neighbours by inner product from a forest of hash prefixes.

Every tree gives each vector a long string of bits, the signs of its products with random directions; near vectors share
long prefixes. A tree is the sorted array of these strings, and the strings with a common prefix are a run of it. A query
descends in all trees to the longest prefixes it shares and ascends in all of them one bit at a time, together, until the
runs hold enough candidates; those are then scored exactly. How many are enough is measured: a bounded sample of queries is
compared with all rows, and the least number that reaches the wanted recall is taken.

Inner products become angles by one more component: a vector of norm n gets sqrt(max² - n²), a query gets zero.

On Spark a run is a key (tree, length, prefix). Runs are counted bottom-up, a few bits at a time, so that only the runs
which some query still descends into are split further; then queries and rows of the runs where queries stopped meet in
groups of bounded size, of which a large run has several, and every group returns the best of its own for each query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, sized_broadcast

#: Bits of a hash string.
BITS = 62
_BLOCK = 1 << 10


@dataclass(frozen=True)
class Settings:
    """``trees`` sorted arrays; ``recall`` to be reached on ``sample`` queries, the bound of what is compared with all rows;
    at most ``rows`` rows and ``queries`` queries of a run in one group; ``stride`` bits of descent between two counts."""

    trees: int = 16
    recall: float = 0.95
    sample: int = 128
    rows: int = 1 << 14
    queries: int = 1 << 13
    stride: int = 8
    seed: int = 42


def _directions(dim: int, settings: Settings) -> np.ndarray:
    return np.random.default_rng([settings.seed, dim]).standard_normal((dim + 1, settings.trees * BITS))


def hashes(vectors: np.ndarray, largest: float, settings: Settings, query: bool = False) -> np.ndarray:
    """Rows by trees: the hash strings as numbers below 2**62, so that their order is that of the strings."""
    norms = np.linalg.norm(vectors, axis=1)
    unit, rest = (vectors / norms[:, None], np.zeros(len(vectors))) if query else (vectors / largest, np.sqrt(np.maximum(0, 1 - (norms / largest) ** 2)))
    lifted, directions = np.column_stack([unit, rest]), _directions(vectors.shape[1], settings)
    weights, out = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64), np.empty((len(vectors), settings.trees), np.int64)
    for at in range(0, len(vectors), _BLOCK):
        signs = lifted[at : at + _BLOCK] @ directions > 0
        out[at : at + _BLOCK] = signs.reshape(len(signs), settings.trees, BITS) @ weights
    return out


def shared_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading bits that hash strings have in common."""
    differ, length = a ^ b, np.full(np.broadcast(a, b).shape, BITS, np.int64)
    for step in (32, 16, 8, 4, 2, 1):
        high = differ >> step
        length -= np.where(high > 0, step, 0)
        differ = np.where(high > 0, high, differ)
    return length - (differ > 0)


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def points(vectors: DataFrame, query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20) -> tuple[DataFrame, DataFrame]:
    """The distinct vectors ``(key, dim, vec, first, asked, ids)`` and the queries ``(query_id, key)``.

    ``ids`` are the k + 1 smallest ids of a vector, ``first`` the smallest, ``asked`` says that a query has it: copies
    are answered once. Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows
    with a null id. Repeated ids count once, with the vector of the smallest hash.
    """
    v = F.col(vector_col)
    fit = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)) & F.exists(v, lambda x: x != 0)
    plain = F.transform(v, lambda x: x + F.lit(0).cast(vectors.schema[vector_col].dataType.elementType))  # no negative zero
    row = F.struct(F.concat(F.hex(F.xxhash64("vec")), F.hex(F.xxhash64(F.lit(1), "vec"))).alias("key"), "vec", "asked")
    valid = vectors.where(F.coalesce(fit, F.lit(False)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), plain.alias("vec"), F.coalesce(query, F.lit(False)).alias("asked"))
    once = materialize(valid.groupBy("id").agg(F.min(row).alias("r")).select("id", "r.*"), "vectors")
    lowest = once.select("key", "id").withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("n") <= k + 1)
    ids = lowest.groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    distinct = once.groupBy("key").agg(F.min("vec").alias("vec"), F.max("asked").alias("asked")).join(ids, "key")
    distinct = distinct.select("key", F.size("vec").alias("dim"), "vec", F.col("ids")[0].alias("first"), "asked", "ids")
    return materialize(distinct, "points"), once.where("asked").select(F.col("id").alias("query_id"), "key")


def _hashed(rows: DataFrame, largest: float, settings: Settings) -> DataFrame:
    """``rows`` with ``own``, the hash strings by tree, and ``probe``, those of the same vector as a query, null unless ``asked``."""
    schema = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            own, probe = [None] * len(dims), [None] * len(dims)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                found, asked = _matrix(batch.column("vec").take(pa.array(at)), dim), batch.column("asked").take(pa.array(at)).to_numpy(zero_copy_only=False)
                for i, h in zip(at, hashes(found, largest, settings)):
                    own[i] = h
                for i, h in zip(at[asked], hashes(found[asked], largest, settings, query=True)):
                    probe[i] = h
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, schema), pa.array(probe, schema)], names=[*batch.schema.names, "own", "probe"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, own array<bigint>, probe array<bigint>")


def _top(scores: np.ndarray, k: int) -> np.ndarray:
    """Whether each score of a row is among its k largest, those within rounding of the k-th included."""
    if scores.shape[1] <= k:
        return np.ones(scores.shape, bool)
    least = np.partition(scores, -k, axis=1)[:, -k]
    return scores >= (least - 1e-9 * (1 + np.abs(least)))[:, None]


def enough(index: DataFrame, settings: Settings, k: int = 20) -> int:
    """The least number of candidates at which the sampled queries reach the wanted recall.

    Every row is compared with the sample, by score and by shared prefix. A task keeps the sample's nearest and how many
    strings of its rows share each length; only those small tables are shuffled.
    """
    sample = index.where("asked").orderBy(F.xxhash64("key"), "key").select("key", "dim", "vec", "probe").limit(settings.sample).collect()
    if not sample:
        return 1
    keys, dims, probes = [r.key for r in sample], np.array([r.dim for r in sample]), np.array([r.probe for r in sample], np.int64)
    vecs = [np.array(r.vec, np.float64) for r in sample]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, best = np.zeros((len(keys), BITS + 1), np.int64), [(np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64)) for _ in keys]
        for batch in batches:
            for dim in np.unique(batch.column("dim").to_numpy()):
                at = np.flatnonzero(batch.column("dim").to_numpy() == dim)
                mine = np.flatnonzero(dims == dim)
                part = batch.take(pa.array(at))
                firsts, names = part.column("first").to_numpy(), part.column("key").to_pylist()
                own = part.column("own").flatten().to_numpy().reshape(-1, settings.trees)
                place = {n: i for i, n in enumerate(names)}
                scores = np.stack([vecs[i] for i in mine]) @ _matrix(part.column("vec"), dim).T if len(mine) else np.empty((0, len(at)))
                for tree in range(settings.trees if len(mine) else 0):
                    run_ = np.sort(own[:, tree])
                    for length in range(BITS + 1):
                        low = probes[mine, tree] >> BITS - length << BITS - length
                        counts[mine, length] += np.searchsorted(run_, low + (1 << BITS - length)) - np.searchsorted(run_, low)
                for row, i in enumerate(mine):
                    if keys[i] in place:
                        scores[row, place[keys[i]]] = -np.inf
                    hit = np.flatnonzero(_top(scores[row : row + 1], k)[0] & (scores[row] > -np.inf))
                    met = shared_prefix(own[hit], probes[i]).max(axis=1, initial=0)
                    score, first, length = (np.concatenate(x) for x in zip(best[i], (scores[row, hit], firsts[hit], met)))
                    keep = np.lexsort((first, -score))[:k]
                    best[i] = score[keep], first[keep], length[keep]
        cells = [(i, *map(list, best[i]), counts[i]) for i in range(len(keys))]
        long = pa.list_(pa.int64())
        kinds = {"q": pa.int32(), "score": pa.list_(pa.float64()), "first": long, "length": long, "counts": long}
        yield pa.RecordBatch.from_arrays([pa.array([c[x] for c in cells], kind) for x, kind in enumerate(kinds.values())], names=list(kinds))

    found = index.select("key", "dim", "vec", "first", "own").mapInArrow(run, "q int, score array<double>, first array<bigint>, length array<bigint>, counts array<bigint>")
    found = materialize(found, "sampled")
    sums = found.select("q", F.posexplode("counts").alias("length", "n")).groupBy("q", "length").agg(F.sum("n").alias("n")).collect()
    near = found.select("q", F.explode(F.arrays_zip("score", "first", "length")).alias("x")).select("q", "x.*")
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "first"))).where(F.col("r") <= k).collect()
    counts, hit, all_ = np.zeros((len(keys), BITS + 1), np.int64), np.zeros((len(keys), BITS + 2)), np.zeros(len(keys))
    for r in sums:
        counts[r.q, r.length] = r.n
    for r in near:
        hit[r.q, : r.length + 1] += 1
        all_[r.q] += 1
    recall = np.where(all_[:, None] > 0, hit[:, :-1] / np.maximum(all_, 1)[:, None], 1.0)
    choices = np.unique(counts[counts > 0])
    reached = lambda m: recall[np.arange(len(keys)), np.maximum((counts >= m).sum(axis=1) - 1, 0)].mean() >= settings.recall
    low, high = 0, len(choices) - 1
    while low < high:  # more candidates never lower the recall
        mid = (low + high) // 2
        low, high = (low, mid) if reached(choices[mid]) else (mid + 1, high)
    most = counts[:, 0].max()  # all strings of all trees: every row is met
    return int(choices[low]) if reached(choices[low]) else int(most)


def _prefix(bits: Column, length: Column, of: int | Column = BITS) -> Column:
    """The first ``length`` bits of a string of ``of`` bits."""
    return F.call_function("shiftright", bits, (F.lit(of) - length).cast("int"))


def stops(index: DataFrame, wanted: int, settings: Settings) -> DataFrame:
    """``(key, dim, tree, length, prefix, n)``: the runs in which the synchronous ascent of each query ends.

    The longest length at which a query's runs over all trees hold ``wanted`` strings, or zero. The descent goes ``stride``
    bits at a time: rows are counted by the longer prefix, the counts are summed to the shorter ones, and queries whose
    longest runs still hold enough go on, in the runs they are in. Runs at length zero are the whole of one tree.
    """
    entries = index.select("dim", F.posexplode("own").alias("tree", "hash"))
    live = index.where("asked").select("key", "dim", F.posexplode("probe").alias("tree", "hash"))
    low, ended, lengths = 0, [], lambda a, b: F.explode(F.sequence(F.lit(a), F.lit(b))).alias("length")
    spread = math.ceil(math.log2(max(1, index.count() * settings.trees / wanted)))  # where runs that are alike hold fewer than wanted
    while True:
        high = min(BITS, low + max(settings.stride, 0 if low else spread + 2))
        fine = entries.groupBy("dim", "tree", _prefix(F.col("hash"), F.lit(high)).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
        runs = fine.select("dim", "tree", lengths(low, high), F.col("prefix").alias("fine"), "n")
        runs = runs.groupBy("dim", "tree", "length", _prefix(F.col("fine"), F.col("length"), high).alias("prefix")).agg(F.sum("n").alias("n"))
        asked = live.select("key", "dim", "tree", "hash", lengths(low, high)).withColumn("prefix", _prefix(F.col("hash"), F.col("length")))
        sizes = materialize(asked.drop("hash").join(runs, ["dim", "tree", "length", "prefix"], "left").withColumn("n", F.coalesce("n", F.lit(0))), "runs")
        at = sizes.groupBy("key", "length").agg(F.sum("n").alias("all")).where((F.col("all") >= wanted) | (F.col("length") == low)).groupBy("key").agg(F.max("length").alias("length"))
        at = materialize(at, "lengths")
        on = at.where(F.col("length") == high) if high < BITS else at.limit(0)
        ended.append(sizes.join(at if high == BITS else at.where(F.col("length") < high), ["key", "length"]).where("n > 0"))
        if on.isEmpty():
            break
        live = materialize(live.join(on.select("key"), "key", "left_semi"), "descending")
        inside = live.select("dim", "tree", _prefix(F.col("hash"), F.lit(high)).alias("prefix")).distinct()
        entries = materialize(entries.withColumn("prefix", _prefix(F.col("hash"), F.lit(high))).join(sized_broadcast(inside), ["dim", "tree", "prefix"], "left_semi").drop("prefix"), "strings")
        low = high
    every = ended[0]
    for more in ended[1:]:
        every = every.unionByName(more)
    return every.where("length > 0 OR tree = 0").select("key", "dim", "tree", "length", "prefix", "n")


def _scored(k: int):
    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        q = c = np.empty(0, np.int64)
        score = np.empty(0)
        if len(asked) and len(rows):
            dim = asked.column("dim")[0].as_py()
            left, right = _matrix(asked.column("vec"), dim), _matrix(rows.column("vec"), dim)
            firsts, hits = rows.column("first").to_numpy(), []
            for at in range(0, len(left), 256):
                hit = np.argwhere(_top(left[at : at + 256] @ right.T, k + 1))
                hits.append(hit + [at, 0])
            q, c = np.concatenate(hits).T
            score = np.concatenate([(left[q[i : i + 65536]] * right[c[i : i + 65536]]).sum(axis=1) for i in range(0, len(q), 65536)])
            order = np.lexsort((firsts[c], -score, q))
            rank = np.arange(len(order)) - np.searchsorted(q[order], q[order])
            order = order[rank <= k]
            q, c, score = q[order], c[order], score[order]
        return pa.table({"key": asked.column("key").take(pa.array(q)), "near": rows.column("key").take(pa.array(c)), "first": rows.column("first").take(pa.array(c)), "score": pa.array(score)})

    return run


def nearest(vectors: DataFrame, query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k rows with the largest inner products found for each row that ``query`` marks.

    A row is no neighbour of itself. Scores are double precision products of the given vectors, ties go to the smaller id,
    and fewer rows than k give fewer. What takes no part is said in ``points``; vectors of another length than the query's
    are no candidates. Every row is indexed, copies once, and every candidate of a run is scored, whatever its size. An
    empty table gives no rows.
    """
    distinct, asked = points(vectors, query, id_col, vector_col, k)
    largest = distinct.agg(F.max(F.expr("sqrt(aggregate(vec, 0D, (a, x) -> a + cast(x as double) * cast(x as double)))"))).first()[0] or 1.0
    index = materialize(_hashed(distinct.drop("ids"), largest, settings), "strings")
    found = materialize(stops(index, enough(index, settings, k), settings), "stops")
    run = ["dim", "tree", "length", "prefix"]
    groups = found.groupBy(*run).agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("m"))
    groups = materialize(groups.select(*run, F.ceil(F.col("n") / settings.rows).alias("parts"), F.ceil(F.col("m") / settings.queries).alias("chunks")), "groups")
    lengths = sorted(r.length for r in groups.select("length").distinct().collect())  # at most one for each bit
    deal = lambda many: F.pmod(F.xxhash64(F.lit("dealt"), "key"), F.col(many)).cast("int")
    every = lambda many: F.explode(F.sequence(F.lit(0), (F.col(many) - 1).cast("int")))
    small = sized_broadcast(groups)
    left = found.drop("n").join(index.select("key", "vec"), "key").join(small, run).withColumn("chunk", deal("chunks")).withColumn("part", every("parts"))
    rows = index.select("key", "dim", "vec", "first", F.posexplode("own").alias("tree", "hash")).withColumn("length", F.explode(F.array(*map(F.lit, lengths or [0])))).where("length > 0 OR tree = 0")
    rows = rows.withColumn("prefix", _prefix(F.col("hash"), F.col("length"))).join(small, run).withColumn("part", deal("parts")).withColumn("chunk", every("chunks"))
    by = [*run, "part", "chunk"]
    anew = [F.col(c).alias(c) for c in ("key", "vec")]  # both sides come from one table
    met = left.select(*by, *anew).groupBy(*by).cogroup(rows.select(*by, "key", "vec", "first").groupBy(*by))
    kind = "key string, near string, first bigint, score double"
    best = met.applyInArrow(_scored(k), kind).dropDuplicates(["key", "near"])
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "first"))).where(F.col("r") <= k + 1)
    named = materialize(best.select("key", "near", "score"), "nearest").join(distinct.select(F.col("key").alias("near"), "ids"), "near")
    nearby = lambda rows, by: rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "vec_id")))
    answers = nearby(named.select("key", "score", F.explode("ids").alias("vec_id")), "key").where(F.col("rank") <= k + 1).drop("rank")
    ranked = nearby(asked.join(materialize(answers, "answers"), "key").where("vec_id != query_id"), "query_id").where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
