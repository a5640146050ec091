"""Edited copies: exact Jaccard similarity of word shingles, over candidates from MinHash bands.

The 64-bit pigeonring of ``simhash`` is for two bits. Edited copies differ in about ten, and with a budget of ten
the leading prefixes that must be equal shrink to six bits of 64, a join key that makes pairs with the square of the
corpus. A band of five MinHashes is shared by chance almost never, so candidates stay in proportion to the copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, materialize_narrow, own_caches, sized_broadcast, text_bytes
from .components import connected_components
from .simhash import classes_of

#: Words a shingle; least similarity in percent; bands and MinHashes a band: a pair at 80 % shares one with 0.9997.
SHINGLE, SIMILAR, BANDS, ROWS = 5, 80, 20, 5
#: Texts of a band's bucket that are compared pairwise; in larger buckets each text first meets so many leaders.
BUCKET, LEADERS = 32, 8
#: Counters of shingles, by which differences are ordered: the bound of what the driver holds and sends.
COUNTERS = 1 << 18
#: Sets are similar if _SUM times their symmetric difference is at most _GAP times the sum of their sizes.
_SUM, _GAP = 100 + SIMILAR, 100 - SIMILAR
_BLOCK, _SLICE = 1 << 12, 256
_MIX = np.random.default_rng(42).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
_MIX[0] |= np.uint64(1)


def shingles(raw: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; a text of fewer words is one shingle, a blank one has none."""
    words = raw.lower().split()
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)] if words else [], np.uint64)
    grams = zip(*(words[i:] for i in range(size)))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams), np.uint64, len(words) - size + 1))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A 64-bit key a band of MinHashes; none for a blank text."""
    if not len(hashes):
        return np.empty(0, np.int64)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _BLOCK):
        low = np.minimum(low, (hashes[at : at + _BLOCK, None] * _MIX[0] + _MIX[1]).min(axis=0))
    return np.fromiter((xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(low.reshape(BANDS, ROWS))), np.uint64, BANDS).view(np.int64)


def _per_text(rows: DataFrame, schema: str, of) -> DataFrame:
    """The columns of ``rows`` but ``raw``, then the arrays that ``of`` gives for the shingles of each ``raw``."""
    keep = [c for c in rows.columns if c != "raw"]
    names = [x.split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_caches("near_copies")
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                found = of([shingles(x.as_py()) for x in part.column("raw")])
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + found, names=names)

    return rows.mapInArrow(run, schema)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([x.view(np.int64) for x in arrays], pa.list_(pa.int64()))


def _prints(sets: list[np.ndarray]) -> list[pa.Array]:
    fp = np.fromiter((xxhash.xxh64_intdigest(h.tobytes(), 42) if len(h) else 0 for h in sets), np.uint64, len(sets))
    return [pa.array(fp.view(np.int64)), pa.array([len(h) for h in sets], pa.int64()), _lists([bands(h) for h in sets])]


def _band_sizes(distinct: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bands ``(c, key, m, leaders)`` that more than one text has, and their texts ``(c, key, fp, n, m)``."""
    keys = distinct.select("fp", "n", F.posexplode("bands").alias("c", "key"))
    orders = [F.min(F.struct(F.xxhash64("fp", F.lit(i)).alias("o"), "fp", "n")).alias(f"l{i}") for i in range(LEADERS)]
    found = keys.groupBy("c", "key").agg(F.count(F.lit(1)).alias("m"), *orders).where("m > 1")
    sizes = materialize_narrow(found.select("c", "key", "m", F.array(*[f"l{i}" for i in range(LEADERS)]).alias("leaders")), "bands")
    return sizes, materialize_narrow(keys.join(sizes.select("c", "key", "m"), ["c", "key"]), "live-bands")


def _sizes_allow(a: str, b: str):
    return 100 * F.least(a, b) >= SIMILAR * F.greatest(a, b)


def candidates(sizes: DataFrame, live: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of ``fp`` that share a band and whose sizes allow the similarity.

    Buckets of up to ``BUCKET`` texts give all pairs. In larger ones each text meets the ``LEADERS`` smallest
    by as many fixed orders, the same in all bands, so a hot bucket costs rows in proportion to its size.
    """
    few = live.where(F.col("m") <= BUCKET)
    x = few.select("c", "key", F.col("fp").alias("a"), F.col("n").alias("na"))
    y = few.select("c", "key", F.col("fp").alias("b"), F.col("n").alias("nb"))
    pairs = x.join(y, ["c", "key"]).where("a < b").select("a", "na", "b", "nb")
    hot = sizes.where(F.col("m") > BUCKET).select("c", "key", "leaders")
    met = live.join(hot, ["c", "key"]).select("fp", "n", F.explode(F.array_distinct("leaders")).alias("l")).where("fp != l.fp")
    stars = met.select(F.least("fp", "l.fp").alias("a"), F.col("n").alias("na"), F.greatest("fp", "l.fp").alias("b"), F.col("l.n").alias("nb"))
    return pairs.union(stars).where(_sizes_allow("na", "nb")).select("a", "b").distinct()


def _sets(ends: DataFrame, docs: DataFrame, distinct: DataFrame, text_col: str) -> DataFrame:
    """``(fp, grams)`` of the given ``fp``; only their texts are cut again."""
    ends = sized_broadcast(distinct.join(ends, "fp", "left_semi").select("fp", "text_key"))
    raw = docs.select(F.xxhash64(text_col).alias("text_key"), text_bytes(text_col).alias("raw"))
    texts = raw.join(ends, "text_key").select("fp", "raw").dropDuplicates(["fp"])
    return materialize(_per_text(texts, "fp bigint, grams array<bigint>", lambda sets: [_lists(sets)]), "shingles")


def _shared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``(a, b, i, s)``: how many shingles both hold and the sum of what each holds."""
    both = pairs.join(sets.select(F.col("fp").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("fp").alias("b"), F.col("grams").alias("y")), "b")
    return both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("i"), (F.size("x") + F.size("y")).alias("s"))


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose shingles are similar enough, counted exactly."""
    shared = _shared(pairs, sets)
    return materialize_narrow(shared.where(100 * F.col("i") >= SIMILAR * (F.col("s") - F.col("i"))).select("a", "b"), "links")


def differences(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``rows`` ``(fp, ref, …)`` with ``n`` and ``base``, the sizes of both sets, and ``diff``, what only one of the two holds."""
    both = rows.join(sets, "fp").join(sets.select(F.col("fp").alias("ref"), F.col("grams").alias("others")), "ref")
    diff = F.concat(F.array_except("grams", "others"), F.array_except("others", "grams")).alias("diff")
    return materialize(both.select(*rows.columns, F.size("grams").cast("bigint").alias("n"), F.size("others").cast("bigint").alias("base"), diff), "differences")


def _far():
    return F.lit(_SUM) * F.size("diff") > F.lit(_GAP) * (F.col("n") + F.col("base"))


def ordered(diffs: DataFrame) -> DataFrame:
    """``(fp, ref, root, apart, n, d, far, near_by, at, gram)``: the differences, those first that few texts of a ref have.

    The order is by a counter of ``COUNTERS`` that ref and shingle fall into, then by shingle; ``at`` counts from one.
    Two texts that are similar to their ref are linked by it, so one of a pair still to be found is ``far``. Against a
    far text the ``near_by`` first ones hold a shared one; a far text gives all.
    """
    slot = F.pmod(F.col("gram").bitwiseXOR(F.col("ref")), F.lit(COUNTERS)).alias("slot")
    counted = diffs.select("ref", F.explode("diff").alias("gram")).groupBy(slot).agg(F.count(F.lit(1)).alias("count"))
    counts = np.zeros(COUNTERS, np.int64)
    for row in counted.toLocalIterator():
        counts[row["slot"]] = row["count"]
    shared = diffs.sparkSession.sparkContext.broadcast(counts)
    keep = ["fp", "ref", "root", "apart", "n", "d", "far", "near_by"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                found = []
                for ref, far, near_by, diff in zip(*(part.column(c).to_pylist() for c in ("ref", "far", "near_by")), part.column("diff")):
                    diff = diff.values.to_numpy()
                    found.append(diff[np.lexsort((diff, shared.value[(diff ^ ref) % COUNTERS]))][: len(diff) if far else near_by])
                many = [len(f) for f in found]
                columns = [part.column(c).take(pa.array(np.repeat(np.arange(len(many)), many))) for c in keep]
                columns += [pa.array(np.concatenate([np.arange(1, m + 1) for m in many])), pa.array(np.concatenate(found))]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "at", "gram"])

    d = F.size("diff").cast("bigint").alias("d")
    near_by = F.expr(f"size(diff) - ({_SUM} * size(diff) + {_GAP} * (base - n)) div {2 * _SUM}").alias("near_by")
    rows = diffs.where(F.size("diff") > 0).select("fp", "ref", "root", "apart", "n", d, _far().alias("far"), near_by, "diff")
    return rows.mapInArrow(run, "fp bigint, ref bigint, root bigint, apart boolean, n bigint, d bigint, far boolean, near_by bigint, at bigint, gram bigint")


def _open_lists(rows: DataFrame) -> DataFrame:
    """The ``rows`` that may meet a similar text of another class in their list ``(ref, gram)``.

    Of a pair with one far text the other has the first shared difference among its ``near_by`` first, so has the far one
    if both are. Such rows meet each other, and those behind them in a far text only the first of texts that are not far.
    What many far texts merely lack of their ref stands in few of them so early, and keeps no rows.
    """
    early, far, root = F.col("at") <= F.col("near_by"), F.col("far"), F.col("root")
    roles = {"early": early, "late": ~early, "near": early & ~far}
    lists = rows.groupBy("ref", "gram").agg(*[f(F.when(test, c)).alias(f"{role}_{name}") for role, test in roles.items() for name, f, c in (("a", F.min, root), ("b", F.max, root), ("apart", F.max, F.col("apart")))])
    lists = lists.where("early_a != early_b OR late_a != near_b OR near_a != late_b")
    other = lambda role: ((F.col(f"{role}_a") != root) | (F.col(f"{role}_b") != root)) & (F.col("apart") | F.col(f"{role}_apart"))
    meets = F.when(early & other("early"), True).when(early & ~far & other("late"), True).when(~early & other("near"), True).otherwise(False)
    return rows.join(lists, ["ref", "gram"]).where(meets).select(*rows.columns)


def _met(x: DataFrame, y: DataFrame, on: list[str]) -> DataFrame:
    """The joins whose rows grow with a group, in one place for the test that counts them."""
    return x.join(y, on)


def star_candidates(rows: DataFrame, turn: int) -> DataFrame:
    """Pairs ``(a, b)`` of the smallest text of each list, by an order of its own each turn, with those of other classes.

    The order is the same in all lists, so a group of texts that share many differences meets one or two texts of its
    own, however many lists they share: rows in proportion to the group, and next to no pairs but true ones.
    """
    first = rows.groupBy("ref", "gram").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "fp").alias("o"), "fp", "root", F.col("n").alias("m"))).alias("l"))
    met = _met(rows, first, ["ref", "gram"]).where(F.col("root") != F.col("l.root")).where(_sizes_allow("n", "l.m"))
    return met.select(F.least("fp", "l.fp").alias("a"), F.greatest("fp", "l.fp").alias("b")).distinct()


def reachable(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """``(ref, fp, class)``: the classes besides its own in which a text of these lists may still have a similar one.

    One less the Jaccard similarity is a metric. A class reaches from its smallest text as far as its farthest, and a
    text farther from that one than the reach and the distance allowed has nobody there. Each text meets one text a
    class, so groups that share a list without being alike cost their texts, not their pairs. Rows meet
    as ``_open_lists`` says.
    """
    early = F.col("at") <= F.col("near_by")
    slim = rows.select("ref", "gram", "fp", "root", "apart", early.alias("early"), (~early).alias("late"), (early & ~F.col("far")).alias("near"))
    reps = slim.groupBy("ref", "root").agg(F.min("fp").alias("rep"))
    own = materialize_narrow(slim.select("ref", "root", "fp").distinct().join(reps, ["ref", "root"]), "members")
    sides = []
    for mine, theirs in (("early", "early"), ("late", "near"), ("near", "late")):
        classes = slim.where(theirs).groupBy("ref", "gram", F.col("root").alias("class")).agg(F.max("apart").alias("some_apart"))
        sides.append(_met(slim.where(mine), classes, ["ref", "gram"]).where("root != class AND (apart OR some_apart)").select("ref", "fp", "class"))
    other = sides[0].union(sides[1]).union(sides[2]).distinct()
    other = materialize_narrow(other.join(reps.withColumnRenamed("root", "class"), ["ref", "class"]), "others")
    pairs = own.select("fp", "rep").union(other.select("fp", "rep")).where("fp != rep").distinct()
    apart = _shared(pairs.select(F.col("fp").alias("a"), F.col("rep").alias("b")), sets).select(F.col("a").alias("fp"), F.col("b").alias("rep"), F.expr("1 - i / (s - i)").alias("apart"))
    apart = materialize_narrow(apart, "apart")
    reach = own.join(apart, ["fp", "rep"], "left").groupBy("ref", F.col("root").alias("class")).agg(F.max(F.coalesce("apart", F.lit(0.0))).alias("reach"))
    held = other.join(apart, ["fp", "rep"]).join(reach, ["ref", "class"])
    return held.where(F.col("apart") <= F.col("reach") + F.lit(1 - SIMILAR / 100 + 1e-9)).select("ref", "fp", "class")


def late_candidates(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` in different classes whose differences from one ref share enough to be similar.

    The first shared one of a pair bounds how many follow it; what cannot suffice is left out inside the join, and only
    texts that can reach each other's class come to it.
    """
    near = materialize_narrow(reachable(rows, sets), "reachable")
    side = lambda to: rows.select("ref", "gram", *[F.col(c).alias(c + to) for c in ("fp", "root", "apart", "n", "d", "at", "far", "near_by")])
    x = side("x").where("farx").join(near.select("ref", F.col("fp").alias("fpx"), F.col("class").alias("rooty")), ["ref", "fpx"])
    y = side("y").where("aty <= near_byy").join(near.select("ref", F.col("fp").alias("fpy"), F.col("class").alias("rootx")), ["ref", "fpy"])
    most = 1 + F.least(F.expr("dx - atx"), F.expr("dy - aty"))
    enough = 2 * _SUM * most >= F.expr(f"{_SUM} * (dx + dy) - {_GAP} * (nx + ny)")
    met = _met(x, y, ["ref", "gram", "rootx", "rooty"]).where("(apartx OR aparty) AND (NOT fary OR atx <= near_byx)").where(enough)
    return met.select(F.least("fpx", "fpy").alias("a"), F.greatest("fpx", "fpy").alias("b")).distinct()


def late_links(rows: DataFrame, sets: DataFrame, turns: int = 2) -> DataFrame:
    """Links ``(a, b)`` of similar texts in different classes among the ``ordered`` rows, together with ``turns`` of stars.

    Every turn each list's smallest text is compared with the others; what that joins is one class for the next turn.
    What the stars leave in several classes is compared as ``late_candidates`` says, so no link between classes is lost.
    """
    rows, found = materialize_narrow(_open_lists(rows), "open-lists"), None
    for turn in range(turns):
        if rows.isEmpty():
            break
        new = _similar(materialize_narrow(star_candidates(rows, turn), "stars"), sets)
        found = new if found is None else found.union(new)
        joined = rows.select("fp", "root").distinct().join(new.select(F.col("a").alias("fp"), "b").union(new.select(F.col("b").alias("fp"), F.col("a").alias("b"))), "fp")
        ends = joined.join(rows.select(F.col("fp").alias("b"), F.col("root").alias("to")).distinct(), "b")
        roots = connected_components(ends.select("root", "to"), "root", "to")
        merged = rows.join(roots.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").withColumn("root", F.coalesce("to", "root")).drop("to")
        rows = materialize_narrow(_open_lists(merged.select(*rows.columns)), "open-lists")
    if not rows.isEmpty():
        late = _similar(materialize_narrow(late_candidates(rows, sets), "late-candidates"), sets)
        found = late if found is None else found.union(late)
    return rows.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0) if found is None else found


def unsettled(live: DataFrame, roots: DataFrame) -> DataFrame:
    """``(fp, ref, root, apart)`` of the texts in large buckets that the links so far leave in several classes.

    ``ref`` is a text of such a bucket that shares most bands with others, or one that shares still more and stands in
    another bucket with it. The order is the same in all buckets, so those of one group have few refs and a text stands
    with few of them. ``apart`` marks those outside the most frequent class of a bucket with that ref. Two texts of a
    bucket in different classes are both here with one ref, and one of them is apart.
    """
    hot = live.where(F.col("m") > BUCKET).join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    hot = materialize_narrow(hot.select("c", "key", "m", "fp", F.coalesce("root", "fp").alias("root")), "hot-bands")
    shares = hot.groupBy("c", "key", "root").agg(F.count(F.lit(1)).alias("m"))
    mains = shares.groupBy("c", "key").agg(F.max(F.struct("m", "root")).alias("main"), F.count(F.lit(1)).alias("classes"))
    mains = mains.where("classes > 1").select("c", "key", F.col("main.root").alias("main"))
    open_ = materialize_narrow(hot.join(mains, ["c", "key"]), "open-bands")
    met = open_.join(open_.groupBy("fp").agg(F.sum("m").alias("met")), "fp")
    best = met.groupBy("c", "key").agg(F.max(F.struct("met", "fp")).alias("best"))
    leads = met.join(best, ["c", "key"]).groupBy("fp").agg(F.max("best")["fp"].alias("ref"))
    refs = best.select("c", "key", "best.fp").join(leads, "fp").select("c", "key", "ref")
    rows = open_.join(refs, ["c", "key"]).groupBy("fp", "ref")
    return materialize_narrow(rows.agg(F.first("root").alias("root"), F.max(F.col("root") != F.col("main")).alias("apart")), "unsettled")


def links(docs: DataFrame, distinct: DataFrame, text_col: str = "text") -> DataFrame:
    """Links ``(a, b)`` of similar texts, every one counted exactly, that join all similar texts which share a band.

    Small buckets compare their pairs, large ones meet leaders. Where this leaves a large bucket in several classes,
    its texts are held against each other by how they differ from its most central text, which links those similar to
    it. Texts that are alike only because both resemble it share too little there to make a pair; texts that share
    changes are compared by ``late_links``. No bucket's size loses a link.
    """
    sizes, live = _band_sizes(distinct)
    pairs = materialize_narrow(candidates(sizes, live), "candidates")
    ends = pairs.select(F.col("a").alias("fp")).union(pairs.select(F.col("b").alias("fp"))).distinct()
    near = _similar(pairs, _sets(ends, docs, distinct, text_col))
    if sizes.where(F.col("m") > BUCKET).isEmpty():
        return near
    rest = unsettled(live, connected_components(near, "a", "b"))
    if rest.isEmpty():
        return near
    sets = _sets(rest.select("fp").distinct(), docs, distinct, text_col)
    owners = rest.groupBy(F.col("fp").alias("ref")).agg(F.first("root").alias("owner"))
    diffs = differences(rest.join(owners, "ref"), sets)
    central = diffs.where(~_far() & (F.col("fp") != F.col("ref"))).select(F.least("fp", "ref").alias("a"), F.greatest("fp", "ref").alias("b"))
    joined = diffs.withColumn("root", F.when(_far(), F.col("root")).otherwise(F.col("owner")))
    return near.union(central).union(late_links(materialize(ordered(joined), "ordered"), sets))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp, component)`` per row of ``docs``, fp telling sets of shingles apart; as ``simhash.near_duplicates``."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("raw"), F.xxhash64(text_col).alias("text_key"))
    prints = materialize(_per_text(rows, f"id {kind}, text_key bigint, fp bigint, n bigint, bands array<bigint>", _prints), "prints")
    distinct = materialize(prints.dropDuplicates(["fp"]).select("fp", "n", "bands", "text_key"), "distinct-shingles")
    return classes_of(prints.select("id", "fp"), links(docs, distinct, text_col))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its class; null ids have no class and stay, as do repeats of the smallest."""
    ids = near_copies(docs, id_col, text_col)
    drop = sized_broadcast(ids.where(F.col("id") != F.col("component")).select(F.col("id").alias(id_col)).distinct())
    return docs.join(drop, id_col, "left_anti").select(*docs.columns)
