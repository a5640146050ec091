"""How quality filters act on each other, over every order in which they can be applied.

A document meets the filters only through the set of those it fails, a mask. Documents are counted by part and mask once,
in tasks before the shuffle; whatever an order of filters does is then a product of integer matrices: the histograms, one
row per part (and one each for labelled good and toxic documents), times incidence matrices with a row per mask and a
column per order and step. For five filters these are 32 by 600, and no order ever looks at a document again.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_BREAK, materialize

#: The filters' letters in the order of their bits.
FILTERS = "ABCDE"
#: Parts multiplied at a time.
_PARTS = 64


def incidence(filters: str = FILTERS) -> tuple[list[str], dict[str, np.ndarray]]:
    """The orders of ``filters`` and, by outcome, the 0/1 matrix with a row per mask and a column per order and step.

    ``kept``: no filter up to this step fails the mask; ``removed``: this one is the first that does; ``redundant``: this one
    does and an earlier one did; ``unique``: this one does and no other.
    """
    orders = ["".join(p) for p in permutations(filters)]
    bits = np.array([[1 << filters.index(x) for x in order] for order in orders])
    before = np.cumsum(bits, axis=1) - bits
    bit, before, mask = bits.ravel(), before.ravel(), np.arange(1 << len(filters))[:, None]
    fails, gone = mask & bit != 0, mask & before != 0
    cases = {"kept": mask & (before | bit) == 0, "removed": fails & ~gone, "redundant": fails & gone, "unique": mask == bit}
    return orders, {k: v.astype(np.int64) for k, v in cases.items()}


def audit(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """``(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)``.

    ``masks`` has a row per document: ``part``, ``mask`` (bit i set if it fails filter i), ``good`` and ``toxic``. Every part
    that a document has gets a row for each order and step, zeros included. ``shapley`` sums ``removed`` of the step's
    filter over all orders, wherever it stands in them. An empty table gives no rows.
    """
    n, long = 1 << len(filters), lambda c: F.sum(c.cast("bigint"))
    by_mask = masks.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("docs"), long(F.col("good")).alias("good"), long(F.col("toxic")).alias("toxic"))
    stacked = by_mask.groupBy("part").agg(F.collect_list(F.struct("mask", "docs", "good", "toxic")).alias("cells"))
    orders, cases = incidence(filters)
    own = np.array([filters.index(x) for order in orders for x in order])
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _PARTS):
                rows = batch.slice(at, _PARTS).to_pylist()
                hist = np.zeros((3, len(rows), n), np.int64)
                for i, row in enumerate(rows):
                    for cell in row["cells"]:
                        hist[:, i, cell["mask"]] = cell["docs"], cell["good"], cell["toxic"]
                docs, good, toxic = hist
                removed = docs @ cases["removed"]
                shapley = np.stack([removed[:, own == f].sum(axis=1) for f in range(len(filters))], axis=1)[:, own]
                found = [docs @ cases["kept"], removed, docs @ cases["redundant"], docs @ cases["unique"], good @ cases["removed"], toxic @ cases["removed"], shapley]
                keys = [np.repeat([r["part"] for r in rows], len(own)), np.tile(np.repeat(orders, len(filters)), len(rows)), np.tile(np.arange(1, len(filters) + 1, dtype=np.int32), len(orders) * len(rows))]
                yield pa.RecordBatch.from_arrays([pa.array(x.tolist() if x.dtype.kind == "U" else x.ravel()) for x in keys + found], names=names)

    return stacked.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{x} bigint" for x in names[3:]))


def text_failures(text: Column) -> dict[str, Column]:
    """Whether a text fails each of the filters that look at nothing else: too few words, too repetitive, too many
    capitals, odd symbols. The limits are the audit's fixed ones; a null text is an empty one."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, WORD_BREAK), "")
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 10 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def document_masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``(part, mask, good, toxic)`` per row of ``docs`` for the filters ``ABCDE``, E being a text that a smaller id has.

    Texts are read once and never shuffled: what meets is ids and digests. A null text equals the empty one, a null part is
    the empty string. Rows with the smallest id of their text pass E, repeats of it too; a null id is no smaller than any
    and passes. A document is good or toxic if any of its labels says so; labels of no document count nowhere.
    """
    tests = text_failures(F.col(text_col))
    bits = sum((F.when(v, 1 << i).otherwise(0) for i, v in enumerate(tests.values())), F.lit(0))
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), bits.alias("own"), digest.alias("digest"))
    slim = materialize(slim, "masks")
    many = slim.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).where("n > 1").select("digest", "first")
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = slim.join(materialize(many, "copies"), "digest", "left").join(marks, "id", "left")
    copy = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    return rows.select("part", (F.col("own") + F.when(copy, 1 << 4).otherwise(0)).alias("mask"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])


#: The twin: masks by the same five rules, then every order by a recursive walk instead of matrices.
AUDIT_SQL = r"""with recursive base as (
    select d.doc_id, coalesce(d.lang, '') as part, coalesce(d.text, '') as t from documents d),
words as (select *, [x for x in string_split_regex(t, '[\x20\x09-\x0D]+') if x <> ''] as w from base),
firsts as (select t, min(doc_id) as first from base group by t),
marks as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
doc as (select part, len(w) < 100 as a, 100 * len(list_distinct(w)) < 80 * len(w) as b, 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t) as c,
    regexp_matches(t, '[#$%&*|]') as d, coalesce(words.doc_id > first, false) as e, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic
    from words join firsts using (t) left join marks on words.doc_id = marks.doc_id),
cell as (select part, (case when a then 'A' else '' end) || (case when b then 'B' else '' end) || (case when c then 'C' else '' end) || (case when d then 'D' else '' end) || (case when e then 'E' else '' end) as fails,
    count(*) as n, sum(good) as good, sum(toxic) as toxic from doc group by all),
orders(o) as (select '' union all select o || l from orders, (values ('A'), ('B'), ('C'), ('D'), ('E')) v(l) where not contains(o, l)),
steps as (select o as filter_order, s as step, o[s] as f, o[1:s - 1] as earlier from orders, range(1, 6) r(s) where length(o) = 5),
met as (select part, filter_order, step, f, n, good, toxic, fails, contains(fails, f) as failing, length(translate(fails, earlier, '')) < length(fails) as gone from cell, steps),
counted as (select part, filter_order, step, f, coalesce(sum(n) filter (where not failing and not gone), 0) as kept, coalesce(sum(n) filter (where failing and not gone), 0) as removed,
    coalesce(sum(n) filter (where failing and gone), 0) as redundant, coalesce(sum(n) filter (where fails = f), 0) as unique_fails,
    coalesce(sum(good) filter (where failing and not gone), 0) as good_lost, coalesce(sum(toxic) filter (where failing and not gone), 0) as toxic_lost from met group by all)
select part, filter_order, cast(step as integer) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
    cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, f) as bigint) as shapley from counted"""
