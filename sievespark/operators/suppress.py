"""Suppressions: which one covers a finding, and what marking or lifting them does to stored findings.

Suppressions are a small table that people write. Those that name a fingerprint or a rule meet findings in
equi-joins; globs are gathered per source (few rows) and tested inside each finding's row, so no pairs are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.globs import regex_of

#: The locator's keys that a glob is held against.
PATH_KEYS = ("path", "url", "space", "space_key", "resource_id", "sub_resource", "title")


def applicable(suppressions: DataFrame, as_of: Column, source_id: str | None = None) -> DataFrame:
    """Those not expired at ``as_of``; with ``source_id`` only its own and the global ones."""
    live = suppressions.where(F.col("expires_at").isNull() | (F.col("expires_at") > as_of))
    return live if source_id is None else live.where(F.col("source_id").isNull() | (F.col("source_id") == source_id))


def paths(locator: Column) -> Column:
    """The locator's values that globs see."""
    return F.filter(F.transform(F.array(*map(F.lit, PATH_KEYS)), lambda k: F.element_at(locator, k)), lambda v: v.isNotNull())


def first_match(findings: DataFrame, suppressions: DataFrame, as_of: Column) -> DataFrame:
    """Adds ``suppression_id``: the first suppression by (created_at, id) that covers the finding, or null.

    ``findings`` has ``source_id, fingerprint, rule_id, resource_locator``. A suppression without a source covers all.
    """
    live = applicable(suppressions, as_of).withColumn("_first", F.struct(F.col("created_at").alias("at"), F.col("id").alias("id")))

    def by(scope: str, column: str, out: str) -> list[tuple[DataFrame, list[str], str]]:
        own = live.where((F.col("scope") == scope) & F.col("source_id").isNotNull()).groupBy(F.col("source_id"), F.col("pattern").alias(column)).agg(F.min("_first").alias(f"{out}_own"))
        every = live.where((F.col("scope") == scope) & F.col("source_id").isNull()).groupBy(F.col("pattern").alias(column)).agg(F.min("_first").alias(f"{out}_all"))
        return [(own, ["source_id", column], f"{out}_own"), (every, [column], f"{out}_all")]

    globs = live.where(F.col("scope") == "path_glob").withColumn("_regex", regex_of(F.col("pattern")))
    gather = F.array_sort(F.collect_list(F.struct(F.col("_first").alias("first"), F.col("_regex").alias("regex"))))
    own_globs = globs.where(F.col("source_id").isNotNull()).groupBy("source_id").agg(gather.alias("_own_globs"))
    all_globs = globs.where(F.col("source_id").isNull()).groupBy(F.lit(1).alias("_one")).agg(gather.alias("_all_globs"))

    rows, marks = findings, []
    for side, keys, mark in [*by("fingerprint", "fingerprint", "_fp"), *by("rule", "rule_id", "_rule")]:
        rows, marks = rows.join(side, keys, "left"), [*marks, mark]
    rows = rows.join(own_globs, "source_id", "left").withColumn("_one", F.lit(1)).join(all_globs, "_one", "left").withColumn("_paths", paths(F.col("resource_locator")))
    hit = lambda name: F.get(F.filter(F.col(name), lambda g: F.exists(F.col("_paths"), lambda p: F.rlike(p, g["regex"]))), F.lit(0))["first"]
    rows = rows.withColumn("_glob_own", hit("_own_globs")).withColumn("_glob_all", hit("_all_globs"))
    first = F.array_min(F.filter(F.array(*marks, "_glob_own", "_glob_all"), lambda x: x.isNotNull()))
    return rows.withColumn("suppression_id", first["id"]).select(*findings.columns, "suppression_id")


def split(findings: DataFrame, suppressions: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Candidates that stay and those that a suppression covers."""
    matched = first_match(findings, suppressions, as_of)
    return matched.where("suppression_id is null").drop("suppression_id"), matched.where("suppression_id is not null")


def apply(findings: DataFrame, suppressions: DataFrame, as_of: Column) -> DataFrame:
    """Stored findings after new suppressions: globs mark open ones only, the other scopes any; an earlier mark stays."""
    wide = first_match(findings, suppressions.where("scope <> 'path_glob'"), as_of).withColumnRenamed("suppression_id", "_any")
    both = first_match(wide, suppressions.where("scope = 'path_glob'"), as_of)
    found = F.coalesce("_any", F.when(F.col("state") == "open", F.col("suppression_id")))
    marked = both.withColumn("suppressed_by_id", F.coalesce(F.col("suppressed_by_id"), found))
    return marked.withColumn("suppressed_at", F.when(F.col("suppressed_by_id").isNotNull(), F.coalesce("suppressed_at", as_of))).select(*findings.columns)


def release(findings: DataFrame, suppressions: DataFrame, as_of: Column) -> DataFrame:
    """Stored findings once suppressions have lapsed or gone: another live one takes over silently, else the mark goes."""
    live = applicable(suppressions, as_of).select(F.col("id").alias("suppressed_by_id"), F.lit(True).alias("_live"))
    rows = first_match(findings.join(live, "suppressed_by_id", "left"), suppressions, as_of)
    keeper = F.when(F.col("suppressed_by_id").isNull() | F.coalesce("_live", F.lit(False)), F.col("suppressed_by_id")).otherwise(F.col("suppression_id"))
    return rows.withColumn("suppressed_by_id", keeper).withColumn("suppressed_at", F.when(F.col("suppressed_by_id").isNotNull(), F.col("suppressed_at"))).select(*findings.columns)
