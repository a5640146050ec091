"""Content units: what detection reads, from tables of documents, pages, comments and issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import documents

UNIT = ("connector_type", "resource_id", "sub_resource", "origin", "text", "display")


def units(rows: DataFrame, connector: str, resource: Column, text: Column, *, sub_resource: Column | None = None, origin: str = "body", display: dict[str, Column] | None = None) -> DataFrame:
    """Rows as units; ``display`` holds what is shown of a unit and is no part of its identity."""
    shown = F.create_map(*[x for k, v in (display or {}).items() for x in (F.lit(k), v.cast("string"))]).cast("map<string,string>")
    sub = F.lit(None).cast("string") if sub_resource is None else sub_resource.cast("string")
    return rows.select(F.lit(connector).alias("connector_type"), resource.cast("string").alias("resource_id"), sub.alias("sub_resource"), F.lit(origin).alias("origin"), text.alias("text"), shown.alias("display"))


def wiki_spaces(pages: DataFrame, spaces: list[str] | None = None, personal: bool = False) -> tuple[DataFrame, DataFrame]:
    """Spaces to read, and configured ones that don't exist.

    ``pages`` has ``space_key``. Names are compared in any case. A personal space (``~``) is read only if named
    or asked for.
    """
    found = pages.select("space_key").distinct()
    if spaces:
        wanted = pages.sparkSession.createDataFrame([(s,) for s in {x.lower() for x in spaces}], "wanted string")
        hit = found.join(F.broadcast(wanted), F.lower("space_key") == F.col("wanted"))
        missing = wanted.join(found, F.lower("space_key") == F.col("wanted"), "left_anti")
        return hit.select("space_key"), missing
    kept = found if personal else found.where(~F.col("space_key").startswith("~"))
    return kept, pages.sparkSession.createDataFrame([], "wanted string")


def wiki_units(pages: DataFrame, comments: DataFrame, since: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Units of pages and comments, objects that could not be read, and the highest revision per space.

    ``pages``: ``page_id, space_key, title, revision, resource`` (JSON); ``comments``: ``comment_id, page_id,
    resource``. Pages up to revision ``since`` are left out, undated ones never.
    """
    due = pages if since is None else pages.where(F.col("revision").isNull() | (F.col("revision") > since))
    body = due.withColumn("text", documents.supported_body_text(F.col("resource")))
    notes = comments.join(due.select("page_id", "space_key", "title"), "page_id").withColumn("text", documents.supported_body_text(F.col("resource")))
    shown = {"space": F.col("space_key"), "title": F.col("title")}
    read = units(body.where("text is not null"), "wiki", F.col("page_id"), F.col("text"), display=shown)
    read = read.unionByName(units(notes.where("text is not null"), "wiki", F.col("page_id"), F.col("text"), sub_resource=F.concat(F.lit("comment:"), F.col("comment_id")), origin="comment", display=shown))
    unread = body.where("text is null").select(F.lit("page").alias("kind"), F.col("page_id").cast("string").alias("id"), F.lit("invalid_response").alias("reason"))
    unread = unread.union(notes.where("text is null").select(F.lit("comment"), F.col("comment_id").cast("string"), F.lit("invalid_response")))
    return read, unread, due.groupBy("space_key").agg(F.max("revision").alias("position"))


def replies(comments: DataFrame, most_rounds: int = 64) -> DataFrame:
    """Comments reachable from a page's top ones with their depth, each once; rings that hang on nothing are left out.

    A join a level on narrow rows; each level is written out, so deep threads don't grow the plan.
    """
    from .store import new_folder

    spark = comments.sparkSession
    folder = new_folder(spark, "replies")
    slim = comments.select("comment_id", "parent_id")
    level = slim.where("parent_id is null").select("comment_id", F.lit(0).alias("depth")).distinct()
    for depth in range(most_rounds + 1):
        level.write.parquet(f"{folder}/{depth}")
        level = spark.read.parquet(f"{folder}/{depth}")
        if level.isEmpty():
            break
        level = slim.join(level.select(F.col("comment_id").alias("parent_id")), "parent_id").select("comment_id", F.lit(depth + 1).alias("depth")).distinct()
    else:
        raise ValueError(f"replies nest deeper than {most_rounds}")
    return spark.read.parquet(*[f"{folder}/{d}" for d in range(depth + 1)]).groupBy("comment_id").agg(F.min("depth").alias("depth"))


def issue_units(issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Units of issues from their JSON ``fields``, and issues with a field that could not be read.

    Summary, description and environment are one text; an issue of which one is unread fails as a whole.
    """
    names = ("summary", "description", "environment")
    rows = issues.select("*", *[documents.issue_field_text(F.col("fields"), n).alias(f"_{n}") for n in names])
    whole = F.lit(True)
    for n in names:
        whole = whole & F.col(f"_{n}").isNotNull()
    text = F.concat_ws("\n", *[F.when(F.col(f"_{n}") != "", F.col(f"_{n}")) for n in names])
    read = units(rows.where(whole), "issues", F.col("issue_id"), text, display={"project": F.col("project")})
    return read, rows.where(~whole).select(F.lit("issue").alias("kind"), F.col("issue_id").cast("string").alias("id"), F.lit("invalid_response").alias("reason"))


def field_history(changes: DataFrame, most: int | None = None) -> DataFrame:
    """Texts of an issue's past: every value a field was given, and the one each field had first.

    ``changes``: ``issue_id, entry, field, from_text, to_text``. All entries are read; a caller that asks for the
    first ``most`` of an issue only has to report ``history_gaps`` as well.
    """
    if most is not None:
        changes = _numbered(changes).where(F.col("_n") <= most).drop("_n")
    first = changes.groupBy("issue_id", "field").agg(F.min_by("from_text", "entry").alias("text"), F.min("entry").alias("entry"))
    every = changes.select("issue_id", "field", F.col("to_text").alias("text"), "entry")
    return every.union(first.select("issue_id", "field", "text", "entry")).where("text is not null and text <> ''")


def history_gaps(changes: DataFrame, most: int) -> DataFrame:
    """Issues ``(kind, id, reason)`` with entries past the first ``most``: gaps of the scan's scope."""
    beyond = changes.groupBy("issue_id").agg(F.count_distinct("entry").alias("_n")).where(F.col("_n") > most)
    return beyond.select(F.lit("scope_gap").alias("kind"), F.col("issue_id").cast("string").alias("id"), F.lit("unreported").alias("reason"))


def _numbered(changes: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    return changes.withColumn("_n", F.dense_rank().over(Window.partitionBy("issue_id").orderBy("entry")))
