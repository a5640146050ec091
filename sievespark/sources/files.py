"""Files of a share as content units.

Spark's own readers pass over hidden files, which are those that hold credentials, so a share is walked here: in rounds,
one a level of folders, each a job over the folders found by the last one. The driver lists nothing; it only learns
whether there is another level.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.extract import Limits, extract, reason_of
from ..functions.globs import selected
from .store import new_folder
from .units import units

#: Bytes and files that one reading task is meant to get, and bytes that it hands on at a time.
TASK_BYTES, TASK_FILES, BATCH_BYTES = 64 << 20, 500, 8 << 20
ENTRY = "kind string, relative string, real string, length bigint"


def _entries(root: str, relative: str) -> Iterator[tuple[str, str, str, int]]:
    """What one folder holds, sorted by name: ``(kind, path below the root, real path, length)``.

    A link that leads out of the root is no entry. A folder that can't be listed is one entry, a gap with its reason.
    """
    store, top = fs.FileSystem.from_uri(root)
    top, local = top.rstrip("/"), isinstance(store, fs.LocalFileSystem)
    home = os.path.realpath(top) if local else top
    try:
        found = sorted(store.get_file_info(fs.FileSelector(f"{top}/{relative}" if relative else top)), key=lambda e: e.base_name)
    except OSError as e:
        yield ("permission_denied" if isinstance(e, PermissionError) else "missing_resource"), relative, "", 0
        return
    for e in found:
        real = os.path.realpath(e.path) if local else e.path
        if local and os.path.commonpath([real, home]) != home:
            continue
        kind = {fs.FileType.Directory: "folder", fs.FileType.File: "file"}.get(e.type)
        if kind:
            yield kind, e.path[len(top) + 1 :], real, e.size or 0


def _root(root: str) -> str:
    if "://" not in root or ".." in root.split("/"):
        raise ValueError("root is the URI of a folder and may not climb")
    store, top = fs.FileSystem.from_uri(root)
    return os.path.realpath(top) if isinstance(store, fs.LocalFileSystem) else top.rstrip("/")


def walk(spark: SparkSession, root: str, depth: int = 64, entries: int | None = None, files: int | None = None) -> DataFrame:
    """``(kind, relative, length)`` of a root's files, hidden ones too, and a row for each folder that can't be listed.

    Breadth first, a Spark job a level. A folder is entered once, by its real path: of several ways to it the one with the
    fewest levels counts, then the smallest name, and rings of links end. More levels than ``depth``, and more entries of a
    folder or files in all than allowed, where a bound is asked for, are an error, so no part of a share passes for the whole.
    """
    at, width = new_folder(spark, "walk"), spark.sparkContext.defaultParallelism

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for relative in batch.column(0).to_pylist():
                rows = list(_entries(root, relative))
                if entries is not None and len(rows) > entries:
                    raise ValueError(f"a folder has more than {entries} entries")
                for i in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[i : i + 10_000]), (pa.string(), pa.string(), pa.string(), pa.int64()))], names=["kind", "relative", "real", "length"])

    read = lambda *names: spark.read.schema(ENTRY).parquet(*[f"{at}/{n}" for n in names])
    spark.createDataFrame([("folder", "", _root(root), 0)], ENTRY).write.parquet(f"{at}/new0")
    for level in range(depth + 1):
        ahead = read(f"new{level}")
        ahead.select("relative").repartition(min(4 * width, max(1, ahead.count()))).mapInArrow(run, ENTRY).write.parquet(f"{at}/found{level}")
        below = read(f"found{level}").where("kind = 'folder'").groupBy("kind", "real").agg(F.min("relative").alias("relative"), F.max("length").alias("length"))
        entered = read(*[f"new{n}" for n in range(level + 1)]).select("real")
        below.join(entered, "real", "left_anti").select("kind", "relative", "real", "length").write.parquet(f"{at}/new{level + 1}")
        if read(f"new{level + 1}").isEmpty():
            break
    else:
        raise ValueError(f"folders nest deeper than {depth}")
    found = read(*[f"found{n}" for n in range(level + 1)]).where("kind <> 'folder'").drop("real")
    if files is not None and found.where("kind = 'file'").count() > files:
        raise ValueError(f"the root has more than {files} files")
    return found


def contents(found: DataFrame, root: str, input_bytes: int = Limits.input_bytes) -> DataFrame:
    """``relative, length, content`` of files ``(relative, length)``, dealt to tasks by their bytes.

    Content over ``input_bytes``, or that can't be read, is null.
    """
    sums = found.agg(F.count(F.lit(1)).alias("n"), F.sum(F.least("length", F.lit(input_bytes))).alias("bytes")).first()
    tasks = max(1, math.ceil(sums["n"] / TASK_FILES), math.ceil((sums["bytes"] or 0) / TASK_BYTES))
    names, kinds = ["relative", "length", "content"], (pa.string(), pa.int64(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(root)
        rows, held = [], 0
        for batch in batches:
            for relative, length in zip(*(c.to_pylist() for c in batch.columns)):
                content = None
                if length <= input_bytes:
                    try:
                        with store.open_input_stream(f"{top.rstrip('/')}/{relative}") as f:
                            content = f.read(input_bytes + 1)
                    except OSError:
                        pass
                rows.append((relative, length, content))
                held += len(content or b"")
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=names)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=names)

    return found.select("relative", "length").repartition(tasks).mapInArrow(run, "relative string, length bigint, content binary")


def listed(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, input_bytes: int = Limits.input_bytes, **bounds: int) -> DataFrame:
    """``relative, length, content`` of a root's files; globs see the path below the root, an excluding one wins.

    ``bounds`` are those of ``walk``. Content over ``input_bytes``, or that can't be read, is null.
    """
    files = walk(spark, root, **bounds).where("kind = 'file'")
    return contents(files.where(selected(F.col("relative"), include or [], exclude or [])), root, input_bytes)


def file_units(files: DataFrame, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """Units of readable files, and a coverage row for each file that wasn't read whole.

    A file over the size limit is told by its length and never loaded; one that could not be opened has failed.
    """
    small = files.where(F.col("length") <= limits.input_bytes)
    read = extract(small.select("relative", "length", "content"), "relative", "content", limits)
    large = files.where(F.col("length") > limits.input_bytes).select("relative", F.lit("rejected_too_large").alias("outcome"), F.lit(False).alias("truncated"))
    text = units(read.where("outcome = 'extracted'"), "files", F.col("relative"), F.col("text"), origin="attachment", display={"path": F.col("relative"), "truncated": F.col("truncated")})
    rows = read.select("relative", "outcome", "truncated").where("outcome <> 'extracted' or truncated").unionByName(large)
    reason = F.when(F.col("outcome") == "extracted", "output_limit").otherwise(reason_of(F.col("outcome")))
    disposition = F.when(F.col("outcome").startswith("skipped"), "skipped").otherwise("failed")
    return text, rows.select(F.col("relative").alias("id"), disposition.alias("disposition"), reason.alias("reason"))
