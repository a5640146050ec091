"""Tables of a folder under one line of versions.

A version is one small file that names, for each table, the list of its data files. It appears whole or not at all, so
several tables change together or none does, and readers of an older version keep what they see. Data files are never
changed: a table is kept by ranges (a source, and a stretch of its keys' hashes), and a change writes new files for the
ranges it touches and takes the other files over as they are. What no kept version names is deleted by ``expire``.

Two writers may start from one version; the second to publish is refused and starts again from the newer one.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILES = "range string, path string, n bigint"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` or the context's checkpoint folder; where
    neither is set a temporary one on a local master, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


class Conflict(RuntimeError):
    """Another writer has published meanwhile."""


@dataclass(frozen=True)
class Layout:
    """What a row's range is: its source and the first ``width`` hex digits of its key's hash, 16^width ranges a source."""

    source: str = "source_id"
    key: str = "fingerprint"
    width: int = 2

    def range_of(self, source: Column | None = None, key: Column | None = None) -> Column:
        part = lambda c, n: F.substring(F.md5(F.coalesce(c.cast("string"), F.lit(""))), 1, n)
        return F.concat(part(F.col(self.source) if source is None else source, 8), F.lit("-"), part(F.col(self.key) if key is None else key, self.width))


@dataclass(frozen=True)
class Change:
    """New rows of a table: all of them (``replace``), more of them (``append``), or those of the ranges ``touched``
    (a DataFrame with the column ``range``), whose rows so far give way."""

    rows: DataFrame
    kind: str = "replace"
    touched: DataFrame | None = None


class Store:
    def __init__(self, spark: SparkSession, folder: str, layouts: dict[str, Layout] | None = None):
        self.spark, self.folder, self.layouts = spark, folder.rstrip("/"), layouts or {}

    # versions

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def versions(self) -> list[int]:
        fs, at = self._fs(f"{self.folder}/versions")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def head(self) -> int:
        """The newest version, 0 where nothing is published yet."""
        return max(self.versions(), default=0)

    def describe(self, version: int) -> dict:
        """What a version says of its tables and writers."""
        if not version:
            return {"tables": {}, "sequences": {}}
        fs, at = self._fs(f"{self.folder}/versions/{version:012d}.json")
        stream = fs.open(at)
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _publish(self, version: int, said: dict) -> None:
        fs, at = self._fs(f"{self.folder}/versions/{version:012d}.json")
        _, staged = self._fs(f"{self.folder}/versions/_{uuid.uuid4().hex}")
        out = fs.create(staged, False)
        out.write(json.dumps(said, sort_keys=True).encode())
        out.close()
        jvm = self.spark._jvm
        rename = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:  # fails where the target is there
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self.spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(staged), fs.makeQualified(at), rename)
        except Exception as e:
            fs.delete(staged, False)
            if fs.exists(at):
                raise Conflict(f"version {version} has been published by another writer") from e
            raise

    # reading

    def tables(self, version: int | None = None) -> list[str]:
        return sorted(self.describe(self.head() if version is None else version)["tables"])

    def files(self, table: str, version: int | None = None) -> DataFrame:
        """``(range, path, n)`` of a table's data files, none where the version has no such table."""
        entry = self.describe(self.head() if version is None else version)["tables"].get(table)
        return self.spark.read.schema(FILES).parquet(f"{self.folder}/{entry['files']}") if entry else self.spark.createDataFrame([], FILES)

    def read(self, table: str, version: int | None = None, ranges: DataFrame | None = None) -> DataFrame:
        """The rows of a table, or only the files of ``ranges``. The driver holds the files' names, as Spark's own listing does."""
        version = self.head() if version is None else version
        schema = T.StructType.fromJson(self.describe(version)["tables"][table]["schema"])
        files = self.files(table, version)
        wanted = files if ranges is None else files.join(ranges.select("range").distinct(), "range", "left_semi")
        paths = [f"{self.folder}/{r.path}" for r in wanted.select("path").toLocalIterator()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # writing

    def staged(self, rows: DataFrame, held: list[str]) -> DataFrame:
        """``rows`` written once beside the tables, for changes that several of them are made from; the folder joins
        ``held``, for ``unstage`` to let go."""
        held.append(f"{self.folder}/staged/{uuid.uuid4().hex}")
        rows.write.parquet(held[-1])
        return self.spark.read.schema(rows.schema).parquet(held[-1])

    def unstage(self, held: list[str]) -> None:
        for at in held:
            fs, path = self._fs(at)
            fs.delete(path, True)

    def _stage(self, table: str, change: Change, base: dict) -> dict:
        """Write a change's rows and the new list of files; nothing points to them yet."""
        layout, at = self.layouts.get(table), uuid.uuid4().hex
        rows = change.rows.withColumn("_range", layout.range_of() if layout else F.lit("all"))
        data = f"data/{table}/{at}"
        rows.hint("rebalance", "_range").write.partitionBy("_range").parquet(f"{self.folder}/{data}")
        stored = T.StructType([*change.rows.schema.fields])
        written = self.spark.read.schema(T.StructType([*stored.fields, T.StructField("_range", T.StringType())])).parquet(f"{self.folder}/{data}")
        name = F.concat(F.lit(f"{data}/_range="), F.col("_range"), F.lit("/"), F.col("_metadata.file_name"))
        new = written.groupBy(F.col("_range").alias("range"), name.alias("path")).agg(F.count(F.lit(1)).alias("n"))
        entry = base["tables"].get(table)
        if entry and change.kind != "replace":
            old = self.spark.read.schema(FILES).parquet(f"{self.folder}/{entry['files']}")
            if change.kind == "ranges":
                old = old.join(change.touched.select("range").distinct(), "range", "left_anti")
            new = old.unionByName(new)
        listing = f"files/{table}/{at}"
        new.write.parquet(f"{self.folder}/{listing}")
        return {"files": listing, "schema": json.loads(stored.json())}

    def commit(self, changes: dict[str, Change], base: int | None = None, writer: str | None = None, sequence: int | None = None) -> int:
        """Publish all changes as one version after ``base`` (the newest if not given) and return its number.

        With a ``writer`` a change counts once: a ``sequence`` that the writer has published, or one before it, does
        nothing and returns the newest version; one that leaves a gap is an error. The changes' rows must come from
        ``base``; if another version has been published since, ``Conflict`` is raised and nothing has changed.
        """
        base = self.head() if base is None else base
        said = self.describe(base)
        if writer is not None:
            done = said["sequences"].get(writer, -1)
            if sequence <= done:
                return base
            if sequence != done + 1:
                raise ValueError(f"{writer} is at {done}, {sequence} does not follow")
        tables = dict(said["tables"])
        for table, change in changes.items():
            tables[table] = self._stage(table, change, said)
        sequences = said["sequences"] | ({writer: sequence} if writer is not None else {})
        if self.head() != base:
            raise Conflict(f"version {base} is not the newest any more")
        self._publish(base + 1, {"tables": tables, "sequences": sequences, "parent": base})
        return base + 1

    def expire(self, keep: int = 10) -> int:
        """Delete all but the newest ``keep`` versions and the data files that only they name; how many files went."""
        found = self.versions()
        old, kept = found[:-keep], found[-keep:]
        listings = lambda which: {(t, e["files"]) for v in which for t, e in self.describe(v)["tables"].items()}
        gone, held = listings(old), listings(kept)
        many = 0
        for table in sorted({t for t, _ in gone - held}):
            read = lambda which, t=table: self.spark.read.schema(FILES).parquet(*[f"{self.folder}/{f}" for x, f in sorted(which) if x == t])
            unused = read(gone - held)
            if any(x == table for x, _ in held):
                unused = unused.join(read(held), "path", "left_anti")
            for row in unused.select("path").distinct().toLocalIterator():
                fs, at = self._fs(f"{self.folder}/{row.path}")
                many += bool(fs.delete(at, False))
        for v in old:
            fs, at = self._fs(f"{self.folder}/versions/{v:012d}.json")
            fs.delete(at, False)
        for _, listing in gone - held:
            fs, at = self._fs(f"{self.folder}/{listing}")
            fs.delete(at, True)
        return many
