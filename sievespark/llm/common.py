"""Shared helpers of the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words everywhere in this package: runs of anything but space, tab, LF, VT, FF, CR.
WORD_BREAK = r"[\x20\x09-\x0D]+"
#: Rows of a file of narrow rows, where their number is known.
ROWS_A_FILE = 250_000
#: Rows of an Arrow batch, where the session leaves Spark's default.
TEXT_ROWS = 1000
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); where unset a temporary one on a local
    master, as in tests, and an error on a cluster, whose machines would not find each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/sievespark-{uuid.uuid4().hex}/{name}"


def small_batches(spark: SparkSession) -> None:
    """Rows that hold texts go to Python by ``TEXT_ROWS``, unless the session has a setting of its own: a batch stands in
    memory several times, in the JVM and in Python, and Spark's default of 10,000 texts is no bound worth the name."""
    if spark.conf.get(_BATCH_ROWS) == "10000":
        spark.conf.set(_BATCH_ROWS, str(TEXT_ROWS))


def materialize_narrow(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``materialize`` for rows of a few numbers: in no more files than four tasks for each core of the cluster write, or
    one for every ``ROWS_A_FILE`` where the number of ``rows`` is known. A table of some thousand rows in a file for each
    shuffle partition costs more for its files than for its rows."""
    most = 4 * df.sparkSession.sparkContext.defaultParallelism if rows is None else rows // ROWS_A_FILE + 1
    return materialize(df.coalesce(most), name)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage (a lost executor never replays what lies before), gives the optimizer exact sizes,
    so that a join only broadcasts below Spark's own size threshold, and leaves no partitioning behind,
    so that adaptive execution may split a skewed side of the next join.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: str):
    """The UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def sized_broadcast(df: DataFrame, most_rows: int = 1_000_000) -> DataFrame:
    """``df``, written out and marked for broadcast if it has at most ``most_rows`` rows.

    Beyond that Spark chooses, which for large sides means a shuffled join whose skewed partitions are split.
    """
    df = materialize(df, "sized")
    return F.broadcast(df) if df.count() <= most_rows else df


_OWNER: list[tuple[str, Callable[[], object]]] = []


def own_caches(owner: str, release: Callable[[], object] = lambda: None) -> None:
    """Say in a task that this worker process now keeps what ``owner`` remembers between tasks, and how to let it go.

    Workers outlive stages. What the operator before has kept goes, so a process holds one operator's caches at most.
    """
    if _OWNER and _OWNER[0][0] != owner:
        _OWNER.pop()[1]()
        gc.collect()
    if not _OWNER:
        _OWNER.append((owner, release))
