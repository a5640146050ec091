"""Streams: units to findings to state, batch by batch; windows, late events, limits on rates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import detect, state
from ..plans.rules import RulePack
from ..sources.store import Change, Layout, Store


def keep(store: Store, payloads: DataFrame, empty: DataFrame, scan_id: str, at: Column, writer: str | None = None, sequence: int | None = None, threshold: float = 0.5) -> int:
    """Bring a batch of payloads into the store's ``findings``, with its ``events``, as one version; which one that is.

    Payloads are written first, so that nothing upstream runs twice, and so is their plan, which two tables are made from.
    Only the ranges that a payload's fingerprint or
    its previous one falls into are read, merged and written again; all other files are taken over. With a ``writer``
    a batch counts once, whatever Spark runs again. ``empty`` gives the columns of a table that is not there yet.
    """
    base = store.head()
    if writer is not None and store.describe(base)["sequences"].get(writer, -1) >= sequence:
        return base
    layout = store.layouts["findings"]
    held: list[str] = []
    try:
        batch = store.staged(payloads, held)
        ranges = lambda key: batch.where(F.col(key).isNotNull()).select(layout.range_of(key=F.col(key)).alias("range"))
        touched = store.staged(ranges("fingerprint").union(ranges("previous_fingerprint")).distinct(), held)
        before = store.read("findings", base, touched) if "findings" in store.tables(base) else empty.limit(0)
        plan = store.staged(state.plan_ingest(before, batch, threshold), held)
        events = state.ingest_events(plan, scan_id, at).withColumn("comment", F.lit(None).cast("string"))
        if "validation" in before.columns and "validation" in batch.columns:
            events = events.unionByName(state.validation_events(before, plan, scan_id, at))
        return store.commit({"findings": Change(state.upsert(before, plan, scan_id, at), "ranges", touched), "events": Change(events, "append")}, base, writer, sequence)
    finally:
        store.unstage(held)


def start(units: DataFrame, pack: RulePack, keys: detect.Keys, folder: str, empty: DataFrame, scan_id: str, source_id: str, clock: Callable[[int], Column], trigger: dict | None = None, kept: int = 10):
    """Start a query that detects in a stream of units and keeps the findings in the store at ``folder``/tables.

    Each batch is one version of the store, published by the writer ``stream`` under the batch's number, so one that
    Spark runs again after a failure does nothing: findings count once. ``clock`` gives a batch's time by its number, the
    same whenever it runs. Versions before the newest ``kept`` go.
    """
    spark = units.sparkSession
    store = Store(spark, f"{folder}/tables", {"findings": Layout()})

    def put(batch: DataFrame, number: int) -> None:
        found = detect.findings(batch, pack, keys)
        locator = F.create_map(F.lit("connector_type"), F.col("connector_type"), F.lit("resource_id"), F.col("resource_id"), F.lit("offset"), F.col("start").cast("string"))
        payload = found.select(
            F.lit(source_id).alias("source_id"), "fingerprint", F.lit(None).cast("string").alias("previous_fingerprint"), F.lit(None).cast("string").alias("previous_secret_hash"), "secret_hash",
            F.lit(None).cast("string").alias("correlation_id"), "rule_id", "rulepack_version", locator.alias("resource_locator"), F.col("snippet").alias("redacted_snippet"), "entropy", "confidence", "severity", F.col("start").alias("ord"),
        )
        keep(store, payload, empty, scan_id, clock(number), "stream", number)
        store.expire(kept)

    return units.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()


def rate_windows(events: DataFrame, key: str, at: str = "ts", seconds: int = 60, watermark: str | None = None) -> DataFrame:
    """Events per key and tumbling window; on a stream with a watermark, windows close behind it."""
    rows = events.withWatermark(at, watermark) if watermark else events
    w = F.window(at, f"{seconds} seconds")
    return rows.groupBy(key, w).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("window.start").alias("window_start"), "n")


def sliding_count(events: DataFrame, key: str, order: str, at: str = "ts", seconds: int = 60) -> DataFrame:
    """Each event with the number of its key's events in the last ``seconds``, itself included.

    Time is cut into stretches of that length; an event also stands in the next stretch, as what came before.
    So a window never looks beyond one key and stretch, and a key with most of the events is still spread.
    """
    micros, step = F.unix_micros(F.col(at).cast("timestamp")), seconds * 1_000_000
    stretch = F.floor(F.col("_us") / step)
    twice = F.explode(F.array(F.struct(stretch.alias("at"), F.lit(True).alias("own")), F.struct((stretch + 1).alias("at"), F.lit(False).alias("own"))))
    rows = events.select(key, order, at, micros.alias("_us")).select("*", twice.alias("_s"))
    w = Window.partitionBy(key, "_s.at").orderBy("_us").rangeBetween(-step + 1, 0)
    return rows.withColumn("n", F.count(F.lit(1)).over(w)).where("_s.own").select(key, order, at, "n")


def latest_by_time(events: DataFrame, key: str, value: str, at: str, arrived: str) -> DataFrame:
    """Per key the value of the newest event by its own time, however late it came, and the last arrival."""
    return events.groupBy(key).agg(F.max_by(value, F.struct(at, arrived)).alias(value), F.max(at).alias(at), F.max(arrived).alias(arrived))


def once(events: DataFrame, keys: list[str], at: str = "ts", watermark: str = "10 minutes") -> DataFrame:
    """Events of a stream without repeats of ``keys`` within the watermark; on a table without any repeat."""
    return events.withWatermark(at, watermark).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def timed_out(rows: DataFrame, beat: str, as_of, seconds: int) -> DataFrame:
    """Rows whose last sign of life is older than ``seconds``; those that never gave one are left alone."""
    return rows.where(F.unix_timestamp(as_of) - F.unix_timestamp(beat) > seconds)


def newest_on_stream(events: DataFrame, key: str, value: str, at: str) -> DataFrame:
    """A stream's newest value per key by the event's own time: rows ``key, value, at`` whenever one is renewed.

    A late event that is older than what is known changes nothing. The state is a value and a time per key.
    """
    kinds = {c: events.schema[c].dataType.simpleString() for c in (key, value)}

    def step(k: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        best = held.get if held.exists else None
        renewed = False
        for frame in frames:
            row = frame.sort_values(["_us", value]).iloc[-1]
            if best is None or row["_us"] > best[1]:
                best, renewed = (row[value], int(row["_us"])), True
        if renewed:
            held.update(best)
            yield pd.DataFrame({key: [k[0]], value: [best[0]], "_us": [best[1]]})

    slim = events.select(key, value, F.unix_micros(F.col(at).cast("timestamp")).alias("_us"))
    found = slim.groupBy(key).applyInPandasWithState(step, f"`{key}` {kinds[key]}, `{value}` {kinds[value]}, _us bigint", f"`{value}` {kinds[value]}, _us bigint", "update", GroupStateTimeout.NoTimeout)
    return found.select(key, value, F.timestamp_micros("_us").alias(at))
