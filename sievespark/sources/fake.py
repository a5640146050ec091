"""A source of made-up pages as a Python data source, for tests of what reads any source.

``spark.read.format("sieve_fake")`` with the option ``spaces``, JSON of spaces to pages with ``id, text`` and
optionally ``revision, skip, unreadable``; ``since`` leaves out pages up to that revision. One partition a space.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "connector_type string, resource_id string, sub_resource string, origin string, text string, space string, revision bigint, outcome string"


class SpacePartition(InputPartition):
    def __init__(self, space: str, low: int | None = None, high: int | None = None):
        self.space, self.low, self.high = space, low, high


def _rows(pages: list[dict], space: str, low: int | None, high: int | None):
    for p in pages:
        revision = p.get("revision")
        if revision is not None and (low is not None and revision <= low or high is not None and revision > high):
            continue
        outcome = "skipped" if p.get("skip") else "failed" if p.get("unreadable") else "scanned"
        yield "fake", str(p["id"]), p.get("sub"), p.get("origin", "body"), p.get("text") if outcome == "scanned" else None, space, revision, outcome


class FakeReader(DataSourceReader):
    def __init__(self, spaces: dict, since: int | None):
        self.spaces, self.since = spaces, since

    def partitions(self):
        return [SpacePartition(s, self.since) for s in sorted(self.spaces)]

    def read(self, partition):
        yield from _rows(self.spaces[partition.space], partition.space, partition.low, partition.high)


class FakeStream(DataSourceStreamReader):
    """Pages by revision; an offset is the highest revision read, so a restart goes on after it."""

    def __init__(self, spaces: dict):
        self.spaces = spaces

    def initialOffset(self):
        return {"revision": 0}

    def latestOffset(self):
        return {"revision": max((p.get("revision") or 0 for pages in self.spaces.values() for p in pages), default=0)}

    def partitions(self, start, end):
        return [SpacePartition(s, start["revision"], end["revision"]) for s in sorted(self.spaces)]

    def read(self, partition):
        dated = [p for p in self.spaces[partition.space] if p.get("revision") is not None]
        yield from _rows(dated, partition.space, partition.low, partition.high)

    def commit(self, end):
        pass


class FakeSource(DataSource):
    @classmethod
    def name(cls):
        return "sieve_fake"

    def schema(self):
        return SCHEMA

    def _spaces(self) -> dict:
        found = json.loads(self.options.get("spaces", "{}"))
        if not isinstance(found, dict) or len({s.lower() for s in found}) < len(found):
            raise ValueError("spaces is an object whose names differ in any case")
        return found

    def reader(self, schema):
        since = self.options.get("since")
        return FakeReader(self._spaces(), int(since) if since is not None else None)

    def streamReader(self, schema):
        return FakeStream(self._spaces())


REGISTRY = {"fake": FakeSource}


def register(spark: SparkSession, kind: str = "fake") -> None:
    """Make a source usable by its name; an unknown kind is an error."""
    if kind not in REGISTRY:
        raise KeyError(f"no source of kind {kind!r}")
    spark.dataSource.register(REGISTRY[kind])
