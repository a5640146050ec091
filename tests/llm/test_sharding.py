"""Shards: the curve, the law of equal row counts, gapless slots, odd inputs."""

import itertools
import zlib

import numpy as np

from sievespark.llm import sharding

DOCS = "doc_id bigint, text string, lang string, source string, shard string, slot int"


def test_neighbours_on_the_curve_are_neighbours_in_space():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        at = sharding.hilbert_index(cells, bits)
        assert sorted(at) == list(range(len(cells)))
        assert np.abs(np.diff(cells[np.argsort(at)], axis=0)).sum(1).max() == 1


def check(rows, found, shards):
    assert sorted((r[0] or -1, len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows) == sorted((x["id"] if x["id"] is not None else -1, x["size"], x["text_crc32"]) for x in found)
    counts = [0] * shards
    for x in found:
        counts[x["shard"]] += 1
    assert max(counts) - min(counts) <= 1
    for s in range(shards):
        assert sorted(x["slot"] for x in found if x["shard"] == s) == list(range(counts[s]))


def test_rows_law(spark):
    for n in (0, 5, 16, 333):
        rows = [(i, "wörd " * (i % 37), ["en", "de", None][i % 3], "src0" if i % 3 else None, "s", 1) for i in range(1, n + 1)]
        rows += [(None, None, None, None, None, None), (7, "twin", "en", "a", "", 0), (7, "twin", "en", "a", "", 0)] if n > 100 else []
        table = spark.createDataFrame(rows, DOCS)
        check(rows, sharding.shard_rows(table).collect(), 16)


def test_files_hold_every_row_once(spark, tmp_path):
    rows = [(i, f"text {i}", "en", f"src{i % 4}", "s", 1) for i in range(200)]
    docs = spark.createDataFrame(rows, DOCS).drop("shard", "slot")
    sharding.write_shards(docs, f"file://{tmp_path}/shards", shards=4)
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert sorted(r.doc_id for r in back.collect()) == list(range(200))
    assert [r["count"] for r in back.groupBy("shard").count().collect()] == [50] * 4


def test_files_hold_null_and_repeated_ids_once(spark, tmp_path):
    rows = [(i if i % 5 else None, "same" if i % 2 else f"text {i}", "en", "a", "mine", i) for i in range(60)] + [(7, "twin", "en", "a", "mine", 0)] * 3 + [(None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    sharding.write_shards(docs, f"file://{tmp_path}/shards", shards=4)
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert sorted(map(repr, (tuple(r) for r in back.drop("curve_shard").collect()))) == sorted(map(repr, rows))
    assert [r["count"] for r in back.groupBy("curve_shard").count().collect()] == [16] * 4


def test_metadata_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(i, "x" * i, "en", "a") for i in range(20)], "doc_id bigint, text string, id string, size string")
    assert len({(x["shard"], x["slot"]) for x in sharding.shard_rows(docs, 4, strings=("id", "size")).collect()}) == 20
