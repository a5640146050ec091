"""Archives: round trip, revisits, coalesced reads, odd inputs."""

import hashlib

from sievespark.llm import warc

PAGES = "page_id bigint, url string, html string, digest string, file string"


def pages():
    big, odd = "<p>same</p>" * 200, "é\r\n\r\nWARC/1.1\r\n" * 100
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (9, "http://b/9", big), (3, "http://a/3", "small"), (4, "http://a/4", "small"), (5, None, odd), (6, "http://x/\n6", None), (7, "http://x/7", ""), (None, "http://n/", big), (9, "http://b/9", big)]
    return [(*r, "clash", "clash") for r in rows]


def test_round_trip(spark):
    found = warc.round_trip(spark.createDataFrame(pages(), PAGES)).collect()
    want = []
    for page_id, url, text, *_ in pages():
        raw = (text or "").encode()
        revisit = page_id in (1, 2)
        want.append((page_id or 0, (url or "").replace("\n", "%0A"), "revisit" if revisit else "response", 9 if revisit else 0, len(raw), hashlib.sha1(raw).hexdigest()))
    assert sorted((r.page_id or 0, r.url, r.record_type, r.refers_to or 0, r.payload_bytes, r.payload_digest) for r in found) == sorted(want)


def test_selected_records_with_payloads(spark, tmp_path):
    folder = f"file://{tmp_path}/warc"
    index = warc.write_archives(spark.createDataFrame(pages(), PAGES), folder)
    some = warc.select(index, urls=spark.createDataFrame([("http://a/3",), ("http://b/9",), ("http://b/9",), ("http://none",)], "url string"))
    got = sorted((r.page_id, r.payload.decode()) for r in warc.read_records(some, folder).collect())
    assert got == [(3, "small"), (9, "<p>same</p>" * 200), (9, "<p>same</p>" * 200)]
    digest = hashlib.sha1(b"small").hexdigest()
    assert warc.select(index, digests=spark.createDataFrame([(digest,)], "digest string")).count() == 2


def test_reading_tasks_follow_the_bytes(spark, tmp_path):
    folder = f"file://{tmp_path}/many"
    rows = [(i, f"http://a/{i}", hashlib.sha256(str(i).encode()).hexdigest() * 40, "", "") for i in range(400)] + [(1000, "http://long/", "é long text " * 300_000, "", "")]
    index = warc.write_archives(spark.createDataFrame(rows, PAGES), folder)
    total = sum(r["length"] for r in index.collect())
    assert warc.read_tasks(index) == spark.sparkContext.defaultParallelism
    assert warc.read_tasks(index, 4000) == -(-total // 4000)
    assert warc.read_tasks(index.limit(2), 10) == 2 and warc.read_tasks(index.limit(0)) == 1
    back = warc.read_records(index, folder, task_bytes=4000)
    assert back.rdd.getNumPartitions() == -(-total // 4000)
    assert sorted((r.page_id, len(r.payload)) for r in back.collect()) == sorted((i, len(t.encode())) for i, _, t, *_ in rows)


def test_reads_are_coalesced():
    ranges = [("a", 0, 10), ("a", 10, 10), ("a", 25, 5), ("a", 1000, 5), ("b", 0, 5), ("b", 0, 5)]
    assert list(warc.coalesced(iter(ranges), gap=8, most=100)) == [("a", 0, 30, [(0, 10), (10, 10), (25, 5)]), ("a", 1000, 1005, [(1000, 5)]), ("b", 0, 5, [(0, 5), (0, 5)])]
    assert len(list(warc.coalesced(iter([("a", i * 10, 10) for i in range(10)]), gap=0, most=20))) == 5
    assert list(warc.coalesced(iter([]))) == []


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0
