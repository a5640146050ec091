"""Markup, files, globs, sources and sinks."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from sievespark.functions import documents, extract, globs, identity, markup
from sievespark.sources import conformance, fake, files, sinks, units


def test_storage_text():
    page = '<p>password</p><ac:structured-macro ac:name="code"><ac:parameter ac:name="language">sh</ac:parameter><ac:plain-text-body><![CDATA[token=<AB&amp;C>]]></ac:plain-text-body></ac:structured-macro><table><tr><td>user</td><td>pw &amp; x</td></tr></table><ri:page ri:title="t"/>'
    assert markup.storage_text(page) == "password\ntoken=<AB&amp;C>\nuser pw & x"
    assert markup.storage_text("") == "" and markup.storage_text("a\x00b<br/>c") == "ab\nc"


def test_wiki_text():
    text = "h1. Title\n* item {{mono}} [label|http://u/?k=1]\n{code:java}\nx | {y}\n{code}\n{color:red}warm{color} || head |"
    assert markup.wiki_text(text) == "Title\nitem mono label http://u/?k=1\nx | {y}\nwarm head"
    assert markup.wiki_text("{code}never closed") == "never closed"


def test_document_text(spark):
    para = lambda *c: {"type": "paragraph", "content": list(c)}
    text = lambda t, **k: {"type": "text", "text": t, **k}
    cell = lambda t: {"type": "tableCell", "content": [para(text(t))]}
    doc = {"type": "doc", "content": [para(text("see "), text("here", marks=[{"type": "link", "attrs": {"href": "http://x"}}])), {"type": "table", "content": [{"type": "tableRow", "content": [cell("password"), cell("hunter2")]}]}, para({"type": "mention", "attrs": {"text": "@me"}})]}
    nested = lambda levels, inner: inner if not levels else {"type": "panel", "content": [nested(levels - 1, inner)]}
    whole = lambda *c: {"type": "doc", "content": list(c)}
    cases = [
        (doc, "see here http://x\npassword hunter2\n@me"),
        (whole(nested(98, para(text("deep enough")))), "deep enough"), (whole(nested(99, para(text("too deep")))), None),
        (whole(para(*[text("x")] * 3000)), "x" * 3000), (whole(para(*[{}] * 200_010)), None),
        ({"type": "doc"}, ""), (whole(), ""), ({"type": "doc", "content": "no"}, ""), (whole(None, 7, "text", [text("in a list")]), ""), (whole({"type": "paragraph", "content": None}), ""),
        (whole(para(text("a", marks=[{"type": "strong"}]), text(5), text(" b"), {"type": "inlineCard", "attrs": {"url": "u"}}, {"type": "text", "text": "c", "attrs": {"url": ""}, "marks": ["x", {"type": "link", "attrs": {"href": ""}}, {"type": "link", "attrs": {"href": "v"}}]})), "a b uc v"),
        (whole({"type": ["paragraph"], "content": [text("one")]}, para(text("  two  \u2028 three\t\t"))), "one two\nthree"),
        (None, ""), ("h1. wiki", "wiki"), (5, None), ([], None), ({"type": "other"}, None),
    ]
    rows = [(i, json.dumps({"f": v})) for i, (v, _) in enumerate(cases)] + [(100, "{}"), (101, "no"), (102, None), (103, "[]"), (104, '{"f": "a", "f": "b"}')]
    found = spark.createDataFrame(rows, "i int, j string").select("i", documents.issue_field_text(F.col("j"), "f").alias("t"))
    assert {r.i: r.t for r in found.collect()} == dict(enumerate(w for _, w in cases)) | dict.fromkeys(range(100, 105))
    bodies = [{"body": {"view": {"value": "<p>v</p>"}}}, {"body": {"storage": {"value": ""}, "view": {"value": "x"}}}, {"body": {"storage": {"value": 5}, "view": {"value": "w"}}}, {}, {"body": "x"}, []]
    found = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)], "i int, j string").select("i", documents.supported_body_text(F.col("j")).alias("t"))
    assert [r.t for r in found.orderBy("i").collect()] == ["v", "", "w", None, None, None]


def test_trees_need_no_python(spark):
    df = spark.createDataFrame([("{}",)], "j string").select(documents.document_text(F.try_parse_json("j")).alias("t"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString() and df.first().t == ""


def test_office_text_comes_in_chunks():
    spoken = extract._Spoken()
    raw = "<a b='1'>é x</a>y<unclosed".encode()
    assert "".join(spoken.feed(raw[i : i + 1]) for i in range(len(raw))) == " é x y "



def test_globs(spark):
    import fnmatch

    names = ["team1/doc.txt", "team2/a/b.log", "a[b", "x.y", "", "TEAM1/doc.txt", "a]b", "new\nline", "a^b", "a-b"]
    patterns = ["team*/doc.txt", "*", "?.y", "a[[]b", "[!x].y", "team[12]/*", "a[b", "*.log", "new*", "a[]]b", "a[^]b", "a[!]b]b", "a[+--]b"]
    table = spark.createDataFrame([(n,) for n in names], "n string")
    for p in patterns:
        got = {r.n for r in table.where(F.col("n").rlike(globs.to_regex(p))).collect()}
        assert got == {n for n in names if fnmatch.fnmatchcase(n, p)}, p
    chosen = table.where(globs.selected(F.col("n"), ["team*"], ["*.log"])).collect()
    assert [r.n for r in chosen] == ["team1/doc.txt"]


def office(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts:
            z.writestr(name, text)
    return out.getvalue()


def test_files_of_a_share(spark, tmp_path):
    root = tmp_path / "share"
    (root / "sub dir").mkdir(parents=True)
    (root / "a.txt").write_text("plain é")
    (root / "sub dir" / "b.docx").write_bytes(office([("word/document.xml", "<w>office</w> text"), ("x.bin", "no")]))
    (root / "win.txt").write_bytes("wide".encode("utf-16"))
    (root / "bin.txt").write_bytes(b"a\0b")
    (root / "empty.md").write_text(" \n")
    (root / "pic.png").write_bytes(b"x")
    (root / "bad.docx").write_bytes(b"not a zip")
    (root / "bomb.docx").write_bytes(office([("w.xml", "0" * 3_000_000)]))
    (root / "big.txt").write_text("x" * 2000)
    (root / "skip.log").write_text("x")
    (root / ".env").write_text("K=1")
    found = files.listed(spark, f"file://{root}", exclude=["*.log"])
    text, gaps = files.file_units(found, extract.Limits(input_bytes=1900_000, output_chars=1000))
    assert {r.resource_id: r.text for r in text.collect() if r.resource_id != "big.txt"} == {"a.txt": "plain é", "sub dir/b.docx": " office  text", "win.txt": "wide", ".env": "K=1"}
    got = {r.id: (r.disposition, r.reason) for r in gaps.collect()}
    assert got == {"bin.txt": ("skipped", "binary_content"), "empty.md": ("skipped", "empty_content"), "pic.png": ("skipped", "unsupported_type"), "bad.docx": ("failed", "parse_error"), "bomb.docx": ("failed", "output_limit"), "big.txt": ("failed", "output_limit")}
    small = files.file_units(found.where("relative = 'big.txt'"), extract.Limits(input_bytes=100))[1].collect()
    assert [(r.id, r.reason) for r in small] == [("big.txt", "size_limit")]


def test_fake_source_batch_and_stream(spark, tmp_path):
    fake.register(spark)
    with pytest.raises(KeyError):
        fake.register(spark, "none")
    spaces = json.dumps({"a": [{"id": 1, "text": "one", "revision": 3}, {"id": 2, "text": "two", "revision": 9}, {"id": 3, "skip": True}], "b": [{"id": 4, "unreadable": True}]})
    read = spark.read.format("sieve_fake").option("spaces", spaces)
    assert sorted((r.resource_id, r.outcome) for r in read.load().collect()) == [("1", "scanned"), ("2", "scanned"), ("3", "skipped"), ("4", "failed")]
    assert sorted(r.resource_id for r in read.option("since", "3").load().collect()) == ["2", "3", "4"]
    stream = spark.readStream.format("sieve_fake").option("spaces", spaces).load()
    q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.resource_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["1", "2"]


def test_wiki_units(spark):
    body = lambda t: json.dumps({"body": {"storage": {"value": t}}})
    pages = spark.createDataFrame([(1, "ENG", "t1", 5, body("<p>x</p>")), (2, "ENG", "t2", None, "{}"), (3, "~me", "t3", 1, body(""))], "page_id int, space_key string, title string, revision int, resource string")
    notes = spark.createDataFrame([(10, 1, body("note")), (11, 2, "{}"), (12, 3, body("late"))], "comment_id int, page_id int, resource string")
    read, unread, position = units.wiki_units(pages, notes, since=1)
    assert sorted((r.resource_id, r.sub_resource, r.text) for r in read.select("resource_id", F.coalesce("sub_resource", F.lit("")).alias("sub_resource"), "text").collect()) == [("1", "", "x"), ("1", "comment:10", "note")]
    assert sorted((r.kind, r.id) for r in unread.collect()) == [("comment", "11"), ("page", "2")]
    assert [(r.space_key, r.position) for r in position.collect()] == [("ENG", 5)]
    assert [r.space_key for r in units.wiki_spaces(pages)[0].collect()] == ["ENG"]
    found, missing = units.wiki_spaces(pages, ["eng", "~ME", "gone"])
    assert sorted(r.space_key for r in found.collect()) == ["ENG", "~me"] and [r.wanted for r in missing.collect()] == ["gone"]


def test_replies_and_issues(spark):
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 1), (5, 6), (6, 5)], "comment_id int, parent_id int")
    assert sorted((r.comment_id, r.depth) for r in units.replies(tree).collect()) == [(1, 0), (2, 1), (3, 2), (4, 1)]
    issues = spark.createDataFrame([(1, "P", json.dumps({"summary": "s", "description": None, "environment": "e"})), (2, "P", json.dumps({"summary": "s"}))], "issue_id int, project string, fields string")
    read, unread = units.issue_units(issues)
    assert [r.text for r in read.collect()] == ["s\ne"] and [r.id for r in unread.collect()] == ["2"]
    changes = spark.createDataFrame([(1, i, "f", f"from{i}", f"to{i}") for i in range(4)], "issue_id int, entry int, field string, from_text string, to_text string")
    assert sorted(r.text for r in units.field_history(changes, most=2).collect()) == ["from0", "to0", "to1"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b"), (1, None)], "n int, s string")
    assert sinks.export(rows, f"{tmp_path}/x", ["n"], 5) == 2
    assert [r.value for r in spark.read.text(f"{tmp_path}/x").collect()] == ['{"n":1,"s":null}', '{"n":2,"s":"b"}']
    with pytest.raises(ValueError):
        sinks.export(rows, f"{tmp_path}/y", ["n"], 1)
    key = b"k" * 20
    calls = spark.createDataFrame([("body", 100, sinks.signature(b"body", 100, key), 150), ("body", 100, sinks.signature(b"other", 100, key), 150), ("body", 100, sinks.signature(b"body", 100, key), 900)], "b string, at bigint, s string, got bigint")
    assert [r.ok for r in calls.select(sinks.signed(F.col("b"), F.col("at"), F.col("s"), F.col("got"), key).alias("ok")).collect()] == [True, False, False]
    seen, obs = sinks.observed(rows, "n", F.count_if(F.col("s").isNull()).alias("nulls"))
    seen.collect()
    assert obs.get == {"rows": 2, "nulls": 1}


def test_locator_and_gap(spark):
    row = spark.createDataFrame([({"title": "t", "resource_id": "wrong"}, "7")], "d map<string,string>, r string")
    out = row.select(identity.locator(F.col("d"), F.lit("wiki"), F.col("r"), F.lit(None).cast("string"), F.lit(5)).alias("l"), identity.gap_reference(F.lit("page"), F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1")), b"p" * 16).alias("g"), identity.gap_reference(F.lit("page"), F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), b"p" * 16).alias("h")).first()
    assert out.l == {"title": "t", "connector_type": "wiki", "resource_id": "7", "offset": "5"} and out.g == out.h


def test_conformance(spark):
    fake.register(spark)
    spaces = json.dumps({"a": [{"id": 1, "text": "one", "revision": 3}, {"id": 2, "text": "two", "revision": 9}], "b": [{"id": 4, "text": "x"}]})
    read = lambda **o: spark.read.format("sieve_fake").option("spaces", spaces).options(**o).load()
    whole, part = read(), read(since=3)
    assert conformance.undetermined(read).isEmpty() and conformance.beyond(part, whole).isEmpty() and conformance.repeated(whole).isEmpty()
    assert conformance.beyond(whole, part).count() == 1
    assert conformance.lost(whole.where("resource_id = '1'"), part, whole).isEmpty() and conformance.lost(part, part, whole).count() == 1
    assert conformance.repeated(whole.union(whole)).count() == 3
    assert conformance.leaking(whole, ["resource_id", "space"], "two").isEmpty() and conformance.leaking(whole, ["text"], "two").count() == 1


def test_marks_of_the_wiki_format():
    text = markup.wiki_text("h2. Title\n* item {{mono}} [label|http://a/b?c=1]\n{noformat}\n* kept [x|y]\n{noformat}\n||name||value||\n|İ user|p@ss|\n{color:red}bq. red{color}\n- one\n1. two\nh1.x {unclosed [a\nb] {{c")
    assert text == "Title\nitem mono label http://a/b?c=1\n* kept [x|y]\nname value\nİ user p@ss\nred\none\ntwo\nx {unclosed [a\nb] {{c"
    assert markup.wiki_text("{code}never closed\n* x") == "never closed\nx"


def test_odd_storage():
    assert markup.storage_text("İ<P>a &lt;c&gt;<ri:user ri:x='1'/>d<AC:parameter>gone</ac:PARAMETER><![CDATA[<i>&amp; never closed") == "İ\na <c> d <i>&amp; never closed"
    for hostile in ("<" * 100_000, "<ac:parameter>" * 10_000, "<![CDATA[" * 20_000):
        markup.storage_text(hostile)
    for hostile in ("{{" * 50_000, "[" * 100_000, "{code}" * 20_001, "{a" * 50_000, "* " * 50_000):
        markup.wiki_text(hostile)


def test_a_share_is_walked_by_tasks(spark, tmp_path):
    """Folders, rings of links, ways to one folder, links that lead out."""
    import os

    root = tmp_path / "s"
    for i in range(40):
        (root / f"d{i % 8}" / f"e{i}").mkdir(parents=True)
        for k in range(5):
            (root / f"d{i % 8}" / f"e{i}" / f".f{k}").write_text("x" * k)
    (tmp_path / "outside").mkdir()
    (tmp_path / "outside" / "no.txt").write_text("no")
    os.symlink(tmp_path / "outside", root / "out")
    os.symlink(root, root / "d0" / "ring")
    os.symlink(root / "d1", root / "a1")
    os.symlink(root / "d0" / "e0" / ".f1", root / "same.txt")
    (root / "shut").mkdir()
    found = files.walk(spark, f"file://{root}")
    got = {r.relative: r.length for r in found.where("kind = 'file'").collect()}
    want = {f"{'a1' if i % 8 == 1 else f'd{i % 8}'}/e{i}/.f{k}": k for i in range(40) for k in range(5)} | {"same.txt": 1}
    assert got == want
    assert files.walk(spark, f"file://{root}/none").collect()[0].kind == "missing_resource"
    for bound, text in (({"depth": 1}, "deeper"), ({"files": 100}, "files")):
        with pytest.raises(ValueError, match=text):
            files.walk(spark, f"file://{root}", **bound)
    with pytest.raises(Exception, match="more than 3 entries"):
        files.walk(spark, f"file://{root}", entries=3)
    with pytest.raises(ValueError):
        files.walk(spark, "/tmp")
    whole = files.listed(spark, f"file://{root}", include=["*/.f3"])
    assert {r.content for r in whole.collect()} == {b"xxx"} and whole.count() == 40
