"""The audit against a plain walk of every order, odd inputs, and its SQL twin."""

import random
import re
from itertools import permutations

import duckdb

from sievespark.llm import filter_audit, queries

DOCS = "doc_id bigint, text string, lang string, part string, mask int"
LABELS = "doc_id bigint, quality int, toxic int"


def brute(docs, labels):
    good, toxic = ({d for d, *m in labels if m[k] == 1 and d is not None} for k in (0, 1))
    first = {}
    for i, t, *_ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    masks = []
    for i, t, lang, *_ in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > first[t]}
        masks.append((lang or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = {}
    for part in {m[0] for m in masks}:
        rows = [m for m in masks if m[0] == part]
        share = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                gone = set(order[: step - 1])
                here = [m for m in rows if f in m[1] and not m[1] & gone]
                share[f] += len(here)
                out[part, "".join(order), step] = [sum(not m[1] & (gone | {f}) for m in rows), len(here), sum(f in m[1] and bool(m[1] & gone) for m in rows), sum(m[1] == {f} for m in rows), sum(m[2] for m in here), sum(m[3] for m in here)]
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step].append(share[f])
    return out


def tables():
    r = random.Random(3)
    texts = ["", None, " \t\n", "A", "# x", "É\x0bÉ " * 120, "x\x85y " * 101, "W" * 70000 + " a", "😀 " * 130, " ".join(str(i) for i in range(100)), " ".join(str(i % 80) for i in range(100)), " ".join(str(i % 79) for i in range(100))]
    texts += [" ".join(r.choice(["a", "B", "c|", "D$", "e", "f", str(r.random())]) for _ in range(r.choice([5, 99, 100, 150]))) for _ in range(120)]
    texts += [r.choice(texts) for _ in range(150)]
    docs = [(i, t, r.choice(["en", "de", None, ""]), "clash", 9) for i, t in enumerate(texts)]
    r.shuffle(docs)
    docs += [docs[0], docs[3], (None, texts[20], "en", "", 0)]
    labels = [(r.randrange(300), r.choice([0, 1, None]), r.choice([0, 1, None])) for _ in range(250)] + [(None, 1, 1)]
    return docs, labels


def test_every_order_equals_brute_force(spark):
    docs, labels = tables()
    found = filter_audit.audit(filter_audit.document_masks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)))
    assert [t for _, t in found.dtypes] == ["string", "string", "int", *["bigint"] * 7]
    assert {tuple(r)[:3]: list(r)[3:] for r in found.collect()} == brute(docs, labels)


def test_an_empty_table_has_no_parts(spark):
    assert filter_audit.audit(filter_audit.document_masks(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS))).count() == 0


def test_other_filters(spark):
    masks = spark.createDataFrame([("p", m, True, False) for m in range(4)], "part string, mask int, good boolean, toxic boolean")
    found = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in filter_audit.audit(masks, "XY").collect()}
    assert found == {("XY", 1): (2, 2, 0, 1, 2, 0, 3), ("XY", 2): (1, 1, 1, 1, 1, 0, 3), ("YX", 1): (2, 2, 0, 1, 2, 0, 3), ("YX", 2): (1, 1, 1, 1, 1, 0, 3)}


def test_the_query_equals_its_twin(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    twin = con.execute(queries.oracle_sql()["op11_filter_audit"])
    names = [d[0] for d in twin.description]
    want = sorted(twin.fetchall())
    assert sorted(tuple(r) for r in queries.op11_filter_audit(spark, sf_dir).select(*names).collect()) == want and len(want) % 600 == 0 and want
