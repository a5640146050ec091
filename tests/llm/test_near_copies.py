"""Edited copies against brute force, in small buckets and in one large group; the pipeline's stage."""

import random
from itertools import combinations

import pyarrow as pa

from sievespark.llm import near_copies


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, min(len(words), 1)))}


def alike(a, b):
    return a == b or (bool(a & b) and len(a & b) * 5 >= len(a | b) * 4)


def texts():
    r = random.Random(5)
    word = lambda: "".join(r.choice("aeioulnrstdm") for _ in range(6))
    out = []
    for _ in range(40):
        base = [word() for _ in range(r.randint(60, 300))]
        out.append(" ".join(base))
        for edits in (1, 2, len(base) // 60, len(base) // 15):
            copy = list(base)
            for at in r.sample(range(len(copy)), edits):
                copy[at] = word()
            out.append(" ".join(copy).title())
    return out + [None, "", " ", "a b", "A  b", "a b c"]


def brute(rows):
    sets = [(i, grams(t)) for i, t in rows]
    root = {i: i for i, _ in rows}
    find = lambda i: i if root[i] == i else find(root[i])
    for (i, a), (j, b) in combinations(sets, 2):
        if alike(a, b):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return {i: find(i) for i in root}


def test_classes_are_those_of_brute_force(spark):
    rows = list(enumerate(texts()))
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {x.id: x.component for x in near_copies.near_copies(table).collect()} == brute(rows)


def test_a_large_group_stays_one_class(spark):
    r = random.Random(6)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(w if j != at else f"x{i}" for j, w in enumerate(base))) for i in range(300) for at in [r.randrange(200)]]
    rows.append((1000, "something else that is no copy of anything here at all"))
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert [x.doc_id for x in near_copies.representatives(table).orderBy("doc_id").collect()] == [0, 1000]


def test_the_stage_drops_edited_copies(spark, sf_dir):
    import corpus_pipeline

    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts())]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    want = {i for i, c in brute([r[:2] for r in rows]).items() if i == c}
    assert {x.doc_id for x in corpus_pipeline.drop_near_duplicates(spark, table, sf_dir).collect()} == want


def force_one_bucket(monkeypatch):
    prints = near_copies._prints

    def one_bucket(sets):
        return [*prints(sets)[:2], pa.array([[7] if len(h) else [] for h in sets], pa.list_(pa.int64()))]

    monkeypatch.setattr(near_copies, "BUCKET", 3)
    monkeypatch.setattr(near_copies, "LEADERS", 1)
    monkeypatch.setattr(near_copies, "_prints", one_bucket)


def test_groups_cost_rows_in_proportion(spark, monkeypatch):
    """Three groups in one bucket, two of them with a long passage in common: twice the texts, twice the joined rows."""
    force_one_bucket(monkeypatch)
    joined, met = [], near_copies._met

    def counted(x, y, on):
        out = met(x, y, on)
        joined.append(out.count())
        return out

    monkeypatch.setattr(near_copies, "_met", counted)
    totals = []
    for size in (150, 300):
        r, rows = random.Random(3), []
        base = [[f"g{g}w{i}" for i in range(100)] for g in range(3)]
        base[1] += [f"shared{i}" for i in range(60)]
        base[2] += [f"shared{i}" for i in range(60)]
        for k in range(size):
            words = list(base[k % 3])
            words[r.randrange(100)] = f"own{k}"
            rows.append((k, " ".join(words)))
        joined.clear()
        table = spark.createDataFrame(rows, "doc_id bigint, text string")
        assert {x.id: x.component for x in near_copies.near_copies(table).collect()} == {k: k % 3 for k in range(size)}
        totals.append(sum(joined))
    assert totals[0] and totals[1] < 2.5 * totals[0], totals


def test_large_buckets_lose_no_link(spark, monkeypatch):
    """All texts in one bucket with one leader, which joins next to none: rare shingles must find the rest, chains too."""
    force_one_bucket(monkeypatch)
    r = random.Random(8)
    rows = texts()
    for chain in range(6):
        base = [f"c{chain}w{i}" for i in range(120)]
        for step in range(25):
            rows.append(" ".join(base))
            for at in r.sample(range(120), 2):
                base[at] = f"c{chain}s{step}x{at}"
    rows = list(enumerate(rows))
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {x.id: x.component for x in near_copies.near_copies(table).collect()} == brute(rows)
    monkeypatch.setattr(near_copies, "unsettled", lambda live, roots: roots.limit(0))
    assert {x.id: x.component for x in near_copies.near_copies(table).collect()} != brute(rows)


def test_what_unlike_texts_lack_keeps_no_rows(spark, monkeypatch):
    """Texts of one bucket that share a passage and no more: each lacks what the central one has, which makes no pair."""
    force_one_bucket(monkeypatch)
    kept, whole = [], near_copies._open_lists

    def counted(rows):
        out = whole(rows)
        kept.append((rows.count(), out.count()))
        return out

    monkeypatch.setattr(near_copies, "_open_lists", counted)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(k, passage + " " + " ".join(f"t{k}w{i}" for i in range(60))) for k in range(60)]
    rows += [(100 + k, rows[k][1] + f" more{k}") for k in range(0, 60, 7)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {x.id: x.component for x in near_copies.near_copies(table).collect()} == {i: i % 100 for i, _ in rows}
    assert kept and 4 * kept[0][1] < kept[0][0], kept  # with what they lack it is more than half


def test_buckets_of_a_group_have_one_ref(spark, monkeypatch):
    """A group in many bands and several classes: each text is held against a central one about once, and no link is lost."""
    monkeypatch.setattr(near_copies, "BUCKET", 3)
    monkeypatch.setattr(near_copies, "LEADERS", 1)
    held, whole = [], near_copies.differences

    def counted(rows, sets):
        out = whole(rows, sets)
        held.append(sum(len(r["diff"]) for r in out.select("diff").collect()))
        return out

    monkeypatch.setattr(near_copies, "differences", counted)
    totals = []
    for size in (80, 160):
        r, rows = random.Random(4), []
        for k in range(size):
            words = [f"b{i}" for i in range(150)]
            for at in r.sample(range(150), r.randint(2, 12)):
                words[at] = f"own{k}x{at}"
            rows.append((k, " ".join(words)))
        held.clear()
        table = spark.createDataFrame(rows, "doc_id bigint, text string")
        assert {x.id: x.component for x in near_copies.near_copies(table).collect()} == brute(rows)
        base = grams(" ".join(f"b{i}" for i in range(150)))
        totals.append((sum(held), sum(len(grams(t) ^ base) for _, t in rows)))
    assert all(0 < got < 2 * once for got, once in totals) and totals[1][0] < 2.5 * totals[0][0], totals
