"""The forest against all pairs: recall, order and scores, copies, ties, odd vectors, runs of several groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievespark.llm import hash_forest, queries
from sievespark.llm.hash_forest import Settings

SCHEMA = "vec_id bigint, embedding array<float>, key string, dim int, rank int"


def brute(rows, k=20):
    """query id -> [(score, id)], exact products in double precision."""
    ok = {i: np.array(v, np.float32).astype(np.float64) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for q, v in ok.items():
        if q % 20 == 0:
            out[q] = sorted(((-float(v @ w), i) for i, w in ok.items() if i != q and len(w) == len(v)))[:k]
    return out


def search(spark, rows, **options):
    table = spark.createDataFrame([(i, v, "clash", 0, 0) for i, v in rows], SCHEMA)
    return hash_forest.nearest(table, F.col("vec_id") % 20 == 0, **options)


def recall(found, want):
    got = {}
    for r in found:
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    for q, rows in got.items():
        assert sorted(rows) == list(range(1, len(rows) + 1)) == list(range(1, len(want[q]) + 1))
        ordered = [rows[i] for i in sorted(rows)]
        assert ordered == sorted(ordered, key=lambda x: (-x[1], x[0])) and q not in [i for i, _ in ordered] and len({i for i, _ in ordered}) == len(ordered)
    assert set(got) == {q for q in want if want[q]}
    hit = sum(len({i for i, _ in got[q].values()} & {i for _, i in want[q]}) for q in got)
    return hit / sum(map(len, want.values()))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_recall_on_the_tables(spark, sf):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
    found = queries.op13_hash_forest(spark, f"/root/testdata/{sf}")
    assert dict(found.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    found = found.collect()
    assert recall(found, brute(rows)) >= 0.9
    vec = {i: np.array(v, np.float64) for i, v in rows}
    assert all(abs(r.score - vec[r.query_id] @ vec[r.vec_id]) < 1e-12 for r in found)


def clusters(n=3000, seed=2, spread=0.1):
    r = np.random.default_rng(seed)
    middle = r.standard_normal((60, 24)) * r.uniform(0.5, 3, (60, 1))
    return [(i, [float(x) for x in middle[r.integers(60)] + spread * r.standard_normal(24)]) for i in range(n)]


def test_few_candidates_where_vectors_cluster(spark, monkeypatch):
    """Norms differ, so the largest product isn't the smallest angle; runs are met in several groups."""
    rows = clusters()
    seen = []
    enough = hash_forest.enough
    monkeypatch.setattr(hash_forest, "enough", lambda *a: seen.append(enough(*a)) or seen[0])
    assert recall(search(spark, rows, settings=Settings(rows=100, queries=10, stride=3)).collect(), brute(rows)) >= 0.9
    assert seen[0] < 16 * len(rows) / 3


def test_copies_ties_and_what_takes_no_part(spark):
    r = np.random.default_rng(7)
    one, other = [0.5] * 8, [float(x) for x in r.standard_normal(8)]
    rows = [(i, one) for i in range(0, 900)] + [(i, other) for i in range(900, 910)] + [(i, [float(x) for x in r.standard_normal(8)]) for i in range(1000, 1100)]
    rows += [(2000, None), (2020, []), (2040, [0.0] * 8), (2060, [float("nan")] + one[1:]), (2080, [float("inf")] + one[1:]), (2100, [None] + one[1:]), (None, one), (2120, [1.0, 2.0]), (2121, [3.0, 4.0]), (2140, [7.0])]
    found = search(spark, rows + [rows[0]], settings=Settings(recall=1.0)).collect()
    want = brute(rows)
    assert {q: [(i, round(-s, 9)) for s, i in v] for q, v in want.items() if v} == {q: [(x.vec_id, round(x.score, 9)) for x in sorted(found, key=lambda x: x.rank) if x.query_id == q] for q in {x.query_id for x in found}}
    copies = [x.vec_id for x in sorted(found, key=lambda x: x.rank) if x.query_id == 0 and x.vec_id < 900]
    assert copies and copies == list(range(1, 1 + len(copies)))
    assert [(x.vec_id, x.score) for x in found if x.query_id == 2120] == [(2121, 11.0)]


def test_many_equal_products(spark):
    rows = [(i, [1.0 if j == i % 40 else 0.0 for j in range(40)]) for i in range(400)]
    found = search(spark, rows, settings=Settings(recall=1.0)).collect()
    assert [x.vec_id for x in sorted(found, key=lambda x: x.rank) if x.query_id == 20] == [60, 100, 140, 180, 220, 260, 300, 340, 380] + list(range(11))


def test_hash_strings_and_prefixes():
    r = np.random.default_rng(1)
    v = r.standard_normal((2000, 5))
    h = hash_forest.hashes(v, 9.0, Settings())
    assert h.shape == (2000, 16) and (h >= 0).all() and (h < 1 << 62).all()
    assert (hash_forest.hashes(v[:3], 9.0, Settings()) == h[:3]).all()
    plain = lambda a, b: next((i for i, (x, y) in enumerate(zip(f"{a:062b}", f"{b:062b}")) if x != y), 62)
    assert [hash_forest.shared_prefix(h[i], h[j]).tolist() for i, j in ((0, 1), (2, 2), (3, 4))] == [[plain(x, y) for x, y in zip(h[i], h[j])] for i, j in ((0, 1), (2, 2), (3, 4))]


def test_empty_and_tiny_tables(spark):
    assert search(spark, []).count() == 0
    assert search(spark, [(20, [1.0])]).count() == 0
    assert search(spark, [(1, [1.0]), (2, [2.0])]).count() == 0
