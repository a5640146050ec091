"""The pipeline against its stages done plainly, and the registered names."""

import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
from sievespark.llm import decontaminate, toxicity


def test_names():
    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(bool(re.match(rf"op{n}_", x)) for x in names) == 1


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    import corpus_pipeline
    from sievespark.llm.common import materialize, read_table

    docs, out = read_table(spark, sf_dir, "documents"), []
    out.append(docs.collect())
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        out.append(docs.collect())
    return out


def test_stages_follow_from_one_another(spark, sf_dir, stages):
    docs, clean, single, uncontaminated, masked, encoded = stages
    ids = [[r.doc_id for r in s] for s in stages]
    verdict = toxicity.toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()
    assert sorted(ids[1]) == sorted(x.id for x in verdict if not x.predicted)
    assert set(ids[2]) <= set(ids[1]) and {r.text for r in single} == {r.text for r in clean if r.text in {x.text for x in single}}
    bench = [decontaminate.normalise(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    held = {r.doc_id for r in single if any(b in decontaminate.normalise(r.text) for b in bench)}
    assert held <= set(ids[2]) - set(ids[3])
    assert sorted(ids[3]) == sorted(ids[4]) == sorted(ids[5])
    before = {r.doc_id: r.text for r in uncontaminated}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    after = {r.doc_id: r for r in masked}
    for r in masked:
        assert r.n_chars == len(r.text)
        assert r.text == before[r.doc_id] or "[" in r.text
        assert not re.search(r'token = "[0-9a-f]{40}"', r.text)
    for r in encoded:
        assert r.ids == library.encode(after[r.doc_id].text, add_special_tokens=False).ids and r.n_tokens == len(r.ids)


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    got = sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in entry.queries()["pipeline"](spark, sf_dir).collect())
    assert got == sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in stages[-1])


def test_every_stage_takes_odd_rows(spark, sf_dir):
    import corpus_pipeline

    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, label int, fp string, _trusted int"
    rows = [(1, None, None, None, None, None, None, None, None), (2, "", "", "", 0, "", 0, "", 0), (None, "some text here", "en", "s", 14, "x", 1, "f", 1), (3, "w " * 60_000, "en", "s", 120_000, "x", 1, "f", 1)]
    rows += [(4, "the very same words", "en", "s", 19, "x", 1, "f", 1)] * 2
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            found = stage(spark, docs, sf_dir)
            if name == "bpe":
                assert found.count() == docs.count()
                continue
            assert found.columns == docs.columns, name
            docs = found
            assert docs.count() <= n
        if n:
            assert {r.doc_id for r in docs.collect()} == {1, None, 3, 4}


def test_a_worker_keeps_the_caches_of_one_operator():
    from sievespark.llm import common

    gone = []
    common._OWNER.clear()
    common.own_caches("a", lambda: gone.append("a"))
    common.own_caches("a", lambda: gone.append("a again"))
    common.own_caches("b", lambda: gone.append("b"))
    common.own_caches("c")
    common._OWNER.clear()
    assert gone == ["a", "b"]
