"""Toxicity: held-out accuracy, what is never an input, odd inputs."""

import random
import zlib

import pytest

from sievespark.llm import toxicity

DOCS = "doc_id bigint, text string, lang string, score string, label int"
BAD = ("vile", "rotten", "wretch")


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("aeinrst") for _ in range(r.randint(2, 4)))
    docs, labels = [], []
    for i in range(900):
        words = [word() for _ in range(r.randint(5, 60))]
        toxic = i % 6 == 0
        for _ in range(3 if toxic else 0):
            words.insert(r.randrange(len(words)), r.choice(BAD) + r.choice(["", ",", "."]))
        docs.append((i, " ".join(words).title() if i % 5 == 0 else " ".join(words), "en", "x", 1))
        labels.append((i, int(toxic)))
    docs += [(2000, None, None, None, None), (2001, "", "", "", 0), (None, "a vile rotten wretch", "en", "", 0), docs[0]]
    labels += [(None, 1), (1, None), (0, 0), (5000, 1)]
    return docs, spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id bigint, toxic int")


SMALL = toxicity.Settings(bits=16, l1=2.0, epochs=6)


def test_held_out_documents(tables):
    docs, table, labels = tables
    found = toxicity.toxicity(table, labels, settings=SMALL).collect()
    assert len(found) == len(docs)
    by = {x.id: x for x in found}
    for i, x in by.items():
        assert 0 <= x.score <= 1 and x.predicted == (x.score >= 0.5)
        assert x.held_out == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0)
    unseen = [x for x in found if x.held_out and x.id < 900]
    assert len(unseen) > 100
    assert sum(x.predicted == (x.id % 6 == 0) for x in unseen) / len(unseen) > 0.97
    assert by[None].predicted == 1 and by[2000].score == by[2001].score


def test_clean_rows_are_those_not_predicted(tables):
    docs, table, labels = tables
    bad = {x.id for x in toxicity.toxicity(table, labels, settings=SMALL).collect() if x.predicted}
    kept = toxicity.clean_rows(table, labels, settings=SMALL)
    assert kept.columns == table.columns
    assert sorted(str(x.doc_id) for x in kept.collect()) == sorted(str(i) for i, *_ in docs if i not in bad)


def test_sample_is_bounded_and_never_held_out(tables):
    _, table, labels = tables
    few = toxicity.labelled_sample(table, labels, max_labelled=50).collect()
    assert len(few) == len({x.doc_id for x in few}) == 50
    assert all(zlib.crc32(str(x.doc_id).encode()) % 5 for x in few)


def test_settings_are_chosen_inside_the_training_part(tables):
    _, table, labels = tables
    sample = toxicity.labelled_sample(table, labels)
    assert sample.where(toxicity.held_out()).count() == 0
    blind = toxicity.Settings(bits=16, l1=1e6)
    found = toxicity.choose(sample, [blind, SMALL])
    assert found[0][0] == SMALL and found[0][1] > 0.9 and found[1] == (blind, 0.0)
    with pytest.raises(ValueError):
        toxicity.choose(sample, [SMALL, toxicity.Settings()])


def test_a_very_long_text(spark, tables):
    _, table, labels = tables
    model = toxicity.fit(toxicity.labelled_sample(table, labels), settings=SMALL)
    text = "sane rest " * 200_000 + " ".join(BAD)
    rows = toxicity.score(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), model).collect()
    assert 0 <= rows[0].score <= 1 and abs(rows[0].score - 1 / (1 + 2.718281828459045 ** -model.margin(text))) < 1e-6


def test_no_labels_and_no_documents(spark, tables):
    _, table, labels = tables
    assert {(round(x.score, 3), x.predicted) for x in toxicity.toxicity(table, labels.limit(0), settings=SMALL).collect()} == {(0.269, 0)}
    assert toxicity.toxicity(table.limit(0), labels, settings=SMALL).count() == 0


def plain_ftrl(rows, s):
    """The algorithm as it is written down: a dictionary of (z, n) a coordinate, nothing left out from the start."""
    import math

    z, n, bias = {}, {}, "bias"
    scale = lambda i: 1.0 if i == bias or i < 1 << s.bits else s.context

    def weight(i):
        least = 0.0 if i == bias else s.l1
        if abs(z.get(i, 0.0)) <= least:
            return 0.0
        return (math.copysign(least, z[i]) - z[i]) / ((s.beta + math.sqrt(n[i])) / s.alpha + s.l2)

    for _ in range(s.epochs):
        for slots, label in rows:
            active = [*map(int, slots), bias]
            p = 1 / (1 + math.exp(-sum(weight(i) * scale(i) for i in active)))
            w = {i: weight(i) for i in active}
            for i in active:
                g = (p - label) * (s.positive_weight if label else 1.0) * scale(i)
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / s.alpha
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z if i != bias and weight(i)}, weight(bias)


@pytest.mark.parametrize("l1", [0.0, 0.5, 3.0])
def test_weights_are_those_of_the_plain_algorithm(l1):
    """Per-coordinate rates and sparsity against a dictionary of coordinates; a slot left out beforehand never had a weight."""
    r = random.Random(11)
    s = toxicity.Settings(bits=5, epochs=3, l1=l1)
    rows = []
    for _ in range(120):
        slots = sorted({r.randrange(64) for _ in range(r.randint(0, 12))})
        rows.append((toxicity.np.array(slots, toxicity.np.int32), int(r.random() < (0.8 if 3 in slots or 40 in slots else 0.2))))
    model = toxicity.ftrl(rows, s)
    weights, bias = plain_ftrl(rows, s)
    assert {int(i): round(float(w), 4) for i, w in zip(model.slots, model.weights)} == {i: round(w, 4) for i, w in weights.items()}
    assert abs(model.bias - bias) < 1e-6 and (l1 == 0.0 or len(weights) < 64)
