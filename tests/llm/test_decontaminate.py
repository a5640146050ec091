"""Benchmark passages: the bit-parallel distance and the whole search against brute force."""

import random

from sievespark.llm import decontaminate as d

DOCS = "doc_id bigint, text string, item_id string, distance int"


def distance_to_any_part(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != x), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_myers_is_the_edit_distance():
    r = random.Random(1)
    for _ in range(1500):
        item = "".join(r.choice("abc") for _ in range(r.randint(1, 14)))
        text = "".join(r.choice("abc") for _ in range(r.randint(0, 25)))
        least, budget = distance_to_any_part(item, text), r.randint(0, len(item) - 1)
        got = d.myers(d.peq(item), len(item), text, budget)
        assert (got[0] if got else None) == (least if least <= budget else None)


def test_pieces_cover_the_item():
    item = "abcdefghij" * 7
    budget, parts = d.pieces(item, 0.08)
    assert len(parts) == budget + 1 and "".join(p for _, p in parts) == item


def test_search_equals_brute_force(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("aeinrst") for _ in range(r.randint(2, 6)))
    items = [(i, " ".join(word() for _ in range(12))) for i in range(6)] + [(6, "Yes  no"), (7, None), (8, "  "), (None, "an item without any id at all")]
    docs = []
    for n in range(60):
        text = " ".join(word() for _ in range(r.randint(0, 40)))
        if n % 2:
            item = list(r.choice(items[:6])[1])
            for _ in range(r.randint(0, 7)):
                at = r.randrange(len(item))
                item[at : at + 1] = r.choice([[], ["z"], [item[at], "q"]])
            text = f"{text}\n {''.join(item).upper()} {text}"
        docs.append((n, text, "x", 1))
    docs += [(100, None, None, None), (101, "", "", 0), docs[1], (102, "x, YES\nno!", "", 0), (103, "eyes no", "", 0), (104, "yes nono", "", 0), (105, "w" * 200_000 + " yes no", "", 0)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    table = spark.createDataFrame(docs, DOCS)
    want = sorted((i, k, least) for i, t, _, _ in docs if t and i != 105 for k, item in items[:6] for least in [distance_to_any_part(d.normalise(item), d.normalise(t))] if least <= int(len(item) * d.ERROR_RATE)) + [(102, 6, 0), (105, 6, 0)]
    want.sort()
    for block_chars in (d.BLOCK_CHARS, 80, 20):
        got = sorted((x.doc_id, x.item_id, x.distance) for x in d.matches(table, bench, block_chars=block_chars, whole_words_below=20).collect())
        assert got == want and len(want) > 15
    kept = d.clean_rows(table, bench, whole_words_below=20)
    assert kept.columns == table.columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted(i for i, *_ in docs if i not in {w[0] for w in want})


def test_empty_sides(spark):
    docs, bench = spark.createDataFrame([(1, "some text", "", 0)], DOCS), spark.createDataFrame([], "item_id bigint, text string")
    assert d.matches(docs, bench).count() == 0 and d.clean_rows(docs, bench).count() == 1
    items = spark.createDataFrame([(1, "an item that is long enough to count")], "item_id bigint, text string")
    assert d.matches(docs.limit(0), items).count() == 0


def test_an_automaton_is_built_once_a_process_and_block(spark, monkeypatch):
    built = []

    class Counted(d.Matcher):
        def __init__(self, items, *options):
            built.append(items)
            super().__init__(items, *options)

    class Shared:
        def __init__(self, *value):
            self.value = value

    monkeypatch.setattr(d, "Matcher", Counted)
    four = [Shared(str(i), [(i, f"item number {i} of the benchmark")]) for i in range(4)]
    fine = [d._matchers(four, 0.1) for _ in range(50)]
    assert len(built) == 4 and all(len(x) == 4 for x in fine)
    d._matchers([Shared("9", [(9, "another")])], 0.1)
    assert len(built) == 5 and len(d._MATCHERS) == 1


def test_short_items_can_be_left_out(spark):
    docs, bench = spark.createDataFrame([(1, "well, yes", "", 0)], DOCS), spark.createDataFrame([(1, "yes")], "item_id bigint, text string")
    assert d.matches(docs, bench).count() == 1 and d.clean_rows(docs, bench).count() == 0
    assert d.matches(docs, bench, shortest_item=4).count() == 0 and d.clean_rows(docs, bench, shortest_item=4).count() == 1


def test_short_items_have_the_same_rate():
    """Items of 5 to 25 characters, unchanged or with one edit, against the plain distance; no length is a special one."""
    r = random.Random(6)
    for _ in range(1500):
        item = "".join(r.choice("abcd") for _ in range(r.randint(5, 25)))
        inside = list(item)
        at = r.randrange(len(inside))
        inside[at : at + 1] = r.choice([[item[at]], [], ["z"], [item[at], "q"]])
        text = "".join(r.choice("abcdz") for _ in range(r.randint(0, 9))) + "".join(inside) + "".join(r.choice("abcdz") for _ in range(r.randint(0, 9)))
        least = distance_to_any_part(item, text)
        found = d.Matcher([(7, item)], d.ERROR_RATE).search(text)
        assert [x[:2] for x in found] == ([(7, least)] if least <= len(item) // 10 else [])


def test_nineteen_characters_with_one_edit():
    assert d.Matcher([(1, "what is it called x")], d.ERROR_RATE).search("so what is at called xyz")[0][:2] == (1, 1)
    assert d.Matcher([(1, "what is it called x")], d.ERROR_RATE, 20).search("so what is at called xyz") == []
