"""SimHash: fingerprints and components against brute force, both ways of a key, odd inputs."""

import random
import re

import xxhash

from sievespark.llm import simhash

DOCS = "doc_id bigint, text string, fp string, component int, root string"


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes) > len(hashes))


def brute_components(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_components_equal_brute_force(spark):
    r = random.Random(8)
    base = [r.getrandbits(64) for _ in range(6)]
    prints, frontier = {}, list(base)
    for i in range(400):
        x = r.choice(frontier)
        for _ in range(r.choice([0, 1, 2, 2, 3])):
            x ^= 1 << r.randrange(64)
        frontier.append(x)
        prints[i] = x
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    want = brute_components(prints)
    distinct = spark.createDataFrame([(signed(x),) for x in set(prints.values())], "fp bigint")
    for bucket in (2, 32):
        links = [(x.a, x.b) for x in simhash.fingerprint_links(distinct, bucket=bucket).collect()]
        assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in links)
        assert _classes(prints, signed, links) == want


def _classes(prints, signed, links):
    root = {signed(x): signed(x) for x in prints.values()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    low = {}
    for i, x in prints.items():
        low[find(signed(x))] = min(i, low.get(find(signed(x)), i))
    return {i: low[find(signed(x))] for i, x in prints.items()}


def test_documents(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("aeinrst") for _ in range(4))
    texts = [" ".join(word() for _ in range(300)) for _ in range(12)]
    texts += [t.upper() for t in texts[:4]] + [t + " end" for t in texts[:6]] + [None, "", " \n", "one", "one two", "É x y\x0bz", "a b c d"]
    rows = [(i, t, "clash", 1, "clash") for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows + [rows[0], (None, "one", "", 0, "")], DOCS)
    found = simhash.near_duplicates(table).collect()
    assert len(found) == len(rows) + 2
    prints = {i: brute_fingerprint(t) for i, t, *_ in rows}
    want = brute_components(prints)
    for x in found:
        if x.id is not None:
            assert x.fp & (1 << 64) - 1 == prints[x.id] and x.component == want[x.id]
    kept = simhash.representatives(table)
    assert kept.columns == table.columns
    assert sorted(x.doc_id for x in kept.collect() if x.doc_id is not None) == sorted([*set(want.values()), 0])


def test_a_large_group_of_copies(spark):
    table = spark.createDataFrame([(i, "the same words again and again", "", 0, "") for i in range(3000)], DOCS)
    assert {x.component for x in simhash.near_duplicates(table).collect()} == {0}


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
