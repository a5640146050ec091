"""Quality rules: base counts against brute force, the verdict on planted junk, odd inputs."""

import math
import random
import re
from collections import Counter

from sievespark.llm import quality

DOCS = "doc_id bigint, text string, kept string, bucket int, _id int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    windows = list(zip(words, words[1:], words[2:]))
    seen = Counter(windows)
    covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def tables(spark):
    r = random.Random(3)
    clean = [w + x for w in "th er an re on in".split() for x in "a e st nd ly".split()]
    docs = []
    for i in range(200):
        words = [r.choice(clean) for _ in range(r.randint(60, 200))]
        if i % 4 == 0:
            words = [w + r.choice(["###", "$$$", "|"]) for w in words]
        docs.append((i, " ".join(words), "x", 1, 2))
    odd = [None, "", " \n\t ", "a", "a b", "a b c a b c", "x " * 80, "one\ntwo\none\n\n one\ntwo", "𝒳 é\x0bß\x0c#|", "  　"]
    odd += [" ".join(r.choice("abc") for _ in range(r.randint(0, 30))) for _ in range(150)] + ["w" * 100_000, "a b " * 20_000]
    docs += [(1000 + i, t, None, None, None) for i, t in enumerate(odd)] + [docs[1], (None, "some text", "", 0, 0)]
    trusted = [(i,) for i in range(200) if i % 4 and i % 3] + [(None,), (1,), (1,), (9999,)]
    return docs, spark.createDataFrame(docs, DOCS), spark.createDataFrame(trusted, "doc_id bigint")


def test_base_columns_and_verdicts(spark):
    docs, table, trusted = tables(spark)
    found = quality.quality(table, trusted).collect()
    assert len(found) == len(docs)
    want = Counter((i, *base(t)) for i, t, *_ in docs)
    assert Counter((x.id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) for x in found) == want
    apart = {r[0] for r in trusted.where(quality.kept_apart(quality.F.col("doc_id"))).collect()}
    scores = sorted(round(x.log_ratio, 9) for x in found if x.id in apart and not x.base_failed)
    low, middle = (scores[math.ceil(len(scores) * q) - 1] for q in (quality.LOWEST, 0.5))
    cut = low - (middle - low) * (quality.ROOM + quality.FEW / len(scores))
    for x in found:
        assert x.kept == (not x.base_failed and x.log_ratio >= cut)
        if x.id is not None and x.id < 200:
            assert x.base_failed or x.kept == bool(x.id % 4)


def test_ratio_is_the_mean_over_all_grams(spark):
    one = spark.range(1, 50).where(~quality.kept_apart(quality.F.col("id"))).first().id
    table = spark.createDataFrame([(one, "a b a"), (100, "b c")], "doc_id bigint, text string")
    counts = {x.bucket: (x.n_raw, x.n_trusted) for x in quality.bucket_counts(table, table.where(f"doc_id = {one}")).collect()}
    assert sum(n for n, _ in counts.values()) == 5 + 3 and sum(n for _, n in counts.values()) == 5
    ratios = quality.log_ratios(quality.bucket_counts(table, table.where(f"doc_id = {one}")))
    bucket = lambda *w: spark.range(1).select(quality.bucket_of(*map(quality.F.lit, w)).alias("b")).first().b
    want = sum(ratios[bucket(*g)] for g in ("a", "b", "a", "ab", "ba")) / 5
    got = {x.id: x.log_ratio for x in quality.quality(table, table.where(f"doc_id = {one}")).collect()}
    assert abs(got[one] - want) < 1e-9


def test_few_labels_leave_clean_documents_alone(spark):
    docs, table, trusted = tables(spark)
    few = trusted.where("doc_id < 60")
    kept = {x.id for x in quality.quality(table, few).collect() if x.kept}
    clean = [i for i in range(200) if i % 4 and not base(docs[i][1])[-1]]
    assert sum(i in kept for i in clean) >= 0.97 * len(clean)


def test_a_filter_on_the_verdict_and_a_very_long_text(spark):
    r = random.Random(9)
    long = " ".join("".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(300_000))
    table = spark.createDataFrame([(1, long), (2, "w " * 300_000)], "doc_id bigint, text string")
    assert [x.id for x in quality.quality(table, table.limit(0)).where("kept and not base_failed").collect()] == [1]


def test_empty_sides(spark):
    _, table, trusted = tables(spark)
    assert quality.quality(table.limit(0), trusted).count() == 0
    assert {x.log_ratio for x in quality.quality(table, trusted.limit(0)).collect()} == {0.0}


def test_the_prior_makes_the_text_kept_apart_likeliest():
    r = quality.np.random.default_rng(5)
    raw = r.integers(1, 500, quality.BUCKETS).astype(float)
    near, far = raw * r.uniform(0.9, 1.1, quality.BUCKETS), raw * r.exponential(1, quality.BUCKETS)
    few = r.multinomial(3000, near / near.sum()).astype(float)
    many = r.multinomial(2_000_000, far / far.sum()).astype(float)
    apart = r.multinomial(100_000, far / far.sum()).astype(float)
    assert quality.prior_of(many, apart, raw + many + apart) < 1 << 18 < quality.prior_of(few, r.multinomial(500, near / near.sum()), raw * 100)
    assert quality.prior_of(many, 0 * apart, raw) == quality.PRIORS[-1]


def test_small_tables_reject_most_of_what_is_marked_bad(spark):
    """On the small table whose labels are few: most documents of quality 0 go, of the trusted ones next to none."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = quality.quality(docs, labels.where("quality = 1")).where("NOT base_failed").withColumnRenamed("id", "doc_id").join(labels, "doc_id")
    kept = {r.quality: (r.k, r.n) for r in found.groupBy("quality").agg(quality.F.count_if("kept").alias("k"), quality.F.count("*").alias("n")).collect()}
    assert kept[0][0] <= 0.5 * kept[0][1] and kept[1][0] >= 0.97 * kept[1][1], kept
