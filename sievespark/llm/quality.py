"""Quality rules: a log-likelihood ratio of hashed n-grams between trusted and raw text, and rules on repetition.

Words and word pairs fall into a fixed number of hash buckets. Over all documents two multinomials are counted,
one of the trusted documents and one of everything; a document's score is the mean over its n-grams of the log
ratio of their buckets' shares. The cut is learnt from trusted documents that are not counted as such, so it
follows the level of the scores, whatever the corpus and however few labels. Everything here is a DataFrame
expression.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, sized_broadcast

#: Hash buckets, a bound on what the counts send to the driver.
BUCKETS = 16384
#: Numbers of raw n-grams that trusted counts may be mixed with; the text kept apart chooses among them.
PRIORS = tuple(4**k for k in range(13))
#: One trusted document in so many is kept apart for the cut. The cut lies below this share of theirs, by a part of the
#: distance from there to their median: a quarter, and more the fewer they are, by so many over their number.
APART, LOWEST, ROOM, FEW = 5, 0.01, 0.25, 10.0
#: Fewest words; most words in repeated windows, in percent; words a window.
FEWEST_WORDS, MOST_REPEATED, WINDOW = 50, 50, 3
_SPACE, _SYMBOL = r"[\x20\x09-\x0D]+", "[#*$%&|<>]"


def words_of(text: Column) -> Column:
    """Runs of anything but space, tab, LF, VT, FF and CR, in order; a null text has none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _SPACE))


def bucket_of(*gram: Column) -> Column:
    return F.pmod(F.xxhash64(*gram), F.lit(BUCKETS)).cast("int")


def grams_of(words: Column) -> Column:
    """Buckets of all words and of all pairs of neighbours."""
    n = F.size(words)
    pairs = F.zip_with(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), F.slice(words, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: bucket_of(a, b))
    return F.concat(F.transform(words, lambda w: bucket_of(w)), pairs)


def with_value(value: Column, body) -> Column:
    """``body`` over ``value``, which is computed once a row however often the body names it."""
    return F.transform(F.array(value), body)[0]


def kept_apart(id_col: Column) -> Column:
    """One trusted document in five, by a hash of its id, is never counted as trusted."""
    return F.pmod(F.xxhash64(id_col.cast("string")), F.lit(APART)) == 0


def bucket_counts(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(bucket, n_raw, n_trusted, n_apart)`` over the n-grams of all whole texts, repeats included.

    ``trusted`` has the ids of trusted documents, of which those that are ``kept_apart`` are counted as such; it is
    broadcast only below a checked number of rows. Counts are summed within each task first, so at most ``BUCKETS`` rows a
    task are shuffled.
    """
    ids = trusted.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id")).distinct()
    marked = sized_broadcast(ids.withColumn("_apart", kept_apart(F.col("_id")).cast("int")))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(marked, "_id", "left")
    grams = rows.select("_apart", F.explode(with_value(words_of(F.col("_text")), grams_of)).alias("bucket"))
    return grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_raw"), F.count_if(F.col("_apart") == 0).alias("n_trusted"), F.count_if(F.col("_apart") == 1).alias("n_apart"))


def prior_of(trusted: np.ndarray, apart: np.ndarray, raw: np.ndarray) -> int:
    """How many raw n-grams the trusted counts are mixed with: of ``PRIORS`` the one under which the text kept apart is
    likeliest; the largest, which trusts the counts least, where no text is kept apart. That text itself is taken out of
    the raw counts, which would otherwise know it."""
    shares = np.maximum(raw - apart, 1) / np.maximum(raw - apart, 1).sum()
    likely = [float(apart @ np.log((trusted + p * shares) / (trusted.sum() + p))) for p in PRIORS]
    return PRIORS[int(np.argmax(likely))] if apart.any() else PRIORS[-1]


def log_ratios(counts: DataFrame) -> list[float]:
    """For each bucket the log of its share in trusted text over that in all text.

    The trusted multinomial is mixed with n-grams of raw text, as many as ``prior_of`` finds: where trusted text is sparse
    its shares back off to the raw ones and the ratio to one. A bucket that no text fills counts as one raw n-gram.
    Without any trusted text all are zero. ``BUCKETS`` rows reach the driver, whatever the corpus.
    """
    raw, trusted, apart = np.zeros((3, BUCKETS))
    for r in counts.collect():
        raw[r["bucket"]], trusted[r["bucket"]], apart[r["bucket"]] = r["n_raw"], r["n_trusted"], r["n_apart"]
    shares = np.maximum(raw, 1) / np.maximum(raw, 1).sum()
    prior = prior_of(trusted, apart, raw)
    return [round(x, 6) for x in np.log((trusted / shares + prior) / (trusted.sum() + prior)).tolist()]


def base_rule(n_words: Column, n_repeat_words: Column) -> Column:
    """The document fails: it has too few words or too many of them in repeated windows."""
    return (n_words < FEWEST_WORDS) | (100 * n_repeat_words > MOST_REPEATED * n_words)


def lowest_kept(docs: DataFrame, apart: DataFrame, ratios: list[float], id_col: str = "doc_id", text_col: str = "text") -> float:
    """The cut: somewhat below the lowest hundredth of the scores of trusted documents kept apart.

    Scores of several languages or sources lie in several heaps, so the cut is told by the lowest of them and not by how
    wide they lie. With n scores it is q - (median - q) * (``ROOM`` + ``FEW`` / n), q being their ``LOWEST`` quantile.
    Documents that fail the base rule don't count. Without any such document there is nothing to reject by and
    the cut is minus infinity. Three numbers reach the driver.
    """
    ids = sized_broadcast(apart.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id")).distinct())
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(ids, "_id", "left_semi")
    score = lambda w: F.when(~base_rule(F.size(w), repeated_words(w)), F.round(mean_log_ratio(w, ratios), 9))
    scores = rows.select(with_value(words_of(F.col("_text")), score).alias("score"))
    found = scores.agg(F.percentile_approx("score", F.array(F.lit(LOWEST), F.lit(0.5)), F.lit(10_000)).alias("q"), F.count("score").alias("n")).first()
    return found["q"][0] - (found["q"][1] - found["q"][0]) * (ROOM + FEW / found["n"]) if found["n"] else -math.inf


def mean_log_ratio(words: Column, ratios: list[float]) -> Column:
    """Mean over a document's n-grams; zero for a document without words."""
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")

    def of(w: Column) -> Column:
        total = F.aggregate(grams_of(w), F.lit(0.0), lambda acc, b: acc + F.element_at(table, b + 1))
        return F.when(F.size(w) > 0, total / (2 * F.size(w) - 1)).otherwise(F.lit(0.0))

    return with_value(words, of)


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of three words found twice or more in the text, the first one included.

    Windows are told apart by 64-bit hashes. If all differ, none repeats; else hashes with their places are
    sorted, so that equal ones stand together, the places of those are sorted again and the words that they
    cover counted. The words are bound once, so that a filter on the result never cuts them again per window.
    """

    def covered(places: Column) -> Column:
        gap = lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW)))
        return F.aggregate(F.transform(places, gap), F.lit(0), lambda a, x: a + x)

    def places(ordered: Column) -> Column:
        near = lambda x, i: x["w"].eqNullSafe(F.get(ordered, i - 1)["w"]) | x["w"].eqNullSafe(F.get(ordered, i + 1)["w"])
        return F.array_sort(F.transform(F.filter(ordered, near), lambda x: x["at"]))

    def count(w: Column) -> Column:
        ordered = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("at"))))
        found = with_value(with_value(ordered, places), covered)
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(found)

    def of(w: Column) -> Column:
        span = F.size(w) - (WINDOW - 1)
        windows = F.transform(F.sequence(F.lit(0), F.greatest(span - 1, F.lit(0))), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(span < 2, F.lit(0)).otherwise(with_value(windows, count)).cast("bigint")

    return with_value(words, of)


def symbols(text: Column) -> Column:
    """Characters of ``#*$%&|<>``; most texts have none and are only searched."""
    return F.when(text.rlike(_SYMBOL), F.length(text) - F.length(F.regexp_replace(text, f"{_SYMBOL}+", ""))).otherwise(F.lit(0)).cast("bigint")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that are equal to an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return with_value(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint")


def quality(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float | None = None) -> DataFrame:
    """``(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, log_ratio, kept)`` per row.

    ``trusted`` has the ids of target documents in ``id_col``: four in five make the target, the others the cut,
    unless a ``threshold`` is given. Every document meets the same cut; there is no chance in it. A null or empty
    text has no words and fails the base rule; repeated rows each keep a row; an empty table gives none.
    """
    ids = trusted.select(id_col)
    counts = materialize(bucket_counts(docs, ids, id_col, text_col), "bucket-counts")
    ratios = log_ratios(counts)
    cut = lowest_kept(docs, ids.where(kept_apart(F.col(id_col))), ratios, id_col, text_col) if threshold is None else threshold
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(F.col(id_col).alias("id"), text.alias("_text"), words_of(F.col(text_col)).alias("_words"))
    found = found.select(
        "id",
        F.size("_words").cast("bigint").alias("n_words"),
        F.aggregate("_words", F.lit(0).cast("bigint"), lambda n, w: n + F.length(w)).alias("word_chars"),
        symbols(F.col("_text")).alias("n_symbols"),
        duplicate_lines(F.col("_text")).alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
        mean_log_ratio(F.col("_words"), ratios).alias("log_ratio"),
    )
    failed = base_rule(F.col("n_words"), F.col("n_repeat_words"))
    return found.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("log_ratio") >= F.lit(cut)))
