"""Entropy, keyword nearness, confidence and masks as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the score.
ENTROPY_WEIGHT, ENTROPY_HEADROOM, NEAR_BONUS, FAR_PENALTY = 0.2, 1.5, 0.15, 0.1
#: Fixed values of masks.
KEEP, CONTEXT, LEAST_REVEALED = 4, 48, 16


def entropy(text: Column) -> Column:
    """Shannon entropy in bits a character over the text's own alphabet; 0 for an empty text."""
    n = F.length(text).cast("double")

    def bits(chars: Column) -> Column:
        shares = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
        return F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))

    return F.when(n > 0, F.transform(F.array(F.split(text, "")), lambda c: bits(F.filter(c, lambda x: x != "")))[0]).otherwise(F.when(text.isNotNull(), F.lit(0.0)))


def near_keyword(text: Column, start: Column, end: Column, keywords: list[str], window: int) -> Column:
    """The first keyword, in the given order, that stands as a word and reaches into the window around [start, end).

    A keyword's neighbours may not be letters a-z or digits; the underscore is a border.
    """
    if not keywords:
        return F.lit(None).cast("string")
    low, high = F.greatest(start - window, F.lit(0)), F.least(end + window, F.length(text))
    found = []
    for k in keywords:
        reach = len(k) - 1
        left = F.greatest(low - reach, F.lit(0))
        area = F.lower(F.substring(text, F.greatest(left - 1, F.lit(0)) + 1, high + reach - F.greatest(left - 1, F.lit(0)) + 1))
        skip = F.when(left > 0, F.lit("(?s)^.")).otherwise(F.lit("(?s)^"))
        pattern = F.concat(skip, F.lit(f".*?(?<![a-z0-9]){re.escape(k)}(?![a-z0-9])"))
        found.append(F.when(F.rlike(area, pattern), F.lit(k)))
    return F.coalesce(*found)


def confidence(base: Column, bits: Column, least_bits: Column, has_keywords: Column, near: Column) -> Column:
    """``base`` plus up to 0.2 for entropy above the rule's gate, plus 0.15 with a keyword near or minus 0.1 without; in [0, 1]."""
    above = F.greatest(F.lit(0.0), bits - least_bits)
    bonus = F.when(least_bits.isNotNull(), ENTROPY_WEIGHT * F.least(F.lit(1.0), above / ENTROPY_HEADROOM)).otherwise(0.0)
    nearness = F.when(has_keywords, F.when(near, NEAR_BONUS).otherwise(-FAR_PENALTY)).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), base + bonus + nearness))


def revealable(length: Column, strategy: Column, keep: Column) -> Column:
    """Characters of a secret that its mask may show."""
    return F.when((strategy == "full") | (length < LEAST_REVEALED), 0).otherwise(F.greatest(F.lit(0), F.least(keep, F.floor(length / 3).cast("int"))))


def mask(secret: Column, strategy: Column, keep: Column) -> Column:
    """``[n chars redacted]``, with a few characters before or after it where the strategy allows."""
    n = F.length(secret)
    shown = revealable(n, strategy, keep)
    mark = F.concat(F.lit("["), (n - shown).cast("string"), F.lit(" chars redacted]"))
    tail = F.concat(mark, F.lit("…"), F.right(secret, shown))
    head = F.concat(F.left(secret, shown), F.lit("…"), mark)
    return F.when(shown == 0, mark).when(strategy == "keep_suffix", tail).otherwise(head)


def context_window(length: Column, start: Column, end: Column, context: int = CONTEXT) -> Column:
    """``struct(start, end)`` of the text around a span that a snippet may show."""
    return F.struct(F.greatest(F.lit(0), start - context).alias("start"), F.least(length, end + context).alias("end"))


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start < b_end) & (b_start < a_end)
