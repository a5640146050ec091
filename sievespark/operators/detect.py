"""Findings in content units: patterns, entropy and keyword gates, confidence, overlaps, redaction, identity.

The plan prunes units with the pack's hints in the JVM; what is left goes through one Arrow stage, where a secret
is matched, hashed and masked and then forgotten: no column ever holds it. Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import hmac
import math
import re
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import DOMAIN, LEAST_PEPPER, nfc
from ..functions.scoring import ENTROPY_HEADROOM, ENTROPY_WEIGHT, FAR_PENALTY, NEAR_BONUS
from ..functions.severity import ORDER
from ..plans.rules import Rule, RulePack, java
from .redact import CONTEXT, LeakError, snippet

THRESHOLD, MOST_MATCHES = 0.5, 500
TALLIES = ("below_threshold", "no_keyword", "low_entropy", "overlapping")
FINDING = "connector_type string, resource_id string, sub_resource string, origin string, rule_id string, rulepack_version string, severity string, start int, end int, snippet string, secret_hash string, fingerprint string, entropy double, confidence double, keyword string"
TALLY = "connector_type string, resource_id string, sub_resource string, origin string, reported int, truncated boolean, " + ", ".join(f"{t} int" for t in TALLIES)


class Match(NamedTuple):
    order: int
    start: int
    end: int
    bits: float
    keyword: str | None
    score: float


@dataclass
class Result:
    matches: list[Match] = field(default_factory=list)
    dropped: Counter = field(default_factory=Counter)
    truncated: bool = False


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


class Detector:
    """A pack compiled once per task."""

    def __init__(self, pack: RulePack, threshold: float = THRESHOLD, most: int = MOST_MATCHES):
        self.pack, self.threshold, self.most = pack, threshold, most
        self.rules = [(r, p, "secret" if "secret" in p.groupindex else 0) for r in pack.rules for p in [r.pattern()]]
        self.hints = [tuple(h.lower() for h in r.hint) for r in pack.rules]
        self.words = {k: re.compile(rf"(?<![a-z0-9]){re.escape(k)}(?![a-z0-9])") for r in pack.rules for k in r.keywords}

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """``(rule's place, start, end)`` of every match's secret in pack order, before any gate.

        A rule whose hints are all missing can't match and isn't tried. The two letters that fold to plain s and
        k are not lowered to them, so a text with one is tried with every rule.
        """
        low = text.lower()
        every = "\u017f" in text or "\u212a" in text
        out = []
        for i, (rule, pattern, group) in enumerate(self.rules):
            if every or not rule.hint or any(h in low for h in self.hints[i]):
                out += [(i, *s) for m in pattern.finditer(text) if (s := m.span(group))[0] < s[1] and s[0] >= 0]
        return out

    def near(self, text: str, start: int, end: int, rule: Rule) -> str | None:
        """The rule's first keyword with a foot in the window; its neighbours are seen beyond the window's edge."""
        if not rule.keywords:
            return None
        low, high = max(0, start - rule.keyword_window), min(len(text), end + rule.keyword_window)
        left = max(0, low - max(map(len, rule.keywords)))
        area = text[left : high + max(map(len, rule.keywords))].lower()
        return next((k for k in rule.keywords if any(m.start() < high - left and m.end() > low - left for m in self.words[k].finditer(area))), None)

    def score(self, rule: Rule, bits: float, keyword: str | None) -> float:
        total = rule.base_confidence
        if rule.entropy_min is not None:
            total += ENTROPY_WEIGHT * min(1.0, max(0.0, bits - rule.entropy_min) / ENTROPY_HEADROOM)
        if rule.keywords:
            total += NEAR_BONUS if keyword else -FAR_PENALTY
        return min(1.0, max(0.0, total))

    def search(self, text: str, spans: list[tuple[int, int, int]]) -> Result:
        """Matches to report, in order of place."""
        out = Result()
        for order, start, end in spans:
            rule = self.rules[order][0]
            bits = entropy(text[start:end])
            if rule.entropy_min is not None and bits < rule.entropy_min:
                out.dropped["low_entropy"] += 1
                continue
            keyword = self.near(text, start, end, rule)
            if rule.requires_keyword and keyword is None:
                out.dropped["no_keyword"] += 1
                continue
            score = self.score(rule, bits, keyword)
            if score < self.threshold:
                out.dropped["below_threshold"] += 1
                continue
            out.matches.append(Match(order, start, end, bits, keyword, score))
        if len(out.matches) > self.most:
            out.truncated = True
            worth = lambda m: (-ORDER.index(self.rules[m.order][0].severity), -m.score, m.start)
            out.matches = sorted(sorted(out.matches, key=worth)[: self.most], key=lambda m: m.start)
        single = strongest(out.matches)
        out.dropped["overlapping"] = len(out.matches) - len(single)
        out.matches = single
        return out

    def snippet(self, text: str, m: Match, every: list[tuple[int, int]], widest: int) -> str:
        """The masked line of one match; ``every`` has all secrets' spans, sorted."""
        low, high = max(0, m.start - CONTEXT), min(len(text), m.end + CONTEXT)
        near = every[bisect_left(every, (low - widest, 0)) : bisect_right(every, (high, len(text)))]
        rule = self.rules[m.order][0]
        return snippet(text, m.start, m.end, [s for s in near if s[0] < high and low < s[1] and s != (m.start, m.end)], rule.redaction, rule.redaction_keep)


def strongest(matches: list[Match]) -> list[Match]:
    """Of overlapping matches the best by score, then length, then place; ties keep their order.

    What is kept never overlaps, so a candidate only meets the kept ones on either side of its start.
    """
    kept: list[tuple[int, int]] = []
    out = []
    for m in sorted(matches, key=lambda m: (-m.score, m.start - m.end, m.start)):
        at = bisect_left(kept, (m.start, m.start))
        if at and kept[at - 1][1] > m.start or at < len(kept) and kept[at][0] < m.end:
            continue
        insort(kept, (m.start, m.end))
        out.append(m)
    return sorted(out, key=lambda m: m.start)


@dataclass(frozen=True)
class Keys:
    """Pepper and domain of the identities; held by tasks, never part of a plan."""

    pepper: bytes
    domain: str = DOMAIN

    def __post_init__(self) -> None:
        if len(self.pepper) < LEAST_PEPPER:
            raise ValueError(f"a pepper has at least {LEAST_PEPPER} bytes")

    def _hash(self, purpose: str, message: bytes) -> str:
        return hmac.new(self.pepper, f"{self.domain}.{purpose}.v1".encode() + b"\0" + message, hashlib.sha256).hexdigest()

    def secret(self, value: str) -> str:
        return self._hash("secret", value.encode())

    def fingerprint(self, *parts: str | None) -> str:
        raw = [nfc(p or "").encode() for p in parts]
        return self._hash("fingerprint", b"".join([b"%d:%s|" % (len(r), r) for r in raw]))


def pruned(units: DataFrame, pack: RulePack, text_col: str = "text") -> DataFrame:
    """Units that could hold something to report, by plain searches in the JVM."""
    hints, text = pack.prune(), F.col(text_col)
    if hints is None:
        return units.where(text.isNotNull())

    def holds(low: Column) -> Column:
        found = text.contains("\u017f") | text.contains("\u212a")
        for h in hints:
            found = found | low.contains(h)
        return found

    return units.where(F.transform(F.array(F.lower(text)), holds)[0])


def _units(units: DataFrame) -> list[Column]:
    names = ("connector_type", "resource_id", "sub_resource", "origin")
    return [*[(F.col(c) if c in units.columns else F.lit(None)).cast("string").alias(c) for c in names], F.col("text")]


def findings(units: DataFrame, pack: RulePack, keys: Keys, threshold: float = THRESHOLD, most: int = MOST_MATCHES, previous: Keys | None = None) -> DataFrame:
    """A row per finding (``FINDING``); with ``previous`` keys also the identity under the old pepper.

    ``units`` has ``connector_type, resource_id, sub_resource, origin, text``; missing ones are null. A finding
    whose snippet would leak is dropped. Rows of several findings of one secret in one place share a fingerprint.
    """
    shared = units.sparkSession.sparkContext.broadcast((pack, keys, previous))
    schema = FINDING + (", previous_secret_hash string, previous_fingerprint string" if previous else "")
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, keys, previous = shared.value
        detector = Detector(pack, threshold, most)
        for batch in batches:
            rows = [row for unit in zip(*(c.to_pylist() for c in batch.columns)) for row in _findings_of(detector, unit, keys, previous)]
            if rows:
                columns = list(zip(*rows))
                types = [{"string": pa.string(), "int": pa.int32(), "double": pa.float64()}[x.strip().split(" ")[1]] for x in schema.split(",")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return pruned(units, pack).select(*_units(units)).mapInArrow(run, schema)


def _findings_of(detector: Detector, unit: tuple, keys: Keys, previous: Keys | None) -> Iterator[tuple]:
    connector, resource, sub, origin, text = unit
    spans = detector.spans(text)
    found = detector.search(text, spans).matches
    if not found:
        return
    every = sorted({(a, b) for _, a, b in spans})
    widest = max(b - a for a, b in every)
    for m in found:
        rule = detector.rules[m.order][0]
        try:
            line = detector.snippet(text, m, every, widest)
        except LeakError:
            continue
        secret = text[m.start : m.end]
        hashed = keys.secret(secret)
        row = (connector, resource, sub, origin, rule.id, detector.pack.version, rule.severity, m.start, m.end, line, hashed, keys.fingerprint(connector, resource, sub, rule.id, hashed), m.bits, m.score, m.keyword)
        if previous:
            old = previous.secret(secret)
            row += (old, previous.fingerprint(connector, resource, sub, rule.id, old))
        yield row


def tallies(units: DataFrame, pack: RulePack, threshold: float = THRESHOLD, most: int = MOST_MATCHES) -> DataFrame:
    """A row per unit (``TALLY``): what was reported and why the rest was not. A null text reports nothing."""
    shared = units.sparkSession.sparkContext.broadcast(pack)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = Detector(shared.value, threshold, most)
        for batch in batches:
            found = [detector.search(t, detector.spans(t)) for t in (x.as_py() or "" for x in batch.column(4))]
            counts = [pa.array([r.dropped[t] for r in found], pa.int32()) for t in TALLIES]
            arrays = [*batch.columns[:4], pa.array([len(r.matches) for r in found], pa.int32()), pa.array([r.truncated for r in found], pa.bool_()), *counts]
            yield pa.RecordBatch.from_arrays(arrays, names=["connector_type", "resource_id", "sub_resource", "origin", "reported", "truncated", *TALLIES])

    return units.select(*_units(units)).mapInArrow(run, TALLY)


def native_candidates(units: DataFrame, pack: RulePack, id_col: str, text_col: str = "text") -> DataFrame:
    """``(id, rule_id, secret)`` of all matches by Spark's own expressions, for packs whose secrets need no place.

    Plaintext leaves the operator here; use it to cross-check rules on test data.
    """
    def matches(rule: Rule) -> Column:
        group = rule.pattern().groupindex.get("secret", 0)
        found = F.regexp_extract_all(F.col(text_col), F.lit(java(rule.regex)), F.lit(group))
        named = F.transform(found, lambda s: F.struct(F.lit(rule.id).alias("rule_id"), s.alias("secret")))
        if not rule.hint:
            return named
        hint = "(?iu)" + "|".join(re.sub(r"([^A-Za-z0-9_ ])", r"\\\1", h) for h in rule.hint)
        return F.when(F.col(text_col).rlike(hint), named).otherwise(F.array().cast("array<struct<rule_id:string,secret:string>>"))

    parts = [matches(rule) for rule in pack.rules]
    rows = units.select(F.col(id_col).alias("id"), F.explode(F.concat(*parts)).alias("c"))
    return rows.select("id", "c.rule_id", "c.secret").where(F.length("secret") > 0)
