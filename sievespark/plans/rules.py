"""Rule packs: declared in YAML, checked on the driver, small enough to go to every task."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession

from ..functions.severity import ORDER

SHIPPED = Path(__file__).with_name("shipped_rules.yaml")
STRATEGIES = ("full", "keep_prefix", "keep_suffix")
FLAGS = {"ignorecase": re.I, "multiline": re.M, "dotall": re.S}
_ID = re.compile(r"[a-z0-9]+(?:-[a-z0-9]+)*")
_KEYS = {"id", "description", "severity", "regex", "flags", "entropy_min", "keywords", "keyword_window", "requires_keyword", "redaction", "redaction_keep", "base_confidence", "validator", "hint"}


class RuleError(ValueError):
    """A rule or pack that can't be used."""


@dataclass(frozen=True)
class Rule:
    id: str
    description: str
    severity: str
    regex: str
    flags: tuple[str, ...] = ()
    entropy_min: float | None = None
    keywords: tuple[str, ...] = ()
    keyword_window: int = 64
    requires_keyword: bool = False
    redaction: str = "full"
    redaction_keep: int = 4
    base_confidence: float = 0.5
    validator: str | None = None
    hint: tuple[str, ...] = ()

    def pattern(self) -> re.Pattern:
        bits = 0
        for f in self.flags:
            bits |= FLAGS[f]
        return re.compile(self.regex, bits)

    def hints(self) -> tuple[str, ...]:
        """What a text must hold for the rule to report anything; none where that isn't known."""
        return self.hint or (self.keywords if self.requires_keyword else ())


@dataclass(frozen=True)
class RulePack:
    version: str
    rules: tuple[Rule, ...]

    def prune(self) -> tuple[str, ...] | None:
        """Lower-case words of which a text holds one if it has a reportable match; None if some rule gives no hint."""
        hints = [r.hints() for r in self.rules]
        if not hints or not all(hints):
            return None
        words = {h.lower() for hs in hints for h in hs}
        return tuple(sorted(w for w in words if not any(v != w and v in w for v in words)))

    def frame(self, spark: SparkSession) -> DataFrame:
        """The rules as a table."""
        schema = "id string, description string, severity string, regex string, flags array<string>, entropy_min double, keywords array<string>, keyword_window int, requires_keyword boolean, redaction string, redaction_keep int, base_confidence double, validator string, ord int"
        rows = [(r.id, r.description, r.severity, r.regex, list(r.flags), r.entropy_min, list(r.keywords), r.keyword_window, r.requires_keyword, r.redaction, r.redaction_keep, r.base_confidence, r.validator, i) for i, r in enumerate(self.rules)]
        return spark.createDataFrame(rows, schema)


class _Strict(yaml.SafeLoader):
    """YAML that refuses a mapping with a key twice."""


def _mapping(loader: _Strict, node: yaml.MappingNode) -> dict:
    keys = [loader.construct_object(k, deep=True) for k, _ in node.value]
    if len(set(map(str, keys))) < len(keys):
        raise RuleError(f"a key stands twice at line {node.start_mark.line + 1}")
    return {k: loader.construct_object(v, deep=True) for k, (_, v) in zip(keys, node.value)}


_Strict.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, _mapping)


def load(source: str | Path = SHIPPED) -> RulePack:
    """Pack from a YAML file, or from YAML text."""
    text = source.read_text(encoding="utf-8") if isinstance(source, Path) else source
    try:
        found = yaml.load(text, Loader=_Strict)
    except yaml.YAMLError as e:
        raise RuleError(f"not YAML: {e}") from e
    if not isinstance(found, dict) or not isinstance(found.get("rules"), list) or not str(found.get("version") or "").strip():
        raise RuleError("a pack has a version and a list of rules")
    rules = tuple(build(r) for r in found["rules"])
    twice = sorted({r.id for r in rules if sum(x.id == r.id for x in rules) > 1})
    if twice:
        raise RuleError(f"rule ids stand twice: {', '.join(twice)}")
    return RulePack(str(found["version"]), rules)


def build(raw: dict) -> Rule:
    """One checked rule from its mapping."""
    if not isinstance(raw, dict):
        raise RuleError("a rule is a mapping")
    name = raw.get("id")

    def need(ok: bool, what: str) -> None:
        if not ok:
            raise RuleError(f"rule {name!r}: {what}")

    need(not set(raw) - _KEYS, f"unknown keys {sorted(set(raw) - _KEYS)}")
    need(isinstance(name, str) and bool(_ID.fullmatch(name)), "the id is lower-case words joined by hyphens")
    for key in ("description", "regex"):
        need(isinstance(raw.get(key), str) and bool(raw[key].strip()), f"{key} is a text that isn't empty")
    need(raw.get("severity") in ORDER, f"severity is one of {', '.join(ORDER)}")
    flags, keywords = raw.get("flags") or [], raw.get("keywords") or []
    need(isinstance(flags, list) and all(f in FLAGS for f in flags), f"flags are of {', '.join(FLAGS)}")
    need(isinstance(keywords, list) and all(isinstance(k, str) and k.strip() for k in keywords), "keywords are texts")
    keywords = [k.strip().lower() for k in keywords]
    need(len(set(keywords)) == len(keywords), "a keyword stands twice")
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)
    gate = raw.get("entropy_min")
    need(gate is None or number(gate) and gate >= 0, "entropy_min is a number from 0")
    base = raw.get("base_confidence", Rule.base_confidence)
    need(number(base) and 0 <= base <= 1, "base_confidence is between 0 and 1")
    window, keep = raw.get("keyword_window", Rule.keyword_window), raw.get("redaction_keep", Rule.redaction_keep)
    need(isinstance(window, int) and not isinstance(window, bool) and window >= 0, "keyword_window is a whole number from 0")
    need(isinstance(keep, int) and not isinstance(keep, bool) and keep >= 0, "redaction_keep is a whole number from 0")
    required = raw.get("requires_keyword", False)
    need(isinstance(required, bool) and (not required or bool(keywords)), "requires_keyword is a boolean and needs keywords")
    need(raw.get("redaction", "full") in STRATEGIES, f"redaction is one of {', '.join(STRATEGIES)}")
    rule = Rule(name, raw["description"], raw["severity"], raw["regex"], tuple(flags), None if gate is None else float(gate), tuple(keywords), window, required, raw.get("redaction", "full"), keep, float(base), raw.get("validator"), tuple(raw.get("hint") or ()))
    try:
        pattern = rule.pattern()
    except re.error as e:
        raise RuleError(f"rule {name!r}: the pattern doesn't compile: {e}") from e
    need(not pattern.search(""), "the pattern matches the empty text")
    trouble = explosive(rule.regex)
    need(not trouble, trouble or "")
    return rule


def explosive(regex: str) -> str | None:
    """Why a pattern could backtrack without bound, or None.

    Two shapes are refused: a repeat of varying length inside a group that repeats, and alternatives directly
    in a group that repeats. A repeat of a fixed count is harmless. The pattern is read as Python's own parser
    sees it.
    """
    from re import _constants as op
    from re import _parser

    repeats = (op.MAX_REPEAT, op.MIN_REPEAT)

    def walk(items, inside: bool) -> str | None:
        for code, arg in items:
            if code in repeats:
                low, high, body = arg
                varies = high != low and high > 1
                grouped = len(body) != 1 or body[0][0] in (op.SUBPATTERN, op.BRANCH, *repeats)
                if varies and inside:
                    return "a repeat of varying length stands inside a repeated group"
                if varies and grouped and any(c == op.BRANCH for c, _ in _bare(body)):
                    return "alternatives stand directly in a repeated group"
                trouble = walk(body, inside or varies and grouped)
            elif code == op.SUBPATTERN:
                trouble = walk(arg[-1], inside)
            elif code == op.BRANCH:
                trouble = next((t for b in arg[1] if (t := walk(b, inside))), None)
            elif code in (op.ASSERT, op.ASSERT_NOT):
                trouble = walk(arg[1], False)
            else:
                trouble = None
            if trouble:
                return trouble
        return None

    def _bare(body):
        return _bare(body[0][1][-1]) if len(body) == 1 and body[0][0] == op.SUBPATTERN else list(body)

    return walk(_parser.parse(regex), False)


def java(regex: str) -> str:
    """The pattern in Java's dialect, with Unicode classes as in Python."""
    out = regex.replace("(?P<", "(?<")
    return f"(?iuU){out.removeprefix('(?i)')}" if out.startswith("(?i)") else f"(?U){out}"
