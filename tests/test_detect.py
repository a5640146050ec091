"""Rules, detection and redaction: gates, scores, overlaps, what a snippet may show."""

import hashlib
import hmac
import random

import pytest
from pyspark.sql import functions as F

from sievespark.functions import identity, scoring
from sievespark.operators import detect, redact
from sievespark.plans import rules

PACK = rules.load()
KEYS = detect.Keys(b"0123456789abcdef")
UNIT = "connector_type string, resource_id string, sub_resource string, origin string, text string"
AWS = "AK" + "IAQ7RSTUVWXYZ23BCD"
GITHUB = "gh" + "p_" + "aB3dE5fG7hJ9kL1mN3pQ5rS7tU9vW1xY3zA5"
POSITIVE = {
    "aws-access-key-id": f"the aws access key is {AWS} here",
    "aws-secret-access-key": "aws_secret_access_key = " + "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzQ4RtZ8qLm",
    "gcp-api-key": "google maps key AI" + "zaSyA1b2C3d4E5f6G7h8I9j0K1l2M3n4O5p6Q",
    "github-token": f"github token {GITHUB}",
    "slack-token": "slack bot token xo" + "xb-1234567890-abcdefghij",
    "stripe-api-key": "stripe payment key sk" + "_live_4eC39HqLyjWDarjtT1zdp7dc",
    "private-key-block": "ssh private key -----BEGIN RSA " + "PRIVATE KEY-----\nMIIEpAIBAAKCAQEA\n-----END RSA PRIVATE KEY-----",
    "connection-string-password": "database url postgres://admin:s3cr3tPass@db.internal/app",
    "basic-auth-header": "curl -H 'Authorization: Basic " + "dXNlcjpwYXNzd29yZDEyMw=='",
    "password-assignment": 'login credential password = "Tr0ub4dor&3x"',
    "generic-high-entropy": "secret value q8Zt3LmX0vYb7NcR2wKdE5sJ9fH1gPaU4iO6",
}
BENIGN = [
    "commit 3f786850e387550fdab836ed7e6dc881de23001b fixed it",
    "id 123e4567-e89b-12d3-a456-426614174000",
    "sha256:9f86d081884c7d659a2feaa0c55ad015a3bf4f1b2b0b822cd15d6c15b0f00a08",
    "please change your password every month",
    "the quick brown fox",
]


def detector(threshold=0.5, most=500, pack=PACK):
    return detect.Detector(pack, threshold, most)


def reported(text, **kw):
    d = detector(**kw)
    return [(d.rules[m.order][0].id, m.start, m.end) for m in d.search(text, d.spans(text)).matches]


def test_the_pack():
    assert len(PACK.rules) == 17 and PACK.version == "2026.08.1"
    for r in PACK.rules:
        assert r.hints(), r.id


@pytest.mark.parametrize("rule", sorted(POSITIVE))
def test_positive(rule):
    found = reported(POSITIVE[rule])
    assert [f[0] for f in found] == [rule]


def test_benign():
    assert [reported(t) for t in BENIGN] == [[]] * len(BENIGN)


def test_rules_are_checked():
    good = {"id": "a-b", "description": "d", "severity": "low", "regex": "x+"}
    rules.build(good)
    for change in ({"id": "A"}, {"severity": "none"}, {"regex": "("}, {"regex": "x*"}, {"odd": 1}, {"base_confidence": 2}, {"requires_keyword": True}, {"keywords": ["k", "K"]}, {"entropy_min": float("nan")}, {"flags": ["verbose"]}, {"description": " "}):
        with pytest.raises(rules.RuleError):
            rules.build(good | change)
    for regex in ("(a+)+b", "(?:ab|b)+c", "(x*y?)*z"):
        assert rules.explosive(regex), regex
    for regex in ("(ab)+c", "[ab]+c", "(?:a{2}){3}", "a+b+"):
        assert not rules.explosive(regex), regex
    with pytest.raises(rules.RuleError, match="twice"):
        rules.load("version: '1'\nrules:\n  - {id: a, id: b, description: d, severity: low, regex: x}\n")
    with pytest.raises(rules.RuleError, match="twice"):
        rules.load("version: '1'\nrules:\n  - {id: a, description: d, severity: low, regex: x}\n  - {id: a, description: d, severity: low, regex: y}\n")


def test_gates_and_tallies():
    d = detector()
    text = "x q8Zt3LmX0vYb7NcR2wKdE5sJ9fH1gPaU4iO6 y"
    assert d.search(text, d.spans(text)).dropped["no_keyword"] == 1
    text = "secret " + "a" * 30
    assert d.search(text, d.spans(text)).dropped["low_entropy"] == 1
    text = "pwd: hunter2hunter2"
    strict = detector(threshold=0.9)
    assert strict.search(text, strict.spans(text)).dropped["below_threshold"] == 1


def test_keywords_are_words_within_the_window():
    d = detector()
    rule = rules.Rule("r", "d", "low", "x", keywords=("auth", "key"), keyword_window=5)
    near = lambda text, value: d.near(text, text.index(value), text.index(value) + len(value), rule)
    d.words |= {k: __import__("re").compile(rf"(?<![a-z0-9]){k}(?![a-z0-9])") for k in rule.keywords}
    assert near("api_key = VALUE", "VALUE") == "key"
    assert near("monkey VALUE", "VALUE") is None
    assert near("oauth VALUE", "VALUE") is None
    assert near("auth 12345 VALUE", "VALUE") is None


def test_scores():
    d = detector()
    assert d.score(rules.Rule("r", "d", "low", "x", base_confidence=0.8), 3.0, None) == 0.8
    gated = rules.Rule("r", "d", "low", "x", base_confidence=0.5, entropy_min=4.0)
    assert d.score(gated, 5.8, None) == pytest.approx(0.7)
    worded = rules.Rule("r", "d", "low", "x", base_confidence=0.5, keywords=("k",))
    assert d.score(worded, 1.0, "k") == pytest.approx(0.65) and d.score(worded, 1.0, None) == pytest.approx(0.4)


def test_strongest_of_overlaps_equals_the_plain_way():
    r = random.Random(2)
    for _ in range(300):
        found = [detect.Match(0, s, s + r.randint(1, 9), 0.0, None, r.choice([0.5, 0.6, 0.7])) for s in (r.randint(0, 40) for _ in range(r.randint(0, 14)))]
        kept = []
        for c in sorted(found, key=lambda c: (-c.score, c.start - c.end, c.start)):
            if not any(c.start < k.end and k.start < c.end for k in kept):
                kept.append(c)
        assert detect.strongest(found) == sorted(kept, key=lambda c: c.start)


def test_dense_units_are_cut_to_the_best():
    text = " ".join(f"token gh" + f"p_{i:036d}" for i in range(700)) + f" aws key {AWS}"
    d = detector()
    result = d.search(text, d.spans(text))
    assert result.truncated and len(result.matches) == 500


def test_labels():
    assert redact.label(AWS, "keep_prefix") == AWS[:4] + "…[16 chars redacted]"
    assert redact.label("hunter2", "keep_prefix") == "[7 chars redacted]"
    assert redact.label("x" * 20, "keep_suffix", 4) == "[16 chars redacted]…xxxx"
    assert redact.label("x" * 20) == "[20 chars redacted]"


def test_snippets():
    text = f"before {AWS}   and\nafter"
    assert redact.snippet(text, 7, 27, [], "keep_prefix") == f"before {AWS[:4]}…[16 chars redacted] and after"
    pair = f"{AWS} same as {AWS}"
    assert AWS not in redact.snippet(pair, 0, 20, [])
    cut = "p" * 40 + " SECRETVALUE " + "q" * 45 + "SECRETVALUE"
    line = redact.snippet(cut, 41, 52, [])
    assert "SECRET" not in line and line.endswith("…")
    assert len(redact.snippet("w " * 500 + AWS + " w" * 500, 1000, 1020, [], context=400)) == redact.LONGEST
    with pytest.raises(ValueError):
        redact.snippet("short", 2, 9, [])


def test_no_snippet_shows_a_secret_or_a_part_of_one():
    r = random.Random(9)
    for _ in range(1500):
        secrets = ["".join(r.choice("ab") for _ in range(r.randint(2, 6))) for _ in range(2)]
        text = "".join(r.choice([*secrets, "x", " ", "a", "b", "yy"]) for _ in range(r.randint(1, 25)))
        spans = sorted({(i, i + len(s)) for s in secrets for i in range(len(text)) if text.startswith(s, i)})
        if not spans:
            continue
        target = r.choice(spans)
        try:
            line = redact.snippet(text, *target, [s for s in spans if s != target], context=r.randint(0, 8))
        except redact.LeakError:
            continue
        assert not any(text[a:b] in line for a, b in spans if b - a > 1)


def test_findings_on_spark(spark):
    rows = [("wiki", f"p{i}", None, "body", t) for i, t in enumerate([*POSITIVE.values(), *BENIGN])]
    rows += [("wiki", "null", None, "body", None), ("wiki", "empty", None, "body", ""), rows[0]]
    units = spark.createDataFrame(rows, UNIT)
    found = detect.findings(units, PACK, KEYS, previous=detect.Keys(b"fedcba9876543210")).collect()
    assert sorted(f.rule_id for f in found) == sorted([*POSITIVE, next(iter(POSITIVE))])
    for f in found:
        text = next(t for _, i, _, _, t in rows if i == f.resource_id)
        secret = text[f.start : f.end]
        assert secret not in f.snippet
        assert f.secret_hash == hmac.new(KEYS.pepper, b"sievespark.secret.v1\0" + secret.encode(), hashlib.sha256).hexdigest()
        assert f.previous_secret_hash != f.secret_hash
    tall = detect.tallies(units, PACK).collect()
    assert len(tall) == len(rows) and sum(t.reported for t in tall) == len(found)
    assert detect.findings(units.limit(0), PACK, KEYS).count() == 0


def test_columns_agree_with_python(spark):
    r = random.Random(4)
    texts = ["", "aaaaaaaa", "abcd", AWS, "é𝒳é"] + ["".join(r.choice("abcXYZ012é") for _ in range(r.randint(1, 60))) for _ in range(60)]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = table.select("i", scoring.entropy(F.col("t")).alias("h"), identity.secret_hash(F.col("t"), KEYS.pepper).alias("s"), scoring.mask(F.col("t"), F.lit("keep_suffix"), F.lit(4)).alias("m"), identity.fingerprint(F.lit("c"), F.col("t"), F.lit(None).cast("string"), F.lit("r"), F.lit("h"), KEYS.pepper).alias("f"), scoring.near_keyword(F.lit("oauth my_key VALUE auth"), F.lit(13), F.lit(18), ["auth", "key"], 5).alias("k"), scoring.near_keyword(F.lit("oauth VALUE"), F.lit(6), F.lit(11), ["auth"], 5).alias("n")).collect()
    for x in found:
        t = texts[x.i]
        assert x.h == pytest.approx(detect.entropy(t))
        assert x.s == (KEYS.secret(t) if t else None)
        assert x.f == KEYS.fingerprint("c", t, None, "r", "h")
        assert not t or x.m == redact.label(t, "keep_suffix", 4)
        assert x.k == "auth" and x.n is None
