"""Keyed hashes that identify secrets and findings, as column expressions.

HMAC-SHA-256 is built from ``sha2`` with the two padded keys as constants, so it stays in generated code. A key
given to these builders stands in the plan: use :func:`sievespark.operators.detect.findings`, whose tasks hold
the key outside the plan, where plans are logged.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefix of the domains that keep hashes of different purposes apart; give your own to match existing hashes.
DOMAIN = "sievespark"
LEAST_PEPPER, LEAST_CORRELATION_KEY = 16, 32
_BLOCK = 64


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Lower-case hex HMAC-SHA-256 of a binary column."""
    import hashlib

    key = hashlib.sha256(key).digest() if len(key) > _BLOCK else key
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in key.ljust(_BLOCK, b"\0")).hex()))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), message), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def _domain(purpose: str, domain: str) -> Column:
    return F.unhex(F.lit(f"{domain}.{purpose}.v1".encode().hex() + "00"))


def secret_hash(secret: Column, pepper: bytes, domain: str = DOMAIN) -> Column:
    """Hash of a secret's UTF-8; null for an empty or null one."""
    if len(pepper) < LEAST_PEPPER:
        raise ValueError(f"a pepper has at least {LEAST_PEPPER} bytes")
    return F.when(F.length(secret) > 0, hmac_sha256(pepper, F.concat(_domain("secret", domain), secret.cast("binary"))))


def canonical(*parts: Column) -> Column:
    """Each part as ``<bytes>:<part>|``, so that no separator in a part can shift a border; null counts as empty.

    Parts should be in Unicode's normal form C already (see :func:`nfc`).
    """
    pieces = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.concat(*[F.concat(F.octet_length(p).cast("string"), F.lit(":"), p, F.lit("|")) for p in pieces]).cast("binary")


def fingerprint(connector: Column, resource: Column, sub_resource: Column, rule: Column, secret: Column, pepper: bytes, domain: str = DOMAIN) -> Column:
    """Identity of a finding from its place, rule and secret hash; offsets are no part of it."""
    if len(pepper) < LEAST_PEPPER:
        raise ValueError(f"a pepper has at least {LEAST_PEPPER} bytes")
    return hmac_sha256(pepper, F.concat(_domain("fingerprint", domain), canonical(connector, resource, sub_resource, rule, secret)))


def correlation_id(secret: Column, key: bytes, domain: str = DOMAIN) -> Column:
    """Links findings of one secret across places; null unless the secret hash has 16 to 64 characters."""
    if len(key) < LEAST_CORRELATION_KEY:
        raise ValueError(f"a correlation key has at least {LEAST_CORRELATION_KEY} bytes")
    return F.when(F.length(secret).between(16, 64), hmac_sha256(key, F.concat(_domain("correlation", domain), secret.cast("binary"))))


def gap_reference(kind: Column, locator: Column, pepper: bytes, domain: str = DOMAIN) -> Column:
    """Opaque name of an unread object: its kind and its locator map as JSON with sorted keys."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries(locator)))
    message = F.concat(kind.cast("binary"), F.unhex(F.lit("00")), F.to_json(ordered).cast("binary"))
    return hmac_sha256(pepper, F.concat(_domain("gap", domain), message))


def locator(display: Column, connector: Column, resource: Column, sub_resource: Column, offset: Column) -> Column:
    """Display fields with the identifying ones and the offset on top; identifying fields win."""
    fixed = F.map_from_arrays(F.array(F.lit("connector_type"), F.lit("resource_id"), F.lit("sub_resource"), F.lit("offset")), F.array(connector, resource, sub_resource, offset.cast("string")))
    fixed = F.map_filter(fixed, lambda k, v: v.isNotNull())
    shown = F.coalesce(display, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(shown, lambda k, v: ~F.map_contains_key(fixed, k)), fixed)


def nfc(text: str) -> str:
    import unicodedata

    return unicodedata.normalize("NFC", text)
