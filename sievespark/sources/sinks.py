"""What leaves: deterministic JSON exports, signed requests, counts of what a query saw."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

TOLERANCE_SECONDS = 300


def export(rows: DataFrame, path: str, order: list[str], most: int) -> int:
    """Write rows as JSON lines in a fixed order of rows and keys; more than ``most`` rows are refused, not cut."""
    few = rows.limit(most + 1)
    n = few.count()
    if n > most:
        raise ValueError(f"an export has at most {most} rows")
    names = sorted(rows.columns)
    few.orderBy(*order).coalesce(1).select(F.to_json(F.struct(*names), {"ignoreNullFields": "false"})).write.text(path)
    return n


def signature(body: bytes, at: int, key: bytes) -> str:
    """Signature of a request's raw body at a time."""
    return hmac.new(key, str(at).encode() + b"." + body, hashlib.sha256).hexdigest()


def signed(body: Column, at: Column, sent: Column, received_at: Column, key: bytes) -> Column:
    """True where a callback's signature is right and its time within five minutes of its arrival."""
    from ..functions.identity import hmac_sha256

    message = F.concat(at.cast("string"), F.lit("."), body).cast("binary")
    return (hmac_sha256(key, message) == sent) & (F.abs(received_at - at) <= TOLERANCE_SECONDS)


def observed(rows: DataFrame, name: str, *counts: Column) -> tuple[DataFrame, Observation]:
    """``rows`` with counts taken on the way through, without a second pass."""
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *counts), seen
