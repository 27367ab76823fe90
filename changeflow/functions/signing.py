"""HMAC-SHA256 body signatures."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from changeflow.functions import text as T

BLOCK = 64
INNER, OUTER = 0x36, 0x5C
MAX_SKEW_SECONDS = 300


def _pads(secret: str) -> tuple[bytes, bytes]:
    key = secret.encode()
    if len(key) > BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(BLOCK, b"\0")
    return bytes(b ^ INNER for b in key), bytes(b ^ OUTER for b in key)


def sign_payload(secret: str, timestamp: Column, body: Column) -> Column:
    """sha256=HMAC of `timestamp.body`.

    The pads are as good as the key and show in explain(); where plans are logged, sign in the
    delivery transport instead, which reads the secret on the worker.
    """
    inner, outer = _pads(secret)
    message = F.encode(F.concat(timestamp, F.lit("."), body), "UTF-8")
    digest = F.sha2(F.concat(F.lit(bytearray(inner)), message), 256)
    return F.concat(F.lit("sha256="), F.sha2(F.concat(F.lit(bytearray(outer)), F.unhex(digest)), 256))


def verify_signature(secret: str, timestamp: Column, body: Column, signature: Column, received_at: Column) -> Column:
    """False when a header is missing or unreadable, the skew is over five minutes, or the digest differs."""
    signed_at = T.parse_time(timestamp)
    skew = F.abs(F.unix_micros(received_at) - F.unix_micros(signed_at))
    fresh = skew <= MAX_SKEW_SECONDS * 1_000_000
    return F.coalesce(fresh & (signature == sign_payload(secret, timestamp, body)), F.lit(False))
