"""Keyed digests in built-in expressions: HMAC (RFC 2104) over SHA-256, and tokens made of it."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

PAD = 64  # bytes of a block of SHA-256


def hmac_sha256(message: Column, key: bytes) -> Column:
    """The digest in lower-case hex digits; null for a null message. The key's pads are constants of the plan."""
    block = (hashlib.sha256(key).digest() if len(key) > PAD else key).ljust(PAD, b"\0")
    pad = lambda x: F.lit(bytearray(b ^ x for b in block))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), message.cast("binary")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def token(kind: Column, value: Column, key: bytes, digits: int = 16) -> Column:
    """QG_KIND_ and digits of the value's digest: the same value always has the same token."""
    return labelled(F.upper(kind), value, key, digits)


def labelled(name: Column, value: Column, key: bytes, digits: int = 16) -> Column:
    """As token, of a kind that is in capitals: where a row has many values, capitals by ICU cost more than the digest."""
    return F.concat(F.lit("QG_"), name, F.lit("_"), F.substring(hmac_sha256(value, key), 1, digits))


#: Tokens have sixteen digits; older ones have eight.
TOKEN = r"QG_[A-Z]{1,12}_[0-9a-f]{8}(?:[0-9a-f]{8})?"
