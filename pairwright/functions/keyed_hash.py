"""HMAC-SHA256 and seeded orders as expressions: no UDF, the same digests on any engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Lower-case hex digest. The two padded keys are constants of the plan."""
    block = key.ljust(64, b"\0") if len(key) <= 64 else __import__("hashlib").sha256(key).digest().ljust(64, b"\0")
    inner = F.lit(bytes(b ^ 0x36 for b in block))
    outer = F.lit(bytes(b ^ 0x5C for b in block))
    first = F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(outer, first), 256)


def seeded_digest(seed_hex: str, contract: str, role: str, stage: str, cell: Column, unit: Column) -> Column:
    """Digest of the compact JSON array [contract, role, stage, cell, unit] under the seed."""
    key = bytes.fromhex(seed_hex)
    if len(key) != 32:
        raise ValueError("the seed must be exactly 32 bytes")
    message = F.to_json(F.array(F.lit(contract), F.lit(role), F.lit(stage), cell.cast("string"), unit.cast("string")))
    return hmac_sha256(key, message)


def hash_order(seed: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(seed), *[p.cast("string") for p in parts]), 256)


def hash_index(seed: str, n: Column | int, *parts: Column) -> Column:
    """A number in 0..n-1 from the first 8 hex digits."""
    return F.conv(F.substring(hash_order(seed, *parts), 1, 8), 16, 10).cast("bigint") % n


#: DuckDB text of the same, for a key of zero bytes.
def hmac_sql(message: str, key: bytes = bytes(32)) -> str:
    block = key.ljust(64, b"\0")
    hexed = lambda x: "unhex('" + bytes(b ^ x for b in block).hex() + "')"
    return f"sha256({hexed(0x5C)} || unhex(sha256({hexed(0x36)} || encode({message}))))"
