"""IPv4 addresses as octets, as 32-bit numbers, and prefix-preserving anonymisation."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def octets(ip: Column, strict: bool = False) -> list[Column]:
    """Four INT columns; an unreadable part is 0. ``strict`` gives 0 unless there are exactly 4 parts."""
    parts = F.split(F.trim(ip) if strict else ip, "[.]")
    values = [F.coalesce(F.get(parts, F.lit(i)).try_cast("double").try_cast("int"), F.lit(0)) for i in range(4)]
    if strict:
        values = [F.when(F.size(parts) == 4, v).otherwise(F.lit(0)) for v in values]
    return values


def ip_to_long(ip: Column) -> Column:
    """Unsigned 32-bit value as BIGINT; 0 when the text is not four numbers in 0..255."""
    parts = F.split(ip, "[.]")
    number = [F.get(parts, F.lit(i)).try_cast("long") for i in range(4)]
    valid = F.size(parts) == 4
    for n in number:
        valid = valid & n.between(0, 255)
    a, b, c, d = number
    return F.when(valid, ((a * 256 + b) * 256 + c) * 256 + d).otherwise(F.lit(0)).cast("long")


def long_to_ip(n: Column) -> Column:
    return F.concat_ws(".", *[F.shiftright(n, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])


def seed_key(seed: int) -> bytes:
    """Deterministic key from a seed."""
    return hashlib.sha256(str(seed).encode()).digest()


def pad_key(key: bytes) -> bytes:
    """Exactly 32 bytes: cut, or filled with zero bytes."""
    return key[:32].ljust(32, b"\0")


def key_digest(key: bytes) -> str:
    return hashlib.sha256(key).hexdigest()


def anonymize_long(column: str, key: bytes) -> Column:
    """Prefix-preserving permutation of the 32-bit value in ``column``.

    Output bit i is input bit i XOR bit i of SHA-256(key || the i bits before it,
    as a 32-bit number), so two addresses share exactly the prefix they shared before.
    """
    prefix = f"shiftleft(shiftright(`{column}`, 32 - i), 32 - i)"
    digest = f"sha2(concat(X'{pad_key(key).hex()}', unhex(lpad(hex({prefix}), 8, '0'))), 256)"
    # Only the hex digit that holds bit i of the digest is read.
    mask = f"shiftright(instr('0123456789abcdef', substr({digest}, i div 4 + 1, 1)) - 1, 3 - i % 4)"
    return F.expr(
        "aggregate(sequence(0, 31), 0L, (acc, i) -> acc + "
        f"shiftleft((shiftright(`{column}`, 31 - i) ^ cast({mask} as bigint)) & 1L, 31 - i))"
    )
