"""Seeds and reproducible pseudo-random numbers taken from keys."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def named_seed(name: str, seed: int) -> int:
    """A 32-bit seed for one named purpose: leading four bytes of SHA-256 of ``name:seed``."""
    return int.from_bytes(hashlib.sha256(f"{name}:{seed}".encode()).digest()[:4], "big")


def named_seed_column(name: Column, seed: int) -> Column:
    digest = F.sha2(F.concat(name, F.lit(f":{seed}")), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def shuffle_key(key: Column, seed: int) -> Column:
    """Hex digits that order rows at random but the same way on every run."""
    return F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) from a key: 48 bits of its shuffle key."""
    bits = F.conv(F.substring(shuffle_key(key, seed), 1, 12), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(float(16**12))
