"""Seeded hashing: randomness that depends on a row's key, not its place."""

from pyspark.sql import Column, functions as F


def order_hash(key: Column, seed: int) -> Column:
    """32 hex digits; sorting by them shuffles rows reproducibly."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def hash_uniform(key: Column, seed: int) -> Column:
    """Uniform number in [0, 1) from the first 32 bits of the seeded hash."""
    head = F.substring(order_hash(key, seed), 1, 8)
    return F.conv(head, 16, 10).cast("bigint") / F.lit(4294967296.0)
