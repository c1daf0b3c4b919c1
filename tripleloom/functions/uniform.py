"""Randomness from hashes: the same numbers in any engine, order and partitioning."""

from __future__ import annotations

from pyspark.sql import functions as F


def uniform(seed: int, *keys: F.Column | str) -> F.Column:
    """In (0, 1), from md5 of the seed and the keys joined by colons (names are columns)."""
    parts = [F.lit(str(seed)), *((F.col(k) if isinstance(k, str) else k).cast("string") for k in keys)]
    return (F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)


def normal(seed: int, *keys: F.Column | str) -> F.Column:
    """Standard normal, from two uniforms by Box and Muller."""
    return F.sqrt(-2 * F.log(uniform(seed, *keys, F.lit("a")))) * F.cos(2 * F.pi() * uniform(seed, *keys, F.lit("b")))


def uniform_sql(seed: int | str, key: str) -> str:
    """The same uniform in SQL; ``key`` is an expression of text."""
    return f"((('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT + 0.5) / 4294967296.0)"
