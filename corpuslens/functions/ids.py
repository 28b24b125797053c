"""Content-addressed identifiers and seeded orders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(*parts: Column | str, sep: str) -> Column:
    return F.concat_ws(sep, *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts))


def stable_id(prefix: str, *parts: Column | str, length: int = 16, sep: str = ":") -> Column:
    """``prefix`` and the first hex digits of the SHA-256 of the joined parts."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(_text(*parts, sep=sep), 256), 1, length))


def seeded_rank(seed: int | str, *parts: Column | str) -> Column:
    """An order key that looks random, depends on the seed and the parts only, and never ties for different parts."""
    return F.sha2(_text(F.lit(str(seed)), *parts, sep=":"), 256)


def hash_half(*parts: Column | str) -> Column:
    """0 or 1: parity of the 16th hex digit of the parts' SHA-256."""
    return F.conv(F.substring(F.sha2(_text(*parts, sep=":"), 256), 16, 1), 16, 10).cast("int") % 2
