"""Joins of many rows with a table of few rows per key, safe for hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A side is broadcast only if it has at most this many rows (some ten MB).
BROADCAST_ROWS = 100_000


def join_small(rows: DataFrame, small: DataFrame, on: list[str], how: str = "inner", spread: list[str] | None = None, *, limit: int = BROADCAST_ROWS, copies: int = 16) -> DataFrame:
    """``rows`` joined with ``small`` without gathering a hot key's rows in one task.

    ``small`` is counted: up to ``limit`` rows are broadcast. Beyond it, ``rows`` are spread over
    ``copies`` salts by the hash of their ``spread`` columns and ``small`` is repeated for each salt.
    ``how`` is inner, left, left_semi or left_anti.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(how)
    if small.limit(limit + 1).count() <= limit:
        return rows.join(F.broadcast(small), on, how)
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in (spread or rows.columns)]), F.lit(copies)).cast("int")
    repeated = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return rows.withColumn("__salt", salt).join(repeated, [*on, "__salt"], how).drop("__salt")
