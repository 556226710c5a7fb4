"""Aggregation per key when a few keys hold most rows.

Two stages: rows of heavy keys get a salt and are aggregated per (key, salt); the partial results
are merged per key. Which keys are heavy comes from a mergeable frequency sketch over all rows,
whose size does not depend on the data.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Mergeable:
    """An aggregate in two stages: ``partial`` over rows, ``merge`` over partial results."""

    partial: Callable[[], Column]
    merge: Callable[[Column], Column]


def count_rows() -> Mergeable:
    return Mergeable(lambda: F.count(F.lit(1)), F.sum)


def sum_of(c: str) -> Mergeable:
    return Mergeable(lambda: F.sum(c), F.sum)


def min_of(c: str) -> Mergeable:
    return Mergeable(lambda: F.min(c), F.min)


def max_of(c: str) -> Mergeable:
    return Mergeable(lambda: F.max(c), F.max)


def distinct_sketch(c: str) -> Mergeable:
    """A sketch of the distinct values; read it with ``hll_sketch_estimate``."""
    return Mergeable(lambda: F.hll_sketch_agg(c), F.hll_union_agg)


def heavy_keys(df: DataFrame, keys: list[str], share: float = 0.01, tracked: int = 10_000) -> list[int]:
    """xxhash64 of each key that holds at least ``share`` of the rows, from one pass over all rows.

    The sketch tracks ``tracked`` keys; a key above ``share`` is never missed while
    ``tracked > 4 / share``. At most ``1.5 / share + 1`` hashes return.
    """
    most = int(1.5 / share) + 1
    tracked = max(tracked, int(8 / share))
    hashed = df.select(F.xxhash64(*[F.col(f"`{k}`") for k in keys]).alias("h"))
    got = hashed.agg(F.expr(f"approx_top_k(h, {most}, {tracked})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    if not got["n"]:
        return []
    return [r["item"] for r in got["top"] if r["count"] >= share * got["n"] and r["item"] is not None]


def salted_aggregate(df: DataFrame, keys: list[str], aggs: dict[str, Mergeable], salt_by: list[str], *, salts: int = 64, share: float = 0.01, heavy: list[int] | None = None) -> DataFrame:
    """``df`` aggregated per ``keys`` without an imbalance from heavy keys.

    ``salt_by`` names columns that tell apart the rows of one key; the salt is their hash, so a
    repeated task gives the same salts. Null keys form a group of their own, as in ``groupBy``.
    Empty input gives an empty result. Columns not named are ignored.
    """
    if heavy is None:
        heavy = heavy_keys(df, keys, share)
    key_cols = [F.col(f"`{k}`") for k in keys]
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in salt_by]), F.lit(salts)).cast("int") if salt_by else F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")
    is_heavy = F.xxhash64(*key_cols).isin(heavy) if heavy else F.lit(False)
    partial = df.withColumn("__salt", F.when(is_heavy, salt).otherwise(F.lit(0))).groupBy(*key_cols, F.col("__salt")).agg(*[a.partial().alias(n) for n, a in aggs.items()])
    return partial.groupBy(*key_cols).agg(*[a.merge(F.col(f"`{n}`")).alias(n) for n, a in aggs.items()])
