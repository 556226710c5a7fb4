"""Mutation of keyed tables as batch merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType


def newest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the last by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def put_cells(old: DataFrame, new: DataFrame) -> DataFrame:
    """Cells (key, column, value) after the puts (key, column, value, seq); the put with the highest seq wins."""
    both = old.select("key", "column", "value", F.lit(None).cast("long").alias("seq")).unionByName(new.select("key", "column", "value", F.col("seq").cast("long")))
    return both.groupBy("key", "column").agg(F.max_by("value", F.struct(F.coalesce("seq", F.lit(-(1 << 62))), F.col("seq").isNotNull())).alias("value"))


def put_rows(old: DataFrame, new: DataFrame, key: str, order: list[Column] | None = None) -> DataFrame:
    """Rows of ``old`` whose key is not in ``new``, and ``new`` (whole-row replacement).

    Of a key put several times the last row by ``order`` (by default by its columns) counts.
    """
    last = newest(new, [key], order or [F.col(f"`{c}`").desc_nulls_last() for c in new.columns if c != key and not isinstance(new.schema[c].dataType, MapType)] or [F.lit(1)])
    return old.join(new.select(key), key, "left_anti").unionByName(last)


def compare_and_set(old: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """``old`` with ``column`` set where a change (key, expected, value[, seq]) finds the value it expects.

    Adds ``applied``: null without a change, false where the value is missing or another. Of several changes
    of a key the one with the highest seq counts, else the greatest by its values.
    """
    order = F.struct(*([F.col("seq")] if "seq" in changes.columns else []), "expected", "value")
    last = changes.groupBy(key).agg(F.max_by(F.struct("expected", "value"), order).alias("__c")).select(key, F.col("__c.expected").alias("expected"), F.col("__c.value").alias("__new"))
    found = old.join(last, key, "left")
    hit = F.col("expected").isNotNull() & F.coalesce(F.col(column) == F.col("expected"), F.lit(False))
    return found.withColumn("applied", F.when(F.col("expected").isNotNull(), hit)).withColumn(column, F.when(hit, F.col("__new")).otherwise(F.col(column))).drop("expected", "__new")
