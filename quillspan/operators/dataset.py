"""A small dataset API over DataFrames: bags of strings and of pairs.

Everything is lazy; nothing runs before an action. Where a function is a Column expression the plan
stays in the JVM; with ``python=True`` it is an opaque Python function of strings, called in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ColumnFunction = Callable[..., Column]


def _each(df: DataFrame, array: Column) -> DataFrame:
    """Non-null elements. The outer form keeps the optimizer from making the array twice (for its size)."""
    return df.select(F.explode_outer(array).alias("value")).where("value is not null")


def _each_pair(df: DataFrame, array: Column) -> DataFrame:
    return df.select(F.inline_outer(array)).toDF("k", "v").where("k is not null or v is not null")


def _python(df: DataFrame, f: Callable[..., Iterable], schema: str) -> DataFrame:
    """What ``f`` gives for each row's columns, in Arrow batches: strings, or tuples of strings."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [x for row in zip(*(c.to_pylist() for c in b.columns), strict=True) for x in f(*row) or ()]
            columns = [out] if len(names) == 1 else list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=names)

    return df.mapInArrow(run, schema)


def _folded(df: DataFrame, values: Column, zero: str, f: Callable[[str, str], str], keys: list[str]) -> DataFrame:
    """A left fold by an opaque function over collected values (``zero`` once), in Arrow batches."""
    fold = F.pandas_udf(lambda lists: lists.map(lambda x: reduce(f, x, zero)), "string")
    return df.groupBy(*keys).agg(values.alias("__all")).select(*keys, fold("__all").alias("v"))


class Destroyed(RuntimeError):
    """The dataset was destroyed."""


class _Held:
    def __init__(self, engine: Engine, df: DataFrame) -> None:
        self.engine, self._df = engine, df

    @property
    def df(self) -> DataFrame:
        if self._df is None:
            raise Destroyed("this dataset was destroyed")
        return self._df

    def destroy(self) -> None:
        """Later use raises."""
        self.df.unpersist()
        self._df = None

    def count(self) -> int:
        """Elements, repeated ones included."""
        return self.df.count()

    def save_as_table(self, name: str) -> None:
        """A new table; an existing one is an error. Empty datasets give empty tables."""
        self.df.write.mode("errorifexists").saveAsTable(name)


class Engine:
    """Entry point: makes datasets and gathers a job's output."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self._said = spark, []

    def parallelize(self, values: Iterable[str]) -> Bag:
        return Bag(self, self.spark.createDataFrame([(v,) for v in values], "value string"))

    def from_table(self, table: DataFrame | str, value: Column) -> Bag:
        """``value`` of each row; rows for which it is null are left out."""
        df = self.spark.table(table) if isinstance(table, str) else table
        return Bag(self, df.select(value.cast("string").alias("value")).where("value is not null"))

    def pairs(self, df: DataFrame, key: Column, value: Column) -> Pairs:
        return Pairs(self, df.select(key.cast("string").alias("k"), value.cast("string").alias("v")))

    def output(self, text: str) -> None:
        self._said.append(text)

    @property
    def said(self) -> str:
        return "".join(self._said) or "<no output>"


class Bag(_Held):
    """A bag of strings: column ``value``."""

    def flat_map(self, f: ColumnFunction | Callable[[str], Iterable[str] | None], python: bool = False) -> Bag:
        """``f`` gives an array of strings per element; null and empty arrays give nothing."""
        if python:
            return Bag(self.engine, _python(self.df, f, "value string").where("value is not null"))
        return Bag(self.engine, _each(self.df, f(F.col("value"))))

    def flat_map_to_pair(self, f: Callable, python: bool = False) -> Pairs:
        """``f`` gives an array of (k, v) structs per element."""
        if python:
            return Pairs(self.engine, _python(self.df, f, "k string, v string"))
        return Pairs(self.engine, _each_pair(self.df, f(F.col("value"))))

    def map_to_pair(self, key: ColumnFunction, value: ColumnFunction, python: bool = False) -> Pairs:
        """At most one pair per element: none where the key is null."""
        if python:
            return Pairs(self.engine, _python(self.df, lambda v: [(key(v), value(v))], "k string, v string").where("k is not null"))
        return Pairs(self.engine, self.df.select(key(F.col("value")).alias("k"), value(F.col("value")).alias("v")).where("k is not null"))

    def filter(self, predicate: ColumnFunction | Callable[[str], bool], python: bool = False) -> Bag:
        if python:
            return Bag(self.engine, _python(self.df, lambda v: [v] if predicate(v) else [], "value string"))
        return Bag(self.engine, self.df.where(predicate(F.col("value"))))

    def map_partitions(self, f: Callable[[Iterator[str]], Iterable[str]]) -> Bag:
        """``f`` sees each partition's elements once."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            chunk: list[str] = []
            for x in f(v for frame in frames for v in frame["value"]):
                chunk.append(x)
                if len(chunk) >= 10_000:
                    yield pd.DataFrame({"value": chunk})
                    chunk = []
            yield pd.DataFrame({"value": pd.Series(chunk, dtype="object")})

        return Bag(self.engine, self.df.mapInPandas(run, "value string"))

    def sample(self, fraction: float, seed: int = 0) -> Bag:
        """Each element with this probability, without replacement."""
        return Bag(self.engine, self.df.sample(False, fraction, seed))

    def distinct(self) -> Bag:
        return Bag(self.engine, self.df.distinct())

    def intersection(self, other: Bag) -> Bag:
        """Elements of both, once each."""
        return Bag(self.engine, self.df.intersect(other.df))

    def union(self, other: Bag) -> Bag:
        return Bag(self.engine, self.df.unionByName(other.df))

    def group_by(self, key: ColumnFunction | Callable[[str], str], python: bool = False) -> Pairs:
        """(key, its elements in order, joined by commas)."""
        if python:
            pairs = self.map_to_pair(key, lambda v: v, python=True).df
            return Pairs(self.engine, pairs.groupBy("k").agg(F.array_join(F.array_sort(F.collect_list("v")), ",").alias("v")))
        grouped = self.df.groupBy(key(F.col("value")).alias("k")).agg(F.array_join(F.array_sort(F.collect_list("value")), ",").alias("v"))
        return Pairs(self.engine, grouped)

    def fold(self, zero: Column | str, f: Callable, python: bool = False) -> DataFrame:
        """One row ``value``: a left fold over the elements in order, ``zero`` used once.

        For aggregates that merge (sums, counts, extremes) use ``aggregate``: a fold needs all elements.
        """
        if python:
            return _folded(self.df, F.array_sort(F.collect_list("value")), zero, f, []).withColumnRenamed("v", "value")
        return self.df.agg(F.aggregate(F.array_sort(F.collect_list("value")), zero, f).alias("value"))

    def aggregate(self, expression: Column) -> DataFrame:
        """One row ``value`` from a mergeable aggregate, partial per task."""
        return self.df.agg(expression.alias("value"))

    def take(self, n: int) -> list[str]:
        """The n least elements, so that a repeated call gives the same."""
        return [r[0] for r in self.df.orderBy("value").limit(n).collect()]

    def collect(self) -> list[str]:
        return [r[0] for r in self.df.collect()]


class Pairs(_Held):
    """A bag of (k, v) strings."""

    def flat_map(self, f: Callable, python: bool = False) -> Bag:
        if python:
            return Bag(self.engine, _python(self.df.select("k", "v"), f, "value string").where("value is not null"))
        return Bag(self.engine, _each(self.df, f(F.col("k"), F.col("v"))))

    def flat_map_to_pair(self, f: Callable, python: bool = False) -> Pairs:
        if python:
            return Pairs(self.engine, _python(self.df.select("k", "v"), f, "k string, v string"))
        return Pairs(self.engine, _each_pair(self.df, f(F.col("k"), F.col("v"))))

    def fold_by_key(self, zero: Column | str, f: Callable, python: bool = False) -> Pairs:
        """A left fold over each key's values in order, ``zero`` once per key. Holds a key's values at once."""
        if python:
            return Pairs(self.engine, _folded(self.df, F.array_sort(F.collect_list("v")), zero, f, ["k"]))
        return Pairs(self.engine, self.df.groupBy("k").agg(F.aggregate(F.array_sort(F.collect_list("v")), zero, f).alias("v")))

    def aggregate_by_key(self, expression: Column) -> Pairs:
        """A mergeable aggregate over each key's values, partial per task before the shuffle."""
        return Pairs(self.engine, self.df.groupBy("k").agg(expression.alias("v")))

    def join(self, other: Pairs) -> Pairs:
        """For each key, each left value with each right value, joined by a comma."""
        both = self.df.join(other.df.withColumnRenamed("v", "w"), "k")
        return Pairs(self.engine, both.select("k", F.concat_ws(",", "v", "w").alias("v")))

    def cogroup(self, other: Pairs) -> Pairs:
        """For each key of either, ``[left values],[right values]``, each in order; a missing side is ``[]``."""
        side = lambda p, n: p.df.groupBy("k").agg(F.array_join(F.array_sort(F.collect_list("v")), ",").alias(n))
        both = side(self, "l").join(side(other, "r"), "k", "full_outer")
        text = lambda c: F.concat(F.lit("["), F.coalesce(c, F.lit("")), F.lit("]"))
        return Pairs(self.engine, both.select("k", F.concat(text(F.col("l")), F.lit(","), text(F.col("r"))).alias("v")))

    def collect(self) -> list[tuple[str, str]]:
        return [(r["k"], r["v"]) for r in self.df.collect()]

    def shown(self) -> DataFrame:
        """``(k,v)`` texts, in order."""
        return self.df.orderBy("k", "v").select(F.format_string("(%s,%s)", "k", "v").alias("value"))
