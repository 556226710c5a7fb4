"""Named keyed tables in one folder: scans by key range, lookups, puts, renames, pages."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.operators.upsert import put_rows
from quillspan.session import hadoop_fs, remove_path


class TableStore:
    """Each table is a Parquet folder with a ``key`` column, written range-partitioned and sorted by key,
    so that key ranges and points skip row groups by their statistics. A missing table reads as empty
    where a schema is given, and counts 0."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str) -> str:
        if not name or "/" in name or name.startswith((".", "_")):
            raise ValueError(f"no table name: {name!r}")
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        fs, p = hadoop_fs(self.spark, self._path(name))
        old = hadoop_fs(self.spark, f"{self.root}/_old-{name}")[1]
        if not fs.exists(p) and fs.exists(old):
            fs.rename(old, p)
        return fs.exists(p)

    def tables(self) -> list[str]:
        fs, p = hadoop_fs(self.spark, self.root)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if not s.getPath().getName().startswith((".", "_"))) if fs.exists(p) else []

    def write(self, name: str, df: DataFrame, replace: bool = False) -> None:
        """The table appears whole, by a rename. An existing one is an error unless replaced; it is set aside until the
        new one stands, and a replacement that broke off between the two is mended by the next use."""
        if self.exists(name) and not replace:
            raise FileExistsError(name)
        stage, aside = f"{self.root}/_{uuid.uuid4().hex}", f"{self.root}/_old-{name}"
        df.repartitionByRange("key").sortWithinPartitions("key").write.parquet(stage)
        fs, to = hadoop_fs(self.spark, self._path(name))
        old = hadoop_fs(self.spark, aside)[1]
        if fs.exists(to):
            fs.delete(old, True)
            if not fs.rename(to, old):
                raise OSError(f"could not set {name} aside")
        if not fs.rename(hadoop_fs(self.spark, stage)[1], to):
            raise OSError(f"could not publish {name}")
        fs.delete(old, True)

    def read(self, name: str, schema: str | None = None) -> DataFrame:
        if not self.exists(name) and schema:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(self._path(name))

    def scan(self, name: str, start: str | None = None, end: str | None = None, schema: str | None = None) -> DataFrame:
        """Rows with start <= key < end, ordered by key."""
        df = self.read(name, schema)
        if start is not None:
            df = df.where(F.col("key") >= start)
        if end is not None:
            df = df.where(F.col("key") < end)
        return df.orderBy("key")

    def get_row(self, name: str, key: str):
        """The row, or None."""
        return self.read(name).where(F.col("key") == key).first() if self.exists(name) else None

    def get(self, name: str, key: str, column: str):
        """The cell, or None."""
        row = self.read(name).where(F.col("key") == key).select(column).first() if self.exists(name) else None
        return row[0] if row else None

    def having(self, name: str, keys: DataFrame) -> DataFrame:
        """Those of ``keys`` (key) that have a row."""
        return keys.join(self.read(name, "key string").select("key"), "key", "left_semi")

    def count(self, name: str) -> int:
        return self.read(name).count() if self.exists(name) else 0

    def put_rows(self, name: str, rows: DataFrame) -> None:
        """Whole-row upsert."""
        old = self.read(name) if self.exists(name) else rows.limit(0)
        self.write(name, put_rows(old, rows, "key"), replace=True)

    def rename(self, old: str, new: str) -> bool:
        """False if there is no such table or the new name is taken."""
        if not self.exists(old) or self.exists(new):
            return False
        fs, p = hadoop_fs(self.spark, self._path(old))
        return bool(fs.rename(p, hadoop_fs(self.spark, self._path(new))[1]))

    def delete(self, name: str) -> bool:
        if not self.exists(name):
            return False
        remove_path(self.spark, self._path(name))
        return True

    def page(self, name: str, start: str | None = None, size: int = 10) -> tuple[list, str | None]:
        """Up to ``size`` rows from key ``start`` on, in order, and the key of the next page."""
        got = self.scan(name, start).limit(size + 1).collect()
        return got[:size], got[size]["key"] if len(got) > size else None

    def overview(self) -> list[tuple[str, int]]:
        """Each table and its rows, counted in one job from the files' footers."""
        names = self.tables()
        if not names:
            return []
        counts = [self.read(t).select(F.lit(t).alias("t")) for t in names]
        held = {r["t"]: r["count"] for r in reduce(lambda a, b: a.unionByName(b), counts).groupBy("t").count().collect()}
        return [(t, held.get(t, 0)) for t in names]
