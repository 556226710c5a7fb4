"""The row-file format: ``key SP (column SP length SP bytes SP)* LF``.

Values are length-prefixed, so they may hold blanks and line feeds. A record is complete once its
line feed is read; whatever breaks off before it is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def parse_rows(body: bytes) -> Iterator[tuple[int, int, bytes, dict[bytes, bytes]]]:
    """(start, end, key, columns) of each complete record of ``body``.

    Stops at the first record that breaks off or is malformed: behind it no record boundary is
    certain. Empty lines between records are skipped. A column named twice keeps its last value.
    """
    at, size = 0, len(body)
    while at < size:
        if body[at] == 10:
            at += 1
            continue
        start = at
        blank = body.find(b" ", at)
        if blank < 0:
            return
        key, cols, at = body[start:blank], {}, blank + 1
        while True:
            if at >= size:
                return
            if body[at] == 10:
                at += 1
                break
            blank = body.find(b" ", at)
            if blank < 0:
                return
            name = body[at:blank]
            end = body.find(b" ", blank + 1, blank + 22)
            number = body[blank + 1 : end] if end > 0 else b""
            if not number.isdigit():
                return
            value_at = end + 1
            at = value_at + int(number)
            if at >= size or body[at] != 32:
                return
            cols[name] = body[value_at:at]
            at += 1
        yield start, at, key, cols


def format_row(key: bytes, cols: dict[bytes, bytes]) -> bytes:
    """One record in the row-file format."""
    return key + b" " + b"".join(c + b" " + str(len(v)).encode() + b" " + v + b" " for c, v in cols.items()) + b"\n"


def read_rows(df: DataFrame, body: str = "body", keep: list[str] | None = None) -> DataFrame:
    """One row (kept columns, ``key`` STRING, ``cols`` MAP<STRING, BINARY>) per complete record.

    A null or empty body gives no row. Bytes of keys and names that are not UTF-8 are replaced.
    Kept columns named ``key`` or ``cols`` are replaced by the record's.
    """
    kept = [c for c in (keep if keep is not None else df.columns) if c not in ("key", "cols", body)]
    fields = [df.schema[c] for c in kept]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "key string", "cols map<string, binary>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            index, keys, cols = [], [], []
            for i, x in enumerate(b.column(0).to_pylist()):
                for _, _, k, c in parse_rows(x or b""):
                    index.append(i)
                    keys.append(k.decode("utf-8", "replace"))
                    cols.append([(n.decode("utf-8", "replace"), v) for n, v in c.items()])
            taken = pa.table([b.column(j + 1) for j in range(len(kept))], names=kept).take(pa.array(index, pa.int64())).combine_chunks() if kept else None
            arrays = [taken.column(j).combine_chunks() if taken.num_rows else pa.array([], b.column(j + 1).type) for j in range(len(kept))] if kept else []
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(keys, pa.string()), pa.array(cols, pa.map_(pa.string(), pa.binary()))], names=[*kept, "key", "cols"])

    return df.select(body, *kept).mapInArrow(run, schema)


def read_row_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, key, cols) of the complete records of all row files under ``path``."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return read_rows(files, "content", ["path"])


def to_pandas_rows(body: bytes) -> pd.DataFrame:
    """A small file's records as a frame (for a look at single files)."""
    return pd.DataFrame([{"key": k.decode("utf-8", "replace"), **{n.decode(): v for n, v in c.items()}} for _, _, k, c in parse_rows(body)])
