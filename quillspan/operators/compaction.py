"""Many tiny files into few well-sized ones, each complete record exactly once.

1. A manifest of the files (id, bytes) is listed and frozen in the shared folder; both passes keep to it.
2. The records are listed by place (file, offset), size and checksum; of a record that lies in several
   files one place is kept. This pass moves no page text.
3. The files of the manifest are packed by the bytes kept of each: by falling size, first-fit decreasing
   inside shards of many bins. This moves sizes only. Then each body goes to its bin, where the kept
   records are written with all their bytes.
4. What was written is read again: count and checksum, made anew from the stored fields, are held
   against the listing. Only then the staged folder, with the manifest, gets its final name in one step.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.session import hadoop_fs, materialize, release, remove_path, scratch_path
from quillspan.sources.rowfile import parse_rows

#: Bins a shard is packed into, about: the last one or two of a shard may be less than full.
BINS_A_SHARD = 256
#: A packing of at most so many records is broadcast (some ten MB).
BROADCAST_PLACES = 200_000
_STORED = "bin long, file_id long, offset long, crawl_id long, key binary, page binary, cols map<binary, binary>"
_STORED_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.map_(pa.binary(), pa.binary()))
_STORED_NAMES = [x.split()[0] for x in _STORED.split(", ", 6)]


class FirstFit:
    """First-fit over bins of one capacity, in O(log bins) per item (a tree of the freest bin)."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.bins, self.leaves, self.tree = capacity, 0, 1, [capacity, capacity]

    def place(self, size: int) -> int:
        """The first bin with room; an item above the capacity gets a bin of its own."""
        size = min(max(size, 0), self.capacity)
        if self.tree[1] < size:
            self.tree = self._doubled()
        at = 1
        while at < self.leaves:
            at = 2 * at if self.tree[2 * at] >= size else 2 * at + 1
        found = at - self.leaves
        self.bins = max(self.bins, found + 1)
        self.tree[at] -= size
        at //= 2
        while at:
            self.tree[at] = max(self.tree[2 * at], self.tree[2 * at + 1])
            at //= 2
        return found

    def _doubled(self) -> list[int]:
        old = self.tree[self.leaves :]
        self.leaves *= 2
        tree = [0] * self.leaves + old + [self.capacity] * (self.leaves - len(old))
        for i in range(self.leaves - 1, 0, -1):
            tree[i] = max(tree[2 * i], tree[2 * i + 1])
        return tree


@dataclass(frozen=True)
class Compacted:
    """What a compaction committed."""

    path: str
    records: int
    checksum: int
    files: int

    def stored(self, spark: SparkSession) -> DataFrame:
        """The records as they are kept: key and values as bytes, ``cols`` with every column but the page."""
        return spark.read.schema(_STORED).parquet(f"{self.path}/data")

    def read(self, spark: SparkSession) -> DataFrame:
        """The records with the usual columns decoded; bytes that are not UTF-8 are replaced."""
        text = lambda name: F.make_valid_utf8(F.element_at("cols", F.lit(name.encode())).cast("string"))
        named = [text("url").alias("url"), text("length").try_cast("int").alias("length"), text("contentType").alias("content_type"), text("responseCode").try_cast("int").alias("response_code")]
        return self.stored(spark).select("bin", "file_id", "offset", "crawl_id", F.make_valid_utf8(F.col("key").cast("string")).alias("key"), "page", *named, "cols")


def _number(x: bytes | None) -> int | None:
    try:
        return int(x) if x is not None else None
    except ValueError:
        return None


def _crc(key: bytes, cols: dict[bytes, bytes]) -> int:
    c = zlib.crc32(key)
    for name in sorted(cols):
        c = zlib.crc32(cols[name], zlib.crc32(name, c))
    return c


def list_records(files: DataFrame) -> DataFrame:
    """(file_id, offset, bytes, identity, crc) of each complete record of (file_id, body).

    ``identity`` is the crawlId; a record without one is known by its key and content.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for f, body in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for start, end, key, cols in parse_rows(body.as_py() or b""):
                    crawl, crc = _number(cols.get(b"crawlId")), _crc(key, cols)
                    out.append((f, start, end - start, str(crawl) if crawl is not None else f"{key.hex()}-{crc}", crc))
            cols_ = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols_, kinds, strict=True)], names=["file_id", "offset", "bytes", "identity", "crc"])

    return files.select("file_id", "body").mapInArrow(run, "file_id long, offset long, bytes long, identity string, crc long")


def pack(sizes: DataFrame, target_bytes: int, total: int, bins_a_shard: int = BINS_A_SHARD) -> DataFrame:
    """(file_id, bin) of (file_id, bytes): first-fit decreasing inside shards of about so many bins."""
    shards = max(1, -(-total // (bins_a_shard * target_bytes)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, shard = FirstFit(target_bytes), TaskContext.get().partitionId()
        for b in batches:
            bins = [(shard << 32) + fit.place(n) for n in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bins, pa.int64())], names=["file_id", "bin"])

    dealt = sizes.select("file_id", "bytes").repartition(shards, "file_id").sortWithinPartitions(F.col("bytes").desc(), "file_id")
    return dealt.mapInArrow(run, "file_id long, bin long")


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bin, file_id, offsets, body) rows to the kept records, all bytes of them."""

    def batch(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [()] * len(_STORED_TYPES)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _STORED_TYPES, strict=True)], names=_STORED_NAMES)

    last = None
    for b in batches:
        out: list[tuple] = []
        held = 0
        for place, f, kept, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
            if f == last:  # the same file again: by the order, both lie side by side
                continue
            last, wanted = f, set(kept)
            for start, end, key, cols in parse_rows(body.as_py()):
                if start in wanted:
                    held += end - start
                    out.append((place, f, start, _number(cols.get(b"crawlId")), key, cols.get(b"page"), [(n, v) for n, v in cols.items() if n != b"page"]))
            if held > 8 << 20:
                yield batch(out)
                out, held = [], 0
        yield batch(out)


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(n, crc) of stored records, made from their fields."""
    n = crc = 0
    for b in batches:
        for key, page, cols in zip(b.column(0), b.column(1), b.column(2), strict=True):
            every = dict(cols.as_py())
            if page.is_valid:
                every[b"page"] = page.as_py()
            n, crc = n + 1, crc + _crc(key.as_py(), every)
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([crc], pa.int64())], names=["n", "crc"])


def compact(files: DataFrame, target: str | None = None, *, target_bytes: int = 64 << 20) -> Compacted:
    """Consolidate (file_id LONG, body BINARY) rows into files of about ``target_bytes``.

    ``target`` must not exist yet; by default it is a fresh path in the shared folder. Null or
    empty bodies and broken records are left out; a file or record met twice is kept once;
    other columns are ignored. Files of which more than ``target_bytes`` are kept get a bin of their own. No
    input gives an empty, committed table. Raises, with the staged data removed, if the count or
    checksum of what is stored differs from the listing.
    """
    spark = files.sparkSession
    target = target or scratch_path(spark, "compact")
    stage = f"{target}.staging"
    fs, final = hadoop_fs(spark, target)
    if fs.exists(final):
        raise FileExistsError(target)
    # A file is known by its id and content, so one delivered twice counts once and an id used twice twice.
    files = files.where("body is not null and length(body) > 0").select(F.xxhash64("file_id", "body").alias("file_id"), "body")
    manifest = materialize(files.select("file_id", F.length("body").cast("long").alias("n_bytes")).distinct(), "manifest")

    # A record's identity is bound to one place in a file of the manifest; what moves is small.
    listed = list_records(files).join(manifest.select("file_id"), "file_id", "left_semi")
    places = listed.groupBy("identity").agg(F.min(F.struct("file_id", "offset", "bytes", "crc")).alias("at"))
    kept = materialize(places.groupBy("at.file_id").agg(F.collect_set("at.offset").alias("kept"), F.sum("at.bytes").alias("bytes"), F.count(F.lit(1)).alias("n"), F.sum("at.crc").alias("crc")), "kept")
    want = kept.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("crc"), F.lit(0)).alias("crc"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    packed = materialize(pack(kept, target_bytes, want["bytes"]), "packed")
    bins = packed.agg(F.countDistinct("bin")).first()[0]

    wanted = packed.join(kept.select("file_id", "kept"), "file_id")
    # Small packings are broadcast and bodies move once, to their bins; others meet the bodies in one more shuffle.
    placed = files.join(F.broadcast(wanted) if want["n"] <= BROADCAST_PLACES else wanted, "file_id")
    ordered = placed.select("bin", "file_id", "kept", "body").repartition(max(1, bins), "bin").sortWithinPartitions("bin", "file_id")
    ordered.mapInArrow(_rewrite, _STORED).write.option("compression", "zstd").partitionBy("bin").parquet(f"{stage}/data")

    data = spark.read.schema(_STORED).parquet(f"{stage}/data")
    got = data.select("key", "page", "cols").mapInArrow(_checksums, "n long, crc long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("crc"), F.lit(0)).alias("crc")).first()
    if (got["n"], got["crc"]) != (want["n"], want["crc"]):
        remove_path(spark, stage)
        raise ValueError(f"compaction not committed: {want['n']} records listed, {got['n']} written, checksums {want['crc']} and {got['crc']}")
    manifest.join(packed, "file_id", "left").write.parquet(f"{stage}/manifest")
    report = json.dumps({"records": got["n"], "checksum": got["crc"], "files": bins, "target_bytes": target_bytes})
    spark.createDataFrame([(report,)], "value string").coalesce(1).write.text(f"{stage}/report")
    for table in (manifest, kept, packed):
        release(table)
    if not fs.rename(hadoop_fs(spark, stage)[1], final):
        raise OSError(f"could not rename {stage} to {target}")
    return Compacted(target, got["n"], got["crc"], bins)
