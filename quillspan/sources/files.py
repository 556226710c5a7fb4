"""Files as tables: word lists, objects under a prefix, and text and JSON sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.hashing import row_key


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """(term): trimmed, non-empty lines, once each."""
    lines = spark.read.text(path).select(F.trim("value").alias("term"))
    return lines.where("term <> ''").distinct()


def write_words(words: DataFrame, path: str, column: str = "term") -> None:
    """One word per line, in order."""
    words.select(F.col(column).alias("value")).where("value is not null").orderBy("value").write.text(path)


def load_objects(spark: SparkSession, prefix: str, manifest: DataFrame | None = None) -> DataFrame:
    """(key, url, page, length) of all objects under ``prefix``.

    ``manifest`` (path, url) tells the objects' urls, which stores keep outside the content; an object it lacks
    goes by its path. Keys are hashes of urls; of objects with one url the last by path stays. Content is read as
    UTF-8 with bad bytes replaced; ``length`` counts characters. Empty objects are left out (the file source lists none).
    """
    objects = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(prefix).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("page"))
    if manifest is not None:
        objects = objects.join(manifest.select("path", "url"), "path", "left")
    else:
        objects = objects.withColumn("url", F.lit(None).cast("string"))
    named = objects.select("path", F.coalesce("url", "path").alias("url"), "page")
    last = named.groupBy("url").agg(F.max(F.struct("path", "page")).alias("o"))
    return last.select(row_key(F.col("url")).alias("key"), "url", F.col("o.page").alias("page"), F.length("o.page").alias("length"))


def once_per_prefix(df: DataFrame, column: str, length: int = 8) -> DataFrame:
    """One row per start of a column, the least by the whole row."""
    start = F.substring(F.col(f"`{column}`"), 1, length)
    return df.groupBy(start.alias("__start")).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("r")).select(*[F.col(f"r.`{c}`") for c in df.columns])
