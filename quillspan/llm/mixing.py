"""Mixing sources to target shares of tokens by iterative proportional fitting.

Token weights of (source, language, topic) cells are raked in turn to the language, topic and source
marginals; the source marginal comes last and never lets a document's expected copies exceed the
source's cap. Documents are then drawn by the calibrated weights: whole copies, plus the fractions by
sequential Poisson sampling, which meets each source's tokens to half a document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.tokenize import load_encoder, load_vocabulary
from quillspan.session import materialize, release

TOPICS = 8
#: Rounds in which topics are fitted to all texts, and numbers of a text's vector.
TOPIC_ROUNDS = 6
DIMENSIONS = 128
#: A language with less than this share of the documents counts as "other".
LANGUAGE_SHARE = 0.001
#: Buckets of the drawing order a source's tokens are summed in.
DRAW_BUCKETS = 4096

_WORD = re.compile(r"[^\W\d_]{3,}")


def word_vector(text: str | None, known: dict[str, int]) -> bytes | None:
    """Direction of a text's hashed word counts as DIMENSIONS numbers from 0 to 255; none for one without words."""
    at = []
    for w in _WORD.findall(text.lower()) if text else ():
        d = known.get(w)
        if d is None:
            if len(known) > 300_000:
                known.clear()
            d = known[w] = xxhash.xxh32_intdigest(w) % DIMENSIONS
        at.append(d)
    if not at:
        return None
    v = np.sqrt(np.bincount(np.array(at, np.int64), minlength=DIMENSIONS))
    return np.rint(v * (255 / np.linalg.norm(v))).astype(np.uint8).tobytes()


def _vectors(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x is not None), np.uint8).reshape(-1, DIMENSIONS).astype(np.float32)


def topic_sums(rows: DataFrame, centres: np.ndarray, less: np.ndarray | None = None) -> np.ndarray:
    """Per centre, the sum of the vectors (column ``v``) nearest to it: exact numbers, summed per task first."""
    held = rows.sparkSession.sparkContext.broadcast((centres.astype(np.float32), less))
    n = len(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, off = held.value
        sums = np.zeros((n, DIMENSIONS), np.int64)
        for b in batches:
            x = _vectors(b.column(0))
            near = np.argmax((x if off is None else x - off.astype(np.float32)) @ c.T, axis=1) if len(x) else np.zeros(0, np.int64)
            for k in np.unique(near):
                sums[k] += x[near == k].astype(np.int64).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n * DIMENSIONS, dtype=np.int32)), pa.array(sums.ravel())], names=["at", "s"])

    got = rows.select("v").mapInArrow(run, "at int, s long").groupBy("at").agg(F.sum("s").alias("s")).collect()  # topics x DIMENSIONS
    out = np.zeros(n * DIMENSIONS)
    for r in got:
        out[r["at"]] = r["s"]
    return out.reshape(n, DIMENSIONS)


def fit_topics(rows: DataFrame, topics: int = TOPICS, rounds: int = TOPIC_ROUNDS) -> np.ndarray:
    """Centres of spherical k-means over the vectors of all rows, from fixed directions around their mean."""
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    mean = unit(topic_sums(rows, np.ones((1, DIMENSIONS))))
    centres = topic_sums(rows, np.random.default_rng(5).standard_normal((topics, DIMENSIONS)), mean[0] * 255)
    for _ in range(rounds):
        centres = topic_sums(rows, unit(np.where(centres.any(1, keepdims=True), centres, mean)))
    return unit(np.where(centres.any(1, keepdims=True), centres, mean))


def with_topic(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """``topic`` INT in place of ``v``; -1 for a text without words."""
    held = rows.sparkSession.sparkContext.broadcast(centres.astype(np.float32))
    kept = [c for c in rows.columns if c not in ("v", "topic")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.full(b.num_rows, -1, np.int32)
            some = np.flatnonzero(b.column(0).is_valid().to_numpy(zero_copy_only=False))
            if len(some):
                out[some] = np.argmax(_vectors(b.column(0)) @ held.value.T, axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(out)], names=[*kept, "topic"])

    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept), "topic int"])
    return rows.select("v", *kept).mapInArrow(run, schema)


@dataclass(frozen=True)
class Cell:
    source: str
    language: str
    topic: int
    tokens: int


def allocate(tokens: dict[str, int], shares: dict[str, float], caps: dict[str, int], total: float | None = None) -> dict[str, float]:
    """Tokens each source contributes.

    Without ``total``: the most tokens at which every source that has any meets its share (shares of
    sources without tokens fall to the others in proportion). With it: shares of ``total``; a source
    that its cap holds below its share gives all it may, and the others fill up in proportion.
    """
    most = {s: tokens.get(s, 0) * caps[s] for s in shares}
    live = {s: w for s, w in shares.items() if most[s] > 0 and w > 0}
    if not live:
        return dict.fromkeys(shares, 0.0)
    if total is None:
        scale = min(most[s] / w for s, w in live.items())
        return {s: live.get(s, 0.0) * scale for s in shares}
    total = min(total, float(sum(most[s] for s in live)))
    out, open_ = dict.fromkeys(shares, 0.0), dict(live)
    left = total
    while open_:
        scale = left / sum(open_.values())
        full = [s for s, w in open_.items() if w * scale >= most[s]]
        if not full:
            return out | {s: w * scale for s, w in open_.items()}
        for s in full:
            out[s] = float(most[s])
            left -= most[s]
            del open_[s]
    return out


def rake(cells: list[Cell], goal: dict[str, float], caps: dict[str, int], rounds: int = 60) -> np.ndarray:
    """Expected copies per document of each cell: source totals exact, languages and topics as near as these allow."""
    t = np.array([c.tokens for c in cells], float)
    w = np.ones(len(cells))
    if not len(cells):
        return w
    groups = [np.unique([str(getattr(c, f)) for c in cells], return_inverse=True)[1] for f in ("language", "topic")]
    natural = [np.bincount(g, t) / max(t.sum(), 1e-12) for g in groups]
    whole = sum(goal.values())
    members = {s: np.flatnonzero([c.source == s for c in cells]) for s in goal}
    for _ in range(rounds):
        for g, share in zip(groups, natural, strict=True):
            now = np.bincount(g, w * t)
            w = w * (share * whole / np.maximum(now, 1e-12))[g]
        for s, at in members.items():
            if not len(at) or not t[at].sum():
                continue
            if goal[s] >= caps[s] * t[at].sum() * (1 - 1e-12):
                w[at] = caps[s]
                continue
            low, high = 0.0, 1.0
            reach = lambda f: float((np.minimum(caps[s], f * w[at]) * t[at]).sum())  # noqa: B023, E731
            while reach(high) < goal[s] and high < 1e30:
                high *= 2
            for _ in range(100):
                mid = (low + high) / 2
                low, high = (mid, high) if reach(mid) < goal[s] else (low, mid)
            w[at] = np.minimum(caps[s], high * w[at])
    return w


def _uniform(key: str) -> Column:
    return (F.pmod(F.xxhash64(F.lit(11), F.col(key)), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def prepare(docs: DataFrame, key: str = "doc_id", text: str = "text", *, folder: str | None = None, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """(key, source, language, topic, tokens) of each document; sources and languages trimmed, in lower case."""
    tidy = lambda c: F.lower(F.trim(F.col(c)))
    held = load_vocabulary(docs, vocabulary, folder)
    kept = [key, "source", "language"]

    # The only pass over the texts.
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, known = load_encoder(held.value), {}
        for b in batches:
            tokens, vectors = [], []
            for t in b.column(0):
                t = t.as_py()
                tokens.append(bpe.count(t))
                vectors.append(word_vector(t, known))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(tokens, pa.int32()), pa.array(vectors, pa.binary())], names=[*kept, "tokens", "v"])

    rows = docs.select(F.col(text).alias("__text"), key, tidy("source").alias("source"), F.coalesce(tidy("lang"), F.lit("")).alias("language"))
    measured = materialize(rows.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, source string, language string, tokens int, v binary"), "mix-vectors")
    got = materialize(with_topic(measured, fit_topics(measured)), "mix-docs")
    release(measured)
    n = got.count()
    common = [r["language"] for r in got.groupBy("language").count().where(F.col("count") >= max(1.0, LANGUAGE_SHARE * n)).collect()]  # at most 1 / LANGUAGE_SHARE
    return got.withColumn("language", F.when(F.col("language").isin(common), F.col("language")).otherwise(F.lit("other")))


def mix(prepared: DataFrame, targets: DataFrame, key: str = "doc_id", *, total: float | str | None = None) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares) for documents from ``prepare`` and (source, target_share, max_repeats) rows.

    ``chosen``: (key, source, tokens, copies) with copies from 1 to max_repeats. ``shares``: one row a
    target with what it has, its goal, and the tokens and share it got. ``total`` is as in ``allocate``;
    "all" stands for the tokens of all documents of listed sources. Documents without tokens, or of no
    listed source, are not chosen. A repeated key's rows count one by one. The targets are a short list:
    repeated sources add their shares and keep the lower cap; null shares and repeats count as 0.
    """
    spark = prepared.sparkSession
    listed = targets.where("source is not null").groupBy(F.lower(F.trim("source")).alias("source")).agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("share"), F.min(F.greatest(F.lit(0), F.coalesce("max_repeats", F.lit(0)))).alias("cap")).collect()
    shares, caps = {r["source"]: r["share"] for r in listed}, {r["source"]: r["cap"] for r in listed}
    docs = prepared.where(F.col("source").isin(list(shares)) & (F.col("tokens") > 0)) if shares else prepared.limit(0)
    # At most sources x languages x topics rows.
    rows = docs.groupBy("source", "language", "topic").agg(F.sum("tokens").alias("tokens")).collect()
    cells = sorted((Cell(r["source"], r["language"], r["topic"], r["tokens"]) for r in rows), key=lambda c: (c.source, c.language, c.topic))
    have = {s: sum(c.tokens for c in cells if c.source == s) for s in shares}
    goal = allocate(have, shares, caps, float(sum(have.values())) if total == "all" else total)
    weights = rake(cells, goal, caps)
    table = spark.createDataFrame([(c.source, c.language, c.topic, float(w)) for c, w in zip(cells, weights, strict=True)], "source string, language string, topic int, weight double")
    drawn = docs.join(F.broadcast(table), ["source", "language", "topic"]).withColumn("whole", F.floor(F.col("weight") + 1e-9).cast("int"))
    drawn = drawn.withColumn("part", F.greatest(F.lit(0.0), F.col("weight") - F.col("whole")))
    # Sequential Poisson sampling: the smallest u / part first, until the source's fractions are met.
    order = F.when(F.col("part") > 1e-9, _uniform(key) / F.col("part"))
    drawn = drawn.withColumn("order", order).withColumn("bucket", F.least(F.floor(F.col("order") * DRAW_BUCKETS / 4), F.lit(DRAW_BUCKETS)).cast("int"))
    sums = drawn.where("bucket is not null").groupBy("source", "bucket").agg(F.sum("tokens").alias("held"))
    wanted = drawn.groupBy("source").agg(F.sum(F.col("part") * F.col("tokens")).alias("wanted"))
    before = sums.withColumn("before", F.sum("held").over(Window.partitionBy("source").orderBy("bucket")) - F.col("held"))
    edges = F.broadcast(before.join(wanted, "source").select("source", "bucket", "before", "held", "wanted"))  # sources x buckets rows
    placed = drawn.join(edges, ["source", "bucket"], "left")
    inside = F.col("before") + F.col("held") <= F.col("wanted")
    edge = (F.col("before") < F.col("wanted")) & ~inside
    w = Window.partitionBy("source", "bucket").orderBy("order", key)
    at_edge = placed.where(edge).withColumn("run", F.sum("tokens").over(w) - F.col("tokens") / 2).withColumn("extra", (F.col("before") + F.col("run") <= F.col("wanted")).cast("int"))
    rest = placed.where(~F.coalesce(edge, F.lit(False))).withColumn("extra", F.coalesce(inside, F.lit(False)).cast("int"))
    columns = [key, "source", "tokens", (F.col("whole") + F.col("extra")).alias("copies")]
    chosen = materialize(at_edge.select(*columns).unionByName(rest.select(*columns)).where("copies > 0"), "mix")
    got = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("most_copies"))
    whole = chosen.agg(F.sum(F.col("tokens") * F.col("copies"))).first()[0] or 1
    plan = spark.createDataFrame([(s, float(shares[s]), int(caps[s]), int(have[s]), float(goal[s])) for s in sorted(shares)], "source string, target_share double, max_repeats int, available_tokens long, goal_tokens double")
    report = plan.join(F.broadcast(got), "source", "left")  # both have a row a source
    report = report.select("source", "target_share", "max_repeats", "available_tokens", "goal_tokens", F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.coalesce(F.col("mixed_tokens") / whole, F.lit(0.0)).alias("actual_share"))
    return chosen, report


def marginals(prepared: DataFrame, chosen: DataFrame, key: str = "doc_id") -> DataFrame:
    """(kind, name, natural_share, mixed_share): tokens of each language and topic in all documents and in the mix."""
    copies = chosen.groupBy(key).agg(F.sum("copies").alias("copies"))
    both = prepared.groupBy(key, "language", "topic").agg(F.sum("tokens").alias("tokens"), F.max("tokens").alias("one")).join(copies, key, "left")
    cells = both.groupBy("language", "topic").agg(F.sum("tokens").alias("have"), F.sum(F.col("one") * F.coalesce("copies", F.lit(0))).alias("got"))
    kinds = F.array(F.struct(F.lit("language").alias("kind"), F.col("language").alias("name")), F.struct(F.lit("topic").alias("kind"), F.col("topic").cast("string").alias("name")))
    each = cells.select("have", "got", F.inline(kinds)).groupBy("kind", "name").agg(F.sum("have").alias("have"), F.sum("got").alias("got"))
    w = Window.partitionBy("kind")  # a row a language and topic
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.sum(c).over(w)), F.lit(0.0))
    return each.select("kind", "name", share("have").alias("natural_share"), share("got").alias("mixed_share"))
