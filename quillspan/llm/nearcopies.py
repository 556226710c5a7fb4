"""Near-copies of texts: pairs whose word runs overlap by at least a share, by a parity-sketch join.

A text is the set of its runs of k words. Its runs are dealt to the n parts of a sketch by their hash, and
each part is the exclusive or of its runs' 64-bit hashes: a run in both texts cancels out, so texts
differ in at most as many parts as runs (the Hamming distance of sketches bounds the symmetric
difference from below). Similar texts of a size band hence agree in many parts; pairs that agree in a
part are candidates. A second sketch of single bits bounds the difference again and discards most
wrong ones, and the remaining pairs are verified on the full sets.

Runs that a hundredth of all texts show (menus, notices) are left out of the parts, as parts made of
them alone would gather a whole site; they count in the verification. A text emits as many parts as its
size, its common runs and the similarity ask for, so that a pair at the threshold is missed once in
1 / MISSED; beyond one sketch's parts those of further sketches, with runs dealt differently, follow. The
text of a pair that emits fewer decides, as its own bound holds for the pair. Pairs across a border of
bands meet in a sketch for that size.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.session import materialize, release

#: Size bands of a sketch: [BAND * 4**i, BAND * 4**(i+1)); below BAND each run is a part of its own.
BAND = 25
#: Parts of a sketch, by the lower bound of its band; larger bands have PARTS_SHARE of it.
PARTS = {25: 48, 100: 96, 400: 288}
PARTS_SHARE = 0.72
#: Parts of the sketch for pairs across an upper border of 400 or more (texts of about that size), as a share of it.
BORDER_SHARE = 0.42
#: Pairs at the threshold that may be missed, by a Poisson estimate over all sizes and shares of common runs.
MISSED = 5e-4
#: Sketches of rare runs at most; texts that need more emit parts of all runs too.
SKETCHES = 4
#: Sketches of all runs at most: a similarity that needs more is refused.
MOST_SKETCHES = 40
#: Bits of the second sketch.
BITS = 1024
#: A part's members are paired in one go up to this many, beyond it block by block.
BLOCK = 1000
#: Bits of the filter that says which texts the verification needs.
FILTER_BITS = 1 << 23

_TAG = re.compile(r"<[^>]*>")
_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)
_MIX3 = np.uint64(0x94D049BB133111EB)


class Runs:
    """Sets of hashed runs of k words."""

    def __init__(self, k: int, tags: bool) -> None:
        self.k, self.tags, self._hash = k, tags, {}

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes of the text's runs; none for a text of fewer than k words."""
        if not text:
            return np.empty(0, np.uint64)
        if self.tags:
            text = _TAG.sub(" ", text)
        words = _WORD.findall(text.lower()) if "İ" not in text else [w.lower() for w in _WORD.findall(text)]
        if len(words) < self.k:
            return np.empty(0, np.uint64)
        known = self._hash
        try:
            a = np.array([known[w] for w in words], np.uint64)
        except KeyError:
            if len(known) > 500_000:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w)
            a = np.array([known[w] for w in words], np.uint64)
        n = len(a) - self.k + 1
        h = a[:n] * _MIX
        for j in range(1, self.k):
            h ^= h >> np.uint64(29)
            h *= _MIX2
            h += a[j : n + j]
        h ^= h >> np.uint64(32)
        h *= _MIX3
        h ^= h >> np.uint64(29)
        h.sort()
        return h if len(h) < 2 else h[np.concatenate(([True], h[1:] != h[:-1]))]


def bands_of(size: int, share: float) -> list[int]:
    """The sketches a text needs: that of its band (by lower bound), and those in which it meets partners of
    another band: up to 100 the sketch of the band below, beyond it one for the border (negative)."""
    if size < BAND:
        return [0]
    low = BAND
    while low * 4 <= size:
        low *= 4
    out = [low]
    if share * size < low:
        out.append(0 if low == BAND else BAND if low == 4 * BAND else -low)
    if low > BAND and size >= share * low * 4 - 1e-9:
        out.append(-low * 4)
    return out


def part_keys(runs: np.ndarray, band: int, sketch: int = 0, most: int | None = None) -> np.ndarray:
    """Keys of the parts of ``runs`` in a sketch of a band (of its first ``most``): part number and exclusive or, mixed."""
    if not band:
        return runs * _MIX2 ^ _MIX3
    n, least = _shape(band)
    dealt = runs if not sketch else (runs ^ (runs >> np.uint64(31))) * (_MIX2 + np.uint64(2 * sketch))
    part = (dealt >> np.uint64(20)) % np.uint64(n)
    order = np.argsort(part, kind="stable")
    part, runs = part[order], runs[order]
    if not len(part):
        return part
    starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    held = np.diff(np.concatenate((starts, [len(part)])))
    which = part[starts]
    good = held >= least
    if most is not None:
        good &= which < most
    parity = np.bitwise_xor.reduceat(runs, starts)[good]
    key = (parity ^ (which[good] * _MIX + np.uint64((band + (sketch << 40)) % (1 << 64)))) * _MIX3
    return key ^ (key >> np.uint64(31))


def _shape(band: int) -> tuple[int, int]:
    """(parts, runs a part needs) of a sketch."""
    if band < 0:
        return int(-band * BORDER_SHARE), 2
    return PARTS.get(band, int(PARTS_SHARE * band)), 1 if band == BAND else 2


@lru_cache(maxsize=200_000)
def parts_needed(size: int, common: int, band: int, similarity: float) -> int:
    """Parts to be emitted so that a pair at the threshold agrees in one but for MISSED, over all sizes a partner may
    have, if all common runs are shared and all that differs is rare; none (0) if no number does."""
    n, least = _shape(band)
    low, high = (0, math.inf) if band < 0 else (band, 4 * band - 1 if band > BAND else 4 * BAND / similarity)
    agrees = 1.0
    for step in range(9):
        other = min(high, max(low, size * similarity ** (1 - step / 4)))
        shared = similarity * (size + other) / (1 + similarity)
        if shared > min(size, other) + 1e-9:
            continue
        rare = (shared - min(common, shared)) / n
        agrees = min(agrees, math.exp(-(size + other - 2 * shared) / n) * -math.expm1(-rare) if least == 1 else math.exp(-(size + other - 2 * shared) / n) * (1 - math.exp(-rare) * (1 + rare)))
    return math.ceil(math.log(MISSED) / math.log1p(-agrees)) if agrees > 1e-12 else 0


def _sketches(runs: np.ndarray, band: int, parts: int) -> list[np.ndarray]:
    """Keys of the first so many parts, from as many sketches as they fill."""
    n, _ = _shape(band)
    return [part_keys(runs, band, k, parts - k * n) for k in range(-(-parts // n))]


def text_keys(runs: np.ndarray, rare: np.ndarray, similarity: float) -> list[np.ndarray]:
    """Keys of a text's parts, by band: those of its rare runs, and where these cannot do (a text that is mostly common
    can be like another by that alone) those of all runs."""
    size, n = len(runs), int(np.count_nonzero(rare))
    out = []
    for band in bands_of(size, similarity):
        if not band:
            out.append(part_keys(runs[rare], band))
            if 2 * n < size:
                out.append(part_keys(runs, band) ^ np.uint64(1))
            continue
        parts, most = parts_needed(size, size - n, band, similarity), SKETCHES * _shape(band)[0]
        out += _sketches(runs[rare], band, min(parts or most, most))
        if not 0 < parts <= most:
            every = parts_needed(size, 0, band, similarity)
            if not 0 < every <= MOST_SKETCHES * _shape(band)[0]:
                raise ValueError(f"similarity {similarity} is too low for sketches")
            out += [k ^ np.uint64(1) for k in _sketches(runs, band, every)]
    return out


def bit_sketch(runs: np.ndarray) -> np.ndarray:
    """Parity of the runs that fall on each bit, as BITS / 64 words."""
    odd = np.bincount((runs >> np.uint64(7) & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def member_of(runs: np.ndarray) -> int:
    """A 64-bit name of the set, the same for all texts with these runs."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(runs.tobytes())).astype(np.int64)))


def common_runs(df: DataFrame, text: str, k: int, tags: bool, share: float) -> DataFrame:
    """(run, n): runs that about ``share`` of all texts show; at most (runs per text) / share of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, seen = Runs(k, tags), 0
        total: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.uint64), np.empty(0, np.int64))

        def merged(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            # Runs met in few of the texts so far are dropped: what they could add later is below the share.
            new, n = np.unique(np.concatenate(held), return_counts=True)
            every, at = np.unique(np.concatenate((total[0], new)), return_inverse=True)
            count = np.bincount(at, weights=np.concatenate((total[1], n))).astype(np.int64)
            good = count >= max(2, share / 2 * seen)
            return every[good], count[good]

        held: list[np.ndarray] = []
        for b in batches:
            for t in b.column(0):
                r = runs(t.as_py())
                if len(r):
                    held.append(r)
                    seen += 1
                if len(held) >= 8192:
                    total, held = merged(held), []
        if held:
            total = merged(held)
        yield pa.RecordBatch.from_arrays([pa.array(total[0].view(np.int64)), pa.array(total[1])], names=["run", "n"])

    return df.select(text).mapInArrow(run, "run long, n long").groupBy("run").agg(F.sum("n").alias("n"))


def sketches(df: DataFrame, key: str, text: str, k: int, tags: bool, similarity: float, common_share: float) -> DataFrame:
    """(id, member, size, bits, keys) of each text with a run; copies that a task has met bring no keys again."""
    spark = df.sparkSession
    n = df.where(F.col(text).isNotNull() & (F.col(text) != "")).count()
    frequent = common_runs(df, text, k, tags, common_share).where(F.col("n") >= max(3.0, common_share * n)).select("run").toPandas()
    stop = spark.sparkContext.broadcast(np.sort(frequent["run"].to_numpy(np.int64).view(np.uint64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, met, common = Runs(k, tags), set(), stop.value
        for b in batches:
            ids, members, sizes, bits, keys, ends = [], [], [], [], [], [0]
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                r = runs(t.as_py())
                if not len(r):
                    continue
                m = member_of(r)
                ids.append(i)
                members.append(m)
                sizes.append(len(r))
                bits.append(bit_sketch(r))
                if m not in met:
                    if len(met) > 1_000_000:
                        met.clear()
                    met.add(m)
                    rare = np.ones(len(r), bool)
                    if len(common):
                        at = np.searchsorted(common, r)
                        at[at == len(common)] = 0
                        rare = common[at] != r
                    keys += text_keys(r, rare, similarity)
                ends.append(len(keys))
            lengths = np.concatenate(([0], np.cumsum([len(x) for x in keys]))) if keys else np.zeros(1, np.int64)
            offsets = pa.array(lengths[ends].astype(np.int32))
            flat = np.concatenate(keys).view(np.int64) if keys else np.empty(0, np.int64)
            width = BITS // 64
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(members, pa.int64()), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(0, width * len(ids) + 1, width, dtype=np.int32)), pa.array(np.concatenate(bits) if bits else np.empty(0, np.int64))), pa.ListArray.from_arrays(offsets, pa.array(flat))],
                names=["id", "member", "size", "bits", "keys"],
            )

    return df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null").mapInArrow(run, "id long, member long, size int, bits array<long>, keys array<long>")


def pairs_of_keys(keyed: DataFrame, block: int = BLOCK) -> DataFrame:
    """Distinct (a, b), a < b, of members that share a key, from (key, member) rows.

    Rows come sorted by key and stream past; a key's members up to ``block`` are paired at once. The
    members of a larger key are cut into blocks, and pairs of blocks are spread over the tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, open_members, blocks = None, np.empty(0, np.int64), 0
        none = np.empty(0, np.int64)

        def out(a: list[np.ndarray], b: list[np.ndarray], parts: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
            x, y = (np.concatenate(a), np.concatenate(b)) if a else (none, none)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate((x, np.zeros(len(parts), np.int64)))), pa.array(np.concatenate((y, np.zeros(len(parts), np.int64)))), pa.array([None] * len(x) + [p[0] for p in parts], pa.int64()), pa.array([None] * len(x) + [p[1] for p in parts], pa.int32()), pa.array([None] * len(x) + [p[2] for p in parts], pa.list_(pa.int64()))],
                names=["a", "b", "key", "block", "members"],
            )

        def close(a, b, parts):
            m = np.unique(open_members)
            if blocks:
                if len(m):
                    parts.append((open_key, blocks, m))
            elif len(m) > 1:
                i, j = np.triu_indices(len(m), 1)
                a.append(m[i])
                b.append(m[j])

        for batch in batches:
            key, member = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(key):
                continue
            a, b, parts = [], [], []
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            lengths = np.diff(np.concatenate((starts, [len(key)])))
            last = len(starts) - 1
            # Keys of one row that neither continue the batch before nor may go on in the next are alone.
            for r in np.flatnonzero((lengths > 1) | (np.arange(last + 1) == 0) | (np.arange(last + 1) == last)):
                s, e = starts[r], starts[r] + lengths[r]
                k = int(key[s])
                if k != open_key:
                    close(a, b, parts)
                    open_key, open_members, blocks = k, none, 0
                for at in range(s, e, block):
                    open_members = np.unique(np.concatenate((open_members, member[at : min(e, at + block)])))
                    if len(open_members) > block:
                        parts.append((k, blocks, open_members[:block]))
                        open_members, blocks = open_members[block:], blocks + 1
            yield out(a, b, parts)
        a, b, parts = [], [], []
        close(a, b, parts)
        yield out(a, b, parts)

    # By key and, in it, member: equal members (copies from several tasks) lie side by side.
    streamed = keyed.repartition("key").sortWithinPartitions("key", "member").mapInArrow(run, "a long, b long, key long, block int, members array<long>")
    streamed = materialize(streamed, "pairs")
    pairs = streamed.where("key is null").select("a", "b")
    large = streamed.where("key is not null").select("key", "block", "members")
    if large.isEmpty():
        return pairs.distinct()
    counts = large.groupBy("key").agg((F.max("block") + 1).alias("blocks"))
    each = large.join(counts, "key").select("key", "block", "members", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    each = each.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "members")
    meet = each.groupBy("key", "i", "j").agg(F.min_by("members", "block").alias("x"), F.max_by("members", "block").alias("y"))
    met = meet.select(F.explode("x").alias("a"), "y").select("a", F.explode("y").alias("b")).where("a <> b")
    return pairs.unionByName(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()


def _needed(ids: DataFrame) -> np.ndarray:
    """A filter of fixed size over (id): the words of a bit array; a bit may stand for several ids."""
    bit = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    words = ids.select((bit / 64).cast("int").alias("w"), (bit % 64).cast("int").alias("s")).select("w", F.expr("shiftleft(1L, s)").alias("v")).groupBy("w").agg(F.bit_or("v").alias("v")).toPandas()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[words["w"].to_numpy(np.int64)] = words["v"].to_numpy(np.int64)
    return out


def similar_members(df: DataFrame, key: str, text: str, *, k: int = 5, similarity: float = 0.8, tags: bool = False, common_share: float = 0.01, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): (id, member) of every text with a run, and (a, b, similarity) of different members.

    Members name sets of runs, so exact copies share one. Null keys, and texts null, empty or shorter
    than k words, have none; a key met with two texts has two. Pairs are exact: each candidate is
    verified on its full sets. Hashes have 64 bits.
    """
    spark = df.sparkSession
    # What differs at most, as a share of both sizes.
    apart = (1 - similarity) / (1 + similarity)
    known = materialize(sketches(df, key, text, k, tags, similarity, common_share), "sketches")
    members = known.select("id", "member").distinct()
    keyed = known.select(F.explode("keys").alias("key"), "member")
    cands = pairs_of_keys(keyed, block)
    one = known.groupBy("member").agg(F.min(F.struct("id", "size", "bits")).alias("m")).select("member", "m.*")
    left = one.select(F.col("member").alias("a"), F.col("id").alias("id_a"), F.col("size").alias("size_a"), F.col("bits").alias("bits_a"))
    right = one.select(F.col("member").alias("b"), F.col("id").alias("id_b"), F.col("size").alias("size_b"), F.col("bits").alias("bits_b"))
    both = cands.join(left, "a").where("size_a > 0").join(right, "b")
    distance = F.aggregate(F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    close = (F.least("size_a", "size_b") >= similarity * F.greatest("size_a", "size_b") - 1e-9) & (distance <= apart * (F.col("size_a") + F.col("size_b")) + 1e-9)
    pairs = materialize(both.where(close).select("a", "b", "id_a", "id_b"), "candidates")

    # The full sets of the texts that are in a pair; pages that are not needed are passed over where they lie.
    needed = spark.sparkContext.broadcast(_needed(pairs.select(F.col("id_a").alias("id")).union(pairs.select(F.col("id_b").alias("id")))))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, words, met = Runs(k, tags), needed.value, set()
        for b in batches:
            bit = b.column(0).to_numpy()
            wanted = np.flatnonzero(words[bit // 64] >> (bit % 64) & 1)
            out: list[tuple[int, bytes]] = []
            for i in wanted.tolist():
                r = runs(b.column(1)[i].as_py())
                if not len(r) or (m := member_of(r)) in met:
                    continue
                if len(met) > 1_000_000:
                    met.clear()
                met.add(m)
                out.append((m, r.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([m for m, _ in out], pa.int64()), pa.array([s for _, s in out], pa.binary())], names=["member", "runs"])

    pages = df.where(F.col(key).isNotNull()).select(F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(FILTER_BITS)).alias("bit"), F.col(text))
    full = pages.mapInArrow(sets, "member long, runs binary")
    wanted = pairs.select(F.col("a").alias("member")).union(pairs.select(F.col("b").alias("member"))).distinct()
    full = full.join(wanted, "member", "left_semi").groupBy("member").agg(F.first("runs").alias("runs"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.zeros(b.num_rows)
            for i, (x, y) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(q, p)
                at[at == len(q)] = 0
                shared = int((q[at] == p).sum())
                got[i] = shared / (len(p) + len(q) - shared)
            keep = pa.array(got >= similarity - 1e-12)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got)], names=["a", "b", "similarity"]).filter(keep)

    checked = pairs.select("a", "b").join(full.select(F.col("member").alias("a"), F.col("runs").alias("x")), "a").join(full.select(F.col("member").alias("b"), F.col("runs").alias("y")), "b")
    return members, checked.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long, similarity double")


def similar_pairs(df: DataFrame, key: str, text: str, **options) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of all texts that are alike, copies of one another included."""
    members, pairs = similar_members(df, key, text, **options)
    pairs = materialize(pairs, "similar")
    a, b = members.select(F.col("id").alias("x"), F.col("member").alias("a")), members.select(F.col("id").alias("y"), F.col("member").alias("b"))
    across = pairs.select("a", "b").join(a, "a").join(b, "b").where("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    # Copies of one text are paired in blocks, as the members of a part are.
    same = members.groupBy("member").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("member")
    within = pairs_of_keys(members.join(same, "member").select(F.col("member").alias("key"), F.col("id").alias("member")), options.get("block", BLOCK))
    within = within.select(F.col("a").alias("id_a"), F.col("b").alias("id_b"))
    both = across.unionByName(within)
    return both.distinct()


def components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the least node of each connected component.

    Each round every node takes the least label around it, then its label's label; rounds end when no label
    changes, after about log(diameter) rounds. Hot nodes are aggregated before they are shuffled.
    """
    labels = materialize(nodes.select("node", F.col("node").alias("root")).distinct(), "labels")
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("least"))
        hooked = labels.select("node", "root").join(near, "node", "left").select("node", F.least("root", "least").alias("new"), "root")
        # The old root learns of the smaller label too, so whole trees move at once.
        moved = hooked.where("new < root").groupBy(F.col("root").alias("node")).agg(F.min("new").alias("to"))
        hooked = hooked.join(moved, "node", "left").select("node", F.least("new", "to").alias("new"), "root")
        jump = hooked.select(F.col("node").alias("new"), F.col("new").alias("up"))
        before, now = labels, materialize(hooked.join(jump, "new").select("node", F.least("new", "up").alias("root"), (F.least("new", "up") < F.col("root")).alias("changed")), "labels")
        release(before)
        if now.where("changed").isEmpty():
            release(both)
            return now.select("node", "root")
        labels = now
    raise RuntimeError(f"components not found in {most_rounds} rounds")


def similar_classes(df: DataFrame, key: str, text: str, **options) -> DataFrame:
    """(id, class_id, links) of each text with a run: the class of texts linked to it, directly or through
    others, named by its least id, and the number of different texts it is linked to directly."""
    members, pairs = similar_members(df, key, text, **options)
    pairs = materialize(pairs.select("a", "b"), "similar")
    roots = components(members.select(F.col("member").alias("node")), pairs)
    links = pairs.select(F.col("a").alias("member")).union(pairs.select(F.col("b").alias("member"))).groupBy("member").agg(F.count(F.lit(1)).alias("links"))
    rooted = members.join(roots.withColumnRenamed("node", "member"), "member").join(links, "member", "left")
    names = rooted.groupBy("root").agg(F.min("id").alias("class_id"))
    return rooted.join(names, "root").select("id", "class_id", F.coalesce("links", F.lit(0)).alias("links"))
