import random

import numpy as np
import pytest

from quillspan.llm.nearcopies import BITS, Runs, bands_of, bit_sketch, components, pairs_of_keys, part_keys, similar_classes, similar_pairs, text_keys


def texts():
    r = random.Random(2)
    words = [f"w{i}" for i in range(3000)]
    out, n = [], 0
    for _ in range(60):
        base = [r.choice(words) for _ in range(r.choice([4, 6, 12, 40, 120, 500, 1500]))]
        for _ in range(r.choice([1, 1, 2, 4])):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, len(t) // 60, len(t) // 25])):
                i = r.randrange(len(t))
                t[i : i + r.choice([0, 1])] = [r.choice(words)]
            if r.random() < 0.3:
                h = len(t) // 2
                t = t[h:] + t[:h]
            out.append((n, " ".join(t), 1))
            n += 1
    return out + [(n, None, 1), (n + 1, "", 1), (n + 2, "too short", 1), (None, "a b c d e f", 1), (0, out[0][1], 1)]


def brute(rows, k, similarity):
    runs = Runs(k, False)
    sets = {i: set(runs(t).tolist()) for i, t, _ in rows if i is not None}
    sets = {i: s for i, s in sets.items() if s}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9}, sets


@pytest.mark.parametrize("k,similarity,block", [(4, 0.6, 1000), (5, 0.8, 2)])
def test_pairs_and_classes_equal_brute_force(spark, k, similarity, block):
    rows = texts()
    df = spark.createDataFrame(rows, "id long, text string, a int").repartition(3)
    want, sets = brute(rows, k, similarity)
    assert len(want) > 30
    got = {tuple(r) for r in similar_pairs(df, "id", "text", k=k, similarity=similarity, block=block).collect()}
    assert got == want
    root = {i: i for i in sets}
    for _ in range(10):
        for a, b in want:
            root[a] = root[b] = min(root[a], root[b])
    links = {i: len({frozenset(sets[j]) for p in want if i in p for j in p} - {frozenset(sets[i])}) for i in sets}
    classes = similar_classes(df, "id", "text", k=k, similarity=similarity, block=block).collect()
    assert {(r["id"], r["class_id"]) for r in classes} == set(root.items())
    assert {r["id"]: r["links"] for r in classes} == links


def test_a_hot_group_is_paired_in_blocks(spark):
    keyed = spark.createDataFrame([(1, m) for m in range(57)] + [(1, 5), (2, 3), (2, 4), (3, 9)], "key long, member long")
    got = {tuple(r) for r in pairs_of_keys(keyed, block=10).collect()}
    assert got == {(a, b) for a in range(57) for b in range(a + 1, 57)}


def test_many_copies_of_one_text(spark):
    df = spark.createDataFrame([(i, "one text of more than five words here") for i in range(70)] + [(99, "another text of more than five words")], "id long, text string").repartition(6)
    got = [tuple(r) for r in similar_pairs(df, "id", "text", block=16).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in range(70) for b in range(a + 1, 70)}
    classes = {(r["class_id"], r["links"]) for r in similar_classes(df, "id", "text").collect()}
    assert classes == {(0, 0), (99, 0)}


def test_empty(spark):
    df = spark.createDataFrame([], "id long, text string")
    assert similar_pairs(df, "id", "text").count() == 0
    assert similar_classes(df, "id", "text").count() == 0


def test_sketches_bound_the_difference():
    r = np.random.default_rng(1)
    for n in (10, 60, 300, 900):
        a = np.unique(r.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.concatenate((a[n // 5 :], r.integers(0, 1 << 62, n // 7).astype(np.uint64))))
        apart = len(np.setxor1d(a, b))
        assert np.bitwise_count((bit_sketch(a) ^ bit_sketch(b)).view(np.uint64)).sum() <= apart
        assert len(bit_sketch(a)) == BITS // 64
        for band in bands_of(len(a), 0.6):
            assert len(np.intersect1d(part_keys(a, band), part_keys(b, band))) > 0


@pytest.mark.parametrize("a,b,common", [(25, 25, 0.34), (40, 40, 0.49), (99, 165, 0.3), (100, 100, 0.16), (100, 100, 0.3), (200, 200, 0.49), (390, 390, 0.49), (399, 660, 0), (399, 660, 0.3), (399, 660, 0.49), (1599, 2600, 0.49), (6399, 10600, 0.3), (1700, 1700, 0), (5000, 5000, 0.5), (300, 300, 0.7)])
def test_few_pairs_at_the_threshold_are_missed(a, b, common):
    r = np.random.default_rng(5)
    shared = int(np.ceil(0.6 * (a + b) / 1.6))
    missed, rounds = 0, 1200 if a < 1000 else 150
    for _ in range(rounds):
        runs = r.integers(0, 1 << 63, a + b - shared).astype(np.uint64)
        rare = np.ones(len(runs), bool)
        rare[: int(common * a)] = False  # of the shared ones
        keys = []
        for at in (np.arange(a), np.concatenate((np.arange(shared), np.arange(a, len(runs))))):
            at = at[np.argsort(runs[at])]
            keys.append(np.concatenate(text_keys(runs[at], rare[at], 0.6)))
        missed += not len(np.intersect1d(*keys))
    assert missed <= rounds / 400


@pytest.mark.parametrize("similarity", [0.4, 0.5, 0.8, 0.9])
def test_other_similarities_miss_as_few(similarity):
    r = np.random.default_rng(7)
    missed, rounds, size = 0, 300, 200
    shared = int(np.ceil(similarity * 2 * size / (1 + similarity)))
    for _ in range(rounds):
        runs = r.integers(0, 1 << 63, 2 * size - shared).astype(np.uint64)
        rare = np.arange(len(runs)) >= size // 4
        keys = []
        for at in (np.arange(size), np.concatenate((np.arange(shared), np.arange(size, len(runs))))):
            at = at[np.argsort(runs[at])]
            keys.append(np.concatenate(text_keys(runs[at], rare[at], similarity)))
        missed += not len(np.intersect1d(*keys))
    assert missed <= 2


def test_too_low_a_similarity_is_refused():
    with pytest.raises(ValueError):
        text_keys(np.arange(90, dtype=np.uint64) * np.uint64(1 << 40), np.ones(90, bool), 0.02)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (200, 203)]
    nodes = spark.createDataFrame([(i,) for i in [*range(41), 100, 101, 102, 200, 203, 300]], "node long")
    got = {r["node"]: r["root"] for r in components(nodes, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 200: 200, 203: 200, 300: 300}
