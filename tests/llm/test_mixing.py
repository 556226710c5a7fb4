import random

import numpy as np
import pytest

from quillspan.llm.mixing import Cell, allocate, marginals, mix, prepare, rake


def test_allocate():
    tokens, shares, caps = {"a": 100, "b": 10}, {"a": 0.6, "b": 0.3, "none": 0.1}, {"a": 1, "b": 2, "none": 3}
    got = allocate(tokens, shares, caps)
    assert got == pytest.approx({"a": 40, "b": 20, "none": 0})
    got = allocate(tokens, shares, caps, 110)
    assert got == pytest.approx({"a": 90, "b": 20, "none": 0})
    assert allocate(tokens, shares, caps, 1e9) == pytest.approx({"a": 100, "b": 20, "none": 0})
    assert allocate({}, shares, caps) == dict.fromkeys(shares, 0.0)


def test_rake_meets_sources_and_caps():
    r = random.Random(1)
    cells = [Cell(s, g, t, r.randrange(1, 5000)) for s in "abc" for g in ("en", "de") for t in range(3)]
    have = {s: sum(c.tokens for c in cells if c.source == s) for s in "abc"}
    caps = {"a": 1, "b": 3, "c": 5}
    goal = allocate(have, {"a": 0.2, "b": 0.3, "c": 0.5}, caps)
    w = rake(cells, goal, caps)
    t = np.array([c.tokens for c in cells])
    for s in "abc":
        at = [i for i, c in enumerate(cells) if c.source == s]
        assert (w[at] * t[at]).sum() == pytest.approx(goal[s], rel=1e-6)
        assert w[at].max() <= caps[s] + 1e-9
    share = lambda f: {v: (w * t)[[getattr(c, f) == v for c in cells]].sum() / (w * t).sum() for v in {getattr(c, f) for c in cells}}
    natural = t[[c.language == "en" for c in cells]].sum() / t.sum()
    assert abs(share("language")["en"] - natural) < 0.05


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["mill", "kiln", "ferry", "bank", "Haus", "Tür"]) for _ in range(r.randrange(1, 90))), s, r.choice(["en", "de", None, "EN "]), 1) for i, s in enumerate([" Wiki"] * 300 + ["news"] * 200 + ["shop "] * 20 + [None] * 5 + ["unlisted"] * 9)]
    rows += [(900, None, "wiki", "en", 1), (901, "", "news", None, 1), (0, rows[0][1], " Wiki", "en", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic int")


def test_mix(spark, docs):
    targets = spark.createDataFrame([("wiki", 0.5, 1), ("News", 0.3, 2), (" shop", 0.15, 4), ("radio", 0.05, 3), (None, 0.1, 2)], "source string, target_share double, max_repeats int")
    ready = prepare(docs)
    chosen, report = mix(ready, targets)
    got = {r["source"]: r for r in report.collect()}
    assert set(got) == {"wiki", "news", "shop", "radio"}
    for s, share in (("wiki", 0.5), ("news", 0.3), ("shop", 0.15)):
        assert got[s]["actual_share"] == pytest.approx(share / 0.95, abs=0.01)
        assert abs(got[s]["mixed_tokens"] - got[s]["goal_tokens"]) <= 100
    assert got["shop"]["most_copies"] == 4 and got["wiki"]["most_copies"] == 1 and got["radio"]["mixed_tokens"] == 0
    rows = chosen.collect()
    assert all(0 < r["copies"] <= {"wiki": 1, "news": 2, "shop": 4}[r["source"]] for r in rows)
    assert sum(r["copies"] * r["tokens"] for r in rows) == sum(r["mixed_tokens"] for r in got.values())
    assert [tuple(r) for r in sorted(mix(ready, targets)[0].collect())] == [tuple(r) for r in sorted(rows)]
    full = {r["source"]: r for r in mix(ready, targets, total="all")[1].collect()}
    total = sum(r["available_tokens"] for r in full.values())
    assert sum(r["mixed_tokens"] for r in full.values()) == pytest.approx(total, rel=0.02)
    assert full["wiki"]["mixed_tokens"] <= full["wiki"]["available_tokens"]


def test_empty(spark, docs):
    targets = spark.createDataFrame([("wiki", 0.5, 1)], "source string, target_share double, max_repeats int")
    chosen, report = mix(prepare(docs.limit(0)), targets)
    assert chosen.count() == 0 and [r["actual_share"] for r in report.collect()] == [0.0]
    assert mix(prepare(docs), targets.limit(0))[0].count() == 0


def test_topics_are_told_from_all_texts(spark):
    r = random.Random(9)
    words = {"a": [f"orchard{k}x" for k in "abcdefghijkl"], "b": [f"engine{k}y" for k in "abcdefghijkl"]}
    rows = [(i, " ".join(r.choice(words["ab"[i % 2]]) for _ in range(60)), "s", "en") for i in range(200)] + [(900, "1 2", "s", "en"), (901, None, "s", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = {r["doc_id"]: r["topic"] for r in prepare(df.repartition(3)).collect()}
    assert not {got[i] for i in range(0, 200, 2)} & {got[i] for i in range(1, 200, 2)}
    assert got[900] == got[901] == -1
    assert got == {r["doc_id"]: r["topic"] for r in prepare(df.repartition(7)).collect()}


def test_texts_are_read_once(spark, docs):
    plan = prepare(docs)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "text" not in plan


def test_marginals(spark, docs):
    ready = prepare(docs)
    chosen = mix(ready, spark.createDataFrame([("wiki", 0.6, 1), ("news", 0.4, 1)], "source string, target_share double, max_repeats int"), total="all")[0]
    got = marginals(ready, chosen).collect()
    for kind in ("language", "topic"):
        assert sum(r["natural_share"] for r in got if r["kind"] == kind) == pytest.approx(1)
        assert sum(r["mixed_share"] for r in got if r["kind"] == kind) == pytest.approx(1)
    assert marginals(ready.limit(0), chosen.limit(0)).count() == 0
