import random

import pyarrow as pa
import pytest

from quillspan.operators import compaction
from quillspan.operators.compaction import FirstFit, compact, pack
from quillspan.sources.rowfile import format_row, parse_rows, read_row_files, read_rows


def record(i, extra=b"", order=0):
    cols = [(b"crawlId", str(i).encode()), (b"url", f"http://h.test:80/{i}".encode()), (b"page", f"<p>line\n{i} \r\n</p>".encode() * (i % 7) + extra), (b"responseCode", b"200")]
    random.Random(order).shuffle(cols)
    return format_row(f"key{i}".encode(), dict(cols))


def test_round_trip():
    body = record(1) + b"\n" + record(2, b"\xff\x00") + format_row(b"k", {})
    got = [(k, c) for _, _, k, c in parse_rows(body)]
    assert [k for k, _ in got] == [b"key1", b"key2", b"k"] and got[1][1][b"page"].endswith(b"\xff\x00") and got[2][1] == {}
    assert b"".join(body[s:e] for s, e, _, _ in parse_rows(body)) == body.replace(b"\n\nkey2", b"\nkey2")


@pytest.mark.parametrize("cut", range(1, 60))
def test_what_breaks_off_is_left_out(cut):
    assert [k for _, _, k, _ in parse_rows(record(3) + record(5)[:-cut])] == [b"key3"]


@pytest.mark.parametrize("body", [b"", b"\n\n", b"key", b"key ", b"key col", b"key col 5", b"key col x abc \n", b"key col -1 a \n", b"k c 3 abcd \n", b"k c 99999999999999999999999 a \n"])
def test_broken_bodies(body):
    assert list(parse_rows(body)) == []


def test_read_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, bytearray(record(1) + record(2)), "a"), (2, None, "b"), (3, bytearray(b""), "c"), (4, bytearray(record(4)[:-1]), "d")], "id long, body binary, cols string")
    got = {(r["id"], r["key"], bytes(r["cols"]["crawlId"])) for r in read_rows(df).collect()}
    assert got == {(1, "key1", b"1"), (1, "key2", b"2")}
    (tmp_path / "a").write_bytes(record(7))
    assert [r["key"] for r in read_row_files(spark, str(tmp_path)).collect()] == ["key7"]


def test_first_fit_decreasing():
    r = random.Random(1)
    sizes = sorted((r.randrange(1, 120) for _ in range(500)), reverse=True)
    fit, bins, plain = FirstFit(100), {}, []
    for s in sizes:
        b = fit.place(s)
        bins[b] = bins.get(b, 0) + min(s, 100)
        for i, held in enumerate(plain):
            if held + min(s, 100) <= 100:
                plain[i] += min(s, 100)
                break
        else:
            i, _ = len(plain), plain.append(min(s, 100))
        assert i == b
    assert max(bins.values()) <= 100 and len(bins) == fit.bins


def test_compact(spark):
    bodies = {i: b"".join(record(j, order=i) for j in range(i * 3, i * 3 + 4)) for i in range(40)}
    bodies[100] = record(500) + record(501)[:-5]
    bodies[101] = format_row(b"noid", {b"page": b"x"})
    bodies[102] = b""
    rows = [(i, bytearray(b), "n") for i, b in bodies.items()] + [(103, None, "n"), (0, bytearray(bodies[0]), "n"), (None, bytearray(record(600)), "n"), (1, bytearray(record(700)), "n")]
    df = spark.createDataFrame(rows, "file_id long, body binary, bin string").repartition(4)
    for target in (10_000_000, 700):
        done = compact(df, target_bytes=target)
        got = done.read(spark).collect()
        assert sorted(r["crawl_id"] for r in got if r["crawl_id"] is not None) == sorted([*range(121), 500, 600, 700])
        assert [r["key"] for r in got if r["crawl_id"] is None] == ["noid"]
        assert done.records == len(got) == 125 and done.files == len({r["bin"] for r in got})
        assert {r["crawl_id"]: bytes(r["page"]) for r in got if r["crawl_id"] == 6} == {6: f"<p>line\n6 \r\n</p>".encode() * 6}
    assert done.files > 3
    with pytest.raises(FileExistsError):
        compact(df, done.path)
    empty = compact(df.limit(0))
    assert empty.records == 0 and empty.read(spark).count() == 0


def test_scratch_tables(spark):
    from quillspan.session import clear_scratch, materialize, release, scratch_root

    df = materialize(spark.range(5).toDF("n"), "t")
    assert df.count() == 5 and df._scratch.startswith(scratch_root(spark))
    release(df)
    release(spark.range(1))  # nothing to remove
    clear_scratch(spark)
    assert materialize(spark.range(0).toDF("n"), "t").count() == 0


def test_long_keys_and_names_end_nothing():
    body = format_row(b"k" * 40_000, {b"c" * 40_000: b"1"}) + record(2)
    assert [(len(k), len(c)) for _, _, k, c in parse_rows(body)] == [(40_000, 1), (4, 4)]


def test_no_byte_is_lost(spark):
    odd = {b"crawlId": b"7", b"url": b"http://h/\xff", b"page": b"\x00\xfe", b"extra": b"\xc3", b"\xff": b"", b"length": b"2"}
    df = spark.createDataFrame([(1, bytearray(format_row(b"k\xff", odd)))], "file_id long, body binary")
    done = compact(df)
    r = done.stored(spark).first()
    assert bytes(r["key"]) == b"k\xff" and {**{bytes(k): bytes(v) for k, v in r["cols"].items()}, b"page": bytes(r["page"])} == odd
    assert done.read(spark).first()["length"] == 2
    manifest = spark.read.parquet(f"{done.path}/manifest").collect()
    assert [(m["n_bytes"], m["bin"]) for m in manifest] == [(len(format_row(b"k\xff", odd)), 0)]


@pytest.mark.parametrize("column", ["key", "page", "cols"])
def test_damage_is_not_committed(spark, tmp_path, monkeypatch, column):
    whole = compaction._rewrite

    def damaged(batches):
        for b in whole(batches):
            cols = b.to_pydict()
            if cols[column]:
                x = cols[column][0]
                cols[column][0] = [(n, v + b"!") for n, v in x] if column == "cols" else x[:-1] + b"!"
            yield pa.RecordBatch.from_arrays([pa.array(cols[n], t) for n, t in zip(compaction._STORED_NAMES, compaction._STORED_TYPES, strict=True)], names=compaction._STORED_NAMES)

    monkeypatch.setattr(compaction, "_rewrite", damaged)
    df = spark.createDataFrame([(i, bytearray(record(i, b"x"))) for i in range(1, 9)], "file_id long, body binary")
    with pytest.raises(ValueError, match="not committed"):
        compact(df, f"file://{tmp_path}/out")
    assert not (tmp_path / "out").exists() and not (tmp_path / "out.staging").exists()


def test_bins_are_near_the_ideal(spark):
    r = random.Random(3)
    sizes = [(i, min(9000, int(r.expovariate(1 / 900)) + 20)) for i in range(20_000)]
    total = sum(n for _, n in sizes)
    got = pack(spark.createDataFrame(sizes, "file_id long, bytes long").repartition(5), 10_000, total)
    held = {}
    for f, b in got.collect():
        held[b] = held.get(b, 0) + sizes[f][1]
    assert sum(held.values()) == total and max(held.values()) <= 10_000
    assert len(held) <= 1.1 * total / 10_000
