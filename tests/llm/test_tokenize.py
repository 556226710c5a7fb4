import random

import pytest

from quillspan.llm.tokenize import EditableEncoding, PrefixBpe, encode_column, tokenizer_path

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def bpe():
    with open(tokenizer_path("byte_bpe_50k.json"), "rb") as f:
        return PrefixBpe(f.read())


@pytest.fixture(scope="module")
def public():
    t = tokenizers.Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


TEXTS = ["", " ", "Hello world", "it's  we'll\n\n x", "<|endoftext|> a", "naïve café 🙂👍🏽", "続きは明日。", "\x1c\x85​﻿ x\tx", "a" * 3000, " " * 500 + "b", "éclair", "नमस्ते سلام 한국어", "12345 678,90 €", "  indent", "don'T 'S 's"]


@pytest.mark.parametrize("text", TEXTS)
def test_equals_the_public_encoder(bpe, public, text):
    assert bpe.encode(text) == public(text)
    assert bpe.decode(bpe.encode(text)) == text


def test_random_texts(bpe, public):
    r = random.Random(3)
    letters = "aeinrst THE'sd.,12\n é漢🙂\t" * 2 + "".join(map(chr, range(32, 400)))
    for _ in range(800):
        s = "".join(r.choice(letters) for _ in range(r.randrange(60)))
        assert bpe.encode(s) == public(s), repr(s)


def test_append_is_exact(bpe):
    data = "internationalisationally".encode()
    last = []
    for n in range(1, len(data) + 1):
        bpe.extend(data[:n], last)
        assert bpe.walk_back(last) == bpe.encode_bytes(data[:n])


def test_edits_re_encode_near_them_only(bpe, public):
    r = random.Random(5)
    e = EditableEncoding(bpe, "The quick brown fox  jumps over 12 lazy dogs.\n\n" * 40)
    for _ in range(200):
        a = r.randrange(len(e.text))
        b = min(len(e.text), a + r.randrange(6))
        again = e.replace(a, b, "".join(r.choice(" ab'1\n") for _ in range(r.randrange(5))))
        assert e.ids == public(e.text)
        assert again < 15
    e.append(" and more")
    assert e.ids == public(e.text)


def test_column(spark, public):
    rows = [(1, "Hello world", "x"), (2, None, "y"), (3, "", "z"), (3, "", "z"), (4, "long " * 20000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {(r["doc_id"], tuple(r["ids"])) for r in encode_column(df, keep=["doc_id", "ids"]).collect()}
    assert got == {(1, tuple(public("Hello world"))), (2, ()), (3, ()), (4, tuple(public("long " * 20000)))}
    assert encode_column(df).count() == 5
    assert [r[0] for r in encode_column(df.where("doc_id = 1"), keep=[], ids="n", count_only=True).collect()] == [2]
    assert encode_column(df.limit(0)).count() == 0
