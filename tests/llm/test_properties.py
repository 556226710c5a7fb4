import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspan.llm.garbled import ContextCost, repair
from quillspan.llm.layout import CUT, blocks_of
from quillspan.llm.nearcopies import Runs
from quillspan.llm.tokenize import EditableEncoding, PrefixBpe, tokenizer_path

tokenizers = pytest.importorskip("tokenizers")
with open(tokenizer_path("byte_bpe_50k.json"), "rb") as f:
    BPE = PrefixBpe(f.read())
PUBLIC = tokenizers.Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
PUBLIC.encode_special_tokens = True
texts = st.text(st.characters(blacklist_categories=["Cs"]), max_size=40)


@settings(max_examples=300, deadline=None)
@given(texts)
def test_ids_equal_the_public_ones(text):
    assert BPE.encode(text) == PUBLIC.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(texts, texts, st.integers(0, 40), st.integers(0, 10))
def test_edits_are_exact(text, new, start, length):
    e = EditableEncoding(BPE, text)
    a = min(start, len(text))
    e.replace(a, min(len(text), a + length), new)
    assert e.ids == BPE.encode(e.text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<a href=x>", "</a>", "<li>", "<td>", "<tr>", "<div>", "</div>", "<script>", "</script>", "<br>", "x", " y z ", "\n", "<", ">", "&amp;"]), max_size=40))
def test_every_visible_piece_lies_in_one_block(parts):
    page = "".join(parts)
    layout = blocks_of(page)
    numbers = [p for b in layout.blocks for p in b.pieces]
    assert numbers == sorted(set(numbers))
    assert layout.pieces == sum(bool(x.strip()) for x in CUT.split(page))


@settings(max_examples=150, deadline=None)
@given(texts)
def test_repair_never_fails_and_leaves_ascii(text):
    r = repair(text, ContextCost(100, {}))
    assert not (text.isascii() and "&" not in text and r.garbled)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abcdefg"), max_size=30), st.integers(1, 5))
def test_runs_are_the_distinct_word_runs(words, k):
    runs = Runs(k, True)(" <b>".join(words))
    assert len(runs) == len({tuple(words[i : i + k]) for i in range(len(words) - k + 1)})
    assert (np.diff(runs.astype(object)) > 0).all()
