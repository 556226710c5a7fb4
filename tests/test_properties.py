from hypothesis import given, settings
from hypothesis import strategies as st

from quillspan.functions.stem import porter
from quillspan.operators.compaction import FirstFit
from quillspan.sources.rowfile import format_row, parse_rows

token = st.binary(min_size=1, max_size=20).filter(lambda b: b" " not in b and not b.startswith(b"\n"))
row = st.tuples(token, st.dictionaries(token, st.binary(max_size=60), max_size=5))


@settings(max_examples=200, deadline=None)
@given(st.lists(row, max_size=5), st.binary(max_size=8))
def test_rows_round_trip(rows, tail):
    body = b"".join(format_row(k, c) for k, c in rows)
    got = [(k, c) for _, _, k, c in parse_rows(body)]
    assert got == rows
    # What follows whole records never changes them.
    assert [(k, c) for _, _, k, c in parse_rows(body + tail)][: len(rows)] == rows


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 150), max_size=200))
def test_first_fit_never_overfills_and_wastes_at_most_one_half_bin(sizes):
    fit, held = FirstFit(100), {}
    for s in sorted(sizes, reverse=True):
        b = fit.place(s)
        held[b] = held.get(b, 0) + min(s, 100)
    assert all(v <= 100 for v in held.values())
    assert sum(v <= 50 for v in held.values()) <= 1


@given(st.text("abcdefghijklmnopqrstuvwxyz", max_size=15))
def test_stems_are_no_longer_than_words(word):
    assert len(porter(word)) <= len(word) + 1 and (len(word) > 2 or porter(word) == word)
