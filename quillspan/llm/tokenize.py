"""Byte-level BPE encoding by prefix dynamic programming.

For each prefix of a pre-token's bytes there is exactly one token that can end its encoding: the
token t such that the encoding of what lies before t, followed by t, is what BPE gives. Storing
that last token per prefix yields the encoding by walking back, lets bytes be appended without
looking at the earlier ones again, and lets an edit re-encode only what lies around it.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: The pre-token pattern of the public vocabulary, with Unicode's white space.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

#: Bound of a worker's table of encoded pre-tokens.
CACHED_PRE_TOKENS = 400_000


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """Path of a public tokenizer's file; ``folder`` overrides the installed place."""
    if folder:
        return f"{folder.rstrip('/')}/{name}"
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return f"/opt/tokenizers/{name}"


def _byte_of_letter() -> dict[str, int]:
    """Printable bytes stand for themselves in the vocabulary file, the others for letters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class PrefixBpe:
    """Encoder for one vocabulary: JSON with ``model.vocab`` and ordered ``model.merges``."""

    def __init__(self, vocabulary: bytes) -> None:
        model = json.loads(vocabulary)["model"]
        letters = _byte_of_letter()
        to_bytes = lambda s: bytes(letters[c] for c in s)
        known = {t: i for t, i in model["vocab"].items() if all(c in letters for c in t)}
        self.ids: dict[bytes, int] = {to_bytes(t): i for t, i in known.items()}
        self.tokens = {i: b for b, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        #: Order in which BPE applies merges; a single byte has none.
        self.order: dict[int, int] = dict.fromkeys((i for b, i in self.ids.items() if len(b) == 1), -1)
        for n, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b = known.get(left), known.get(right)
            whole = known.get(left + right)
            if a is None or b is None or whole is None or whole in self.order:
                continue
            self.merged[a, b], self.parts[whole], self.order[whole] = whole, (a, b), n
        self._cache = _Encoded(self)
        self._split = regex.compile(PRE_TOKEN)

    def stays_apart(self, a: int, b: int) -> bool:
        """Whether BPE over the bytes of tokens a and b gives [a, b].

        Undoes their merges, the latest first, and asks each time whether the two parts that meet at
        the boundary would have merged before that. Of equal merges the left one comes first.
        """
        merged, order, limit = self.merged, self.order, 1 << 60
        while True:
            m = merged.get((a, b))
            if m is not None and order[m] < limit:
                return False
            if order[a] > order[b]:
                limit = order[a]
                a = self.parts[a][1]
            elif order[b] >= 0:
                limit = order[b] + 1
                b = self.parts[b][0]
            else:
                return True

    def last_token(self, data: bytes, end: int, last: list[int]) -> int:
        """The unique token that ends the encoding of ``data[:end]``, given that of all shorter prefixes."""
        ids = self.ids
        for start in range(max(0, end - self.longest), end):
            t = ids.get(data[start:end])
            if t is not None and t in self.order and (start == 0 or self.stays_apart(last[start], t)):
                return t
        raise ValueError("the vocabulary lacks a byte")

    def extend(self, data: bytes, last: list[int]) -> None:
        """Add to ``last`` the last tokens of the prefixes of ``data`` that it lacks (an exact append)."""
        if not last:
            last.append(-1)
        for end in range(len(last), len(data) + 1):
            last.append(self.last_token(data, end, last))

    def walk_back(self, last: list[int]) -> tuple[int, ...]:
        out, at = [], len(last) - 1
        while at > 0:
            out.append(last[at])
            at -= len(self.tokens[last[at]])
        return tuple(reversed(out))

    def encode_bytes(self, data: bytes) -> tuple[int, ...]:
        """Tokens of one pre-token."""
        t = self.ids.get(data)
        if t is not None and len(data) == 1:
            return (t,)
        last: list[int] = []
        self.extend(data, last)
        return self.walk_back(last)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text, without special tokens; none for an empty or null one."""
        return list(chain.from_iterable(map(self._cache.__getitem__, self._split.findall(text)))) if text else []

    def count(self, text: str | None) -> int:
        """How many ids ``encode`` gives."""
        return sum(map(len, map(self._cache.__getitem__, self._split.findall(text)))) if text else 0

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.tokens[i] for i in ids).decode("utf-8", "replace")


class _Encoded(dict):
    def __init__(self, bpe: PrefixBpe) -> None:
        super().__init__()
        self.bpe = bpe

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.bpe.encode_bytes(word.encode("utf-8", "replace"))
        if len(word) <= 64:
            if len(self) >= CACHED_PRE_TOKENS:
                self.clear()
            self[word] = ids
        return ids


class EditableEncoding:
    """A text with its ids that follows appends and edits by re-encoding near them only."""

    def __init__(self, bpe: PrefixBpe, text: str = "") -> None:
        self.bpe, self.text = bpe, text
        self.pieces = bpe._split.findall(text)

    @property
    def ids(self) -> list[int]:
        return list(chain.from_iterable(map(self.bpe._cache.__getitem__, self.pieces)))

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> int:
        """Put ``new`` in place of text[start:end]; returns how many pre-tokens were matched anew.

        A pre-token that ends two before ``start`` was decided by characters that stay (white space
        gives back one character and looks one ahead), so matching restarts behind the last such one. Behind the edit the old
        pre-tokens hold from the first boundary that old and new text share.
        """
        at, kept = 0, 0
        for p in self.pieces:
            if at + len(p) + 1 >= start:
                break
            at, kept = at + len(p), kept + 1
        restart, shift = at, len(new) - (end - start)
        later: dict[int, int] = {}
        for n in range(kept, len(self.pieces)):
            if at >= end:
                later[at + shift] = n
            at += len(self.pieces[n])
        self.text = self.text[:start] + new + self.text[end:]
        fresh, at = [], restart
        for m in self.bpe._split.finditer(self.text, restart):
            if m.start() in later and m.start() >= start + len(new):
                self.pieces[kept : later[m.start()]] = fresh
                return len(fresh)
            fresh.append(m.group())
        self.pieces[kept:] = fresh
        return len(fresh)


_encoders: dict[str, PrefixBpe] = {}


def load_encoder(vocabulary: bytes) -> PrefixBpe:
    """The encoder of a vocabulary, made once a process."""
    key = hashlib.sha1(vocabulary).hexdigest()
    if key not in _encoders:
        _encoders[key] = PrefixBpe(vocabulary)
    return _encoders[key]


def load_vocabulary(df: DataFrame, name: str, folder: str | None):
    with open(tokenizer_path(name, folder), "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())  # 1.6 MB, whatever the data


def encode_column(df: DataFrame, text: str = "text", *, ids: str = "ids", keep: list[str] | None = None, vocabulary: str = "byte_bpe_50k.json", folder: str | None = None, count_only: bool = False) -> DataFrame:
    """Kept columns and ``ids`` ARRAY<INT> of each text (``count_only``: their number, INT).

    Null and empty texts give an empty list (0). Rows are neither dropped nor merged; a kept column
    named like ``ids`` is replaced. Whole texts of any length are encoded; no shuffle.
    """
    kept = [c for c in (keep if keep is not None else df.columns) if c != ids]
    held = load_vocabulary(df, vocabulary, folder)
    kind = "int" if count_only else "array<int>"
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept), f"`{ids}` {kind}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load_encoder(held.value)
        find, get = bpe._split.findall, bpe._cache.__getitem__
        for b in batches:
            flat, ends = array("i"), array("i", [0])
            for t in b.column(0):
                t = t.as_py()
                if t:
                    flat.extend(chain.from_iterable(map(get, find(t))))
                ends.append(len(flat))
            offsets = pa.array(ends, pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], lists.value_lengths() if count_only else lists], names=[*kept, ids])

    return df.select(df[f"`{text}`"].alias("__text"), *[df[f"`{c}`"] for c in kept]).mapInArrow(run, schema)
