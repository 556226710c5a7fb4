"""Porter's suffix stripping algorithm (1980), applied to distinct words only."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.operators.joins import join_small
from quillspan.session import materialize

#: The suffix rules of steps 2 to 4, as published.
_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def _rules(text: str) -> list[tuple[str, str]]:
    return sorted((tuple(r.split(":")) for r in text.split()), key=lambda r: -len(r[0]))


_RULES2, _RULES3, _RULES4 = _rules(_STEP2), _rules(_STEP3), sorted(_STEP4.split(), key=len, reverse=True)


def _vowels(word: str) -> list[bool]:
    out: list[bool] = []
    for i, c in enumerate(word):
        out.append(c in "aeiou" or c == "y" and i > 0 and not out[-1])
    return out


def _measure(stem: str) -> int:
    v = _vowels(stem)
    return sum(a and not b for a, b in zip(v, v[1:], strict=False))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and not _vowels(word)[-1]


def _short_end(word: str) -> bool:
    """consonant, vowel, consonant other than w, x, y at the end."""
    v = _vowels(word)
    return len(word) > 2 and not v[-3] and v[-2] and not v[-1] and word[-1] not in "wxy"


def _replace(word: str, rules: list[tuple[str, str]]) -> str:
    for suffix, new in rules:
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + new if _measure(stem) > 0 else word
    return word


@lru_cache(maxsize=100_000)
def porter(word: str) -> str:
    """The stem of a lower-case word; words of up to two letters stay."""
    if len(word) <= 2:
        return word
    for suffix, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            word = word[: -len(suffix)] + new
            break
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix) and any(_vowels(word[: -len(suffix)])):
                word = word[: -len(suffix)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif _double(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _short_end(word):
                    word += "e"
                break
    if word.endswith("y") and any(_vowels(word[:-1])):
        word = word[:-1] + "i"
    word = _replace(_replace(word, _RULES2), _RULES3)
    for suffix in _RULES4:
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                word = stem
            break
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or m == 1 and not _short_end(word[:-1]):
            word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def _stems(words: pd.Series) -> pd.Series:
    return words.map(lambda w: None if w is None else porter(w))


def stem(word: Column) -> Column:
    """The stem of a word column, null for null; Python, in Arrow batches."""
    return F.pandas_udf(_stems, "string")(word)


def with_stems(df: DataFrame, word: str, out: str = "stem", spread: list[str] | None = None) -> DataFrame:
    """``df`` with the stem of a word column: each distinct word is stemmed once and joined back, a frequent word's
    rows being spread by the ``spread`` columns."""
    vocabulary = materialize(df.select(word).where(F.col(word).isNotNull()).distinct().withColumn(out, stem(F.col(word))), "stems")
    return join_small(df, vocabulary, [word], "left", spread=spread)
