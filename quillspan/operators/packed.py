"""Packed fields: several values in one string, one row per value with its position.

The delimiters change from row to row and inside a row; values may be quoted. The method:
quoted spans are swapped for indexed placeholders that cannot collide with the text, the rest
is split at its delimiters, the spans come back by array lookup, and positions are exploded.
Everything is a JVM expression (no Python per row).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MARK = "\ue000"
_STOP = "\ue001"
_DELIMS = r"\s,;|"
# An opening quote starts a slot; the closing one ends it. Backslash escapes and doubled quotes
# stay inside, and so does a lone quote that no delimiter follows. Possessive: no backtracking
# over long spans.
_EDGE = rf"(?=[{_DELIMS}\]]|$)"
_DOUBLE = rf'"[^"\\]*+(?:(?:\\.|""|"(?![{_DELIMS}\]]|$))[^"\\]*+)*+"{_EDGE}'
_SINGLE = rf"'[^'\\]*+(?:(?:\\.|''|'(?![{_DELIMS}\]]|$))[^'\\]*+)*+'{_EDGE}"
_SPAN = rf"(?s)(?<![^{_DELIMS}\[])(?:{_DOUBLE}|{_SINGLE})"
_NO_VALUE = r"(?:null|none|nil|nan|n/a|undefined|-)"
_VALUE = rf"(?:https?://|{_MARK}[0-9])"
# A delimiter run separates slots if a value, a bracket, a void slot or the end follows;
# otherwise it is part of the value before it.
_SEPARATOR = rf"(?i)\s++(?:[,;|]\s*+)*+|[,;|]\s*+(?:[,;|]\s*+)*+(?={_VALUE}|[\[\]\"']|{_NO_VALUE}?(?:[{_DELIMS}\]]|$))"


def split_packed(text: Column) -> Column:
    """ARRAY<STRING> of the absolute http(s) urls packed in ``text``, in order.

    Null text gives null, text without a url an empty array. Quotes, escapes, surrounding blanks
    and trailing delimiters are removed; slots without a url are dropped. Repeated values stay.
    """
    # Marks that are already in the text are doubled by a stop sign, so an index never follows them.
    safe = F.replace(text, F.lit(_MARK), F.lit(_MARK + _STOP))
    safe = F.when(safe.rlike(r"(?s)^\s*\[.*\]\s*$"), F.regexp_replace(safe, r"(?s)^\s*\[(.*)\]\s*$", "$1")).otherwise(safe)
    spans = F.regexp_extract_all(safe, F.lit(_SPAN), F.lit(0))
    gaps = F.split(safe, _SPAN, -1)
    held = F.array_join(F.transform(gaps, lambda g, i: F.when(i > 0, F.concat(F.lit(_MARK), (i - 1).cast("string"), F.lit(_STOP), g)).otherwise(g)), "")
    slots = F.split(held, _SEPARATOR, -1)
    index = lambda s: F.regexp_extract(s, rf"^{_MARK}([0-9]+){_STOP}", 1)

    def restore(slot: Column) -> Column:
        span = F.element_at(spans, index(slot).cast("int") + 1)
        body = F.substring(span, F.lit(2), F.length(span) - 2)
        body = F.when(span.startswith('"'), F.replace(body, F.lit('""'), F.lit('"'))).otherwise(F.replace(body, F.lit("''"), F.lit("'")))
        return F.when(index(slot) != "", F.regexp_replace(body, r"(?s)\\(.)", "$1")).otherwise(slot)

    clean = F.transform(slots, lambda s: F.replace(F.regexp_replace(restore(F.trim(s)), rf"^[{_DELIMS}\"'\[]+|[{_DELIMS}]+$", ""), F.lit(_MARK + _STOP), F.lit(_MARK)))
    return F.filter(clean, lambda v: v.rlike(r"(?i)^https?://[^\s]"))


def explode_packed(df: DataFrame, column: str, *, value: str = "value", position: str = "pos", split=split_packed) -> DataFrame:
    """One row per packed value; ``position`` counts from 0 within the input row.

    Rows whose field is null, empty or without a value give no row. Input columns that clash with
    the two new names are replaced by them; all others are kept. Repeated input rows each give
    their values. An empty table gives an empty table.
    """
    keep = [F.col(f"`{c}`") for c in df.columns if c not in (value, position)]
    # The outer form keeps the optimizer from splitting once more for a filter on the array's size.
    return df.select(*keep, F.posexplode_outer(split(F.col(f"`{column}`"))).alias(position, value)).where(F.col(f"`{position}`").isNotNull())


def once_per_key(df: DataFrame, key: str, order_by: list[str] | None = None) -> DataFrame:
    """One row per non-null ``key``: the least by ``order_by`` (default: all columns), so the choice
    does not depend on the order of arrival. Rows with a null key are dropped. Pre-aggregates
    before its one shuffle."""
    cols = [c for c in (order_by or df.columns) if c != key]
    rest = [c for c in df.columns if c != key and c not in cols]
    return (
        df.where(F.col(f"`{key}`").isNotNull())
        .groupBy(F.col(f"`{key}`"))
        .agg(F.min(F.struct(*[F.col(f"`{c}`") for c in cols + rest])).alias("__row"))
        .select(F.col(f"`{key}`"), *[F.col(f"__row.`{c}`").alias(c) for c in cols + rest])
        .select(*[F.col(f"`{c}`") for c in df.columns])
    )
