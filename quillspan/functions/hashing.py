"""Row keys: a 40-letter form of SHA-1, as an expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the second letters of a pair, by the digest byte's multiple of 26.
_SECOND = "acegikmoqs"


def _pair(byte: int) -> str:
    """Letters of a digest byte: 0 counts as 255, bytes above 127 as one less."""
    x = 255 if byte == 0 else byte - 1 if byte > 127 else byte
    return chr(97 + x % 26) + _SECOND[x // 26]


def row_key(value: Column) -> Column:
    """40 letters for any string; an empty string for null. Runs in the JVM."""
    pairs = F.create_map(*[F.lit(v) for b in range(256) for v in (f"{b:02x}", _pair(b))])
    # The digest's bytes as pairs of hex digits: cut once, so the digest is made once.
    letters = F.transform(F.regexp_extract_all(F.sha1(F.encode(value, "UTF-8")), F.lit("(..)"), F.lit(1)), lambda h: F.element_at(pairs, h))
    return F.when(value.isNull(), F.lit("")).otherwise(F.array_join(letters, ""))


def encode_key(value: Column) -> Column:
    """File-name form of a key: letters, digits and ``-`` stay, any other character is ``_`` and its hex code."""
    return F.array_join(F.transform(F.split(value, ""), lambda c: F.when(c.rlike("^[A-Za-z0-9-]$") | (c == ""), c).otherwise(F.concat(F.lit("_"), F.lower(F.lpad(F.hex(F.ascii(c)), F.greatest(F.lit(2), F.length(F.hex(F.ascii(c)))), "0"))))), "")


def decode_key(value: Column) -> Column:
    """The key of a file-name form whose codes have two digits, as those of characters up to U+00FF have.

    Longer codes are not told from digits that follow, so keys with other characters do not come back.
    """
    parts = F.split(value, "(?=_[0-9a-f]{2})", -1)
    one = lambda p: F.when(p.rlike("^_[0-9a-f]{2}"), F.concat(F.char(F.conv(F.substring(p, 2, 2), 16, 10).cast("int")), F.substring(p, F.lit(4), F.length(p)))).otherwise(p)
    return F.array_join(F.transform(parts, one), "")
