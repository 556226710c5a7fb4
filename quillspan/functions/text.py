"""Text expressions: tokens, query words, snippets. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words left out of a lexicon.
STOP_WORDS = "a an and are as at be by for from has he in is it its of on that the to was were will with".split()
#: Tags on one line, and the marks a query loses.
_QUERY_MARKS = "[.,:;!?’\"()\\-]"
_LINE_TAG = "<[^>\\n\\r\\u0085\\u2028\\u2029]*>"


def strip_tags(text: Column) -> Column:
    """Each tag that lies on one line becomes a blank."""
    return F.regexp_replace(text, _LINE_TAG, " ")


def strip_punctuation(text: Column) -> Column:
    """Everything but ASCII letters, digits and blanks becomes a blank."""
    return F.regexp_replace(text, "[^a-zA-Z0-9 ]", " ")


def tokens(text: Column) -> Column:
    """Lower-cased words of a page. A leading empty token stays (it counts in the length), trailing ones do not."""
    plain = strip_punctuation(strip_tags(F.lower(text)))
    return F.split(F.rtrim(plain), " +")


def words(text: Column) -> Column:
    """The non-empty tokens, found directly (faster than splitting and filtering)."""
    return words_of_plain(plain(text))


def plain(text: Column) -> Column:
    """Lower-cased text without tags."""
    return strip_tags(F.lower(text))


def words_of_plain(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[a-z0-9]+"), F.lit(0))


def token_count(text: Column, found: Column) -> Column:
    """Number of ``tokens``, from the plain text and its words: one more if the text starts with none."""
    return F.size(found) + F.when(text.rlike("^[a-z0-9]"), F.lit(0)).otherwise(F.lit(1))


def counted_words(plain_text: Column) -> Column:
    """STRUCT<words, n>: the words of plain text and its number of tokens; the text is gone through once."""
    return F.transform(F.array(words_of_plain(plain_text)), lambda w: F.struct(w.alias("words"), token_count(plain_text, w).alias("n")))[0]


def query_words(text: Column) -> Column:
    """Distinct raw words of a query, in order; ASCII apostrophes stay."""
    plain = F.regexp_replace(F.lower(text), _QUERY_MARKS, " ")
    return F.filter(F.array_distinct(F.split(F.trim(F.regexp_replace(plain, "\\s+", " ")), " ")), lambda w: w != "")


def snippet(page: Column, length: int = 100) -> Column:
    """The first characters of a page's text."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(page, "<[^>]*>", " "), "\\s+", " ")), 1, length)
