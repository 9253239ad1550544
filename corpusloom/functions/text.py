"""Text expressions. All of them are Spark columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters at which text is split into tokens (Unicode white space and the
# four ASCII separators), as a Java character class.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def tokens(text: Column) -> Column:
    """Lower-cased tokens between white space; punctuation is kept, empty tokens are not."""
    return F.array_remove(F.split(F.lower(text), SPACE + "+"), "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def content_key(text: Column) -> Column:
    return F.sha2(text, 256)


def sentences(text: Column) -> Column:
    """Non-empty sentences, cut at full stops, question and exclamation marks and line ends."""
    parts = F.transform(F.split(text, r"[.!?\n]+"), strip)
    return F.array_remove(parts, "")


def two_decimals(value: Column) -> Column:
    """Two decimals, rounded as C's printf does (format_string would round half up)."""
    return F.replace(F.format_number(value, 2), F.lit(","), F.lit(""))


# Fixed value: characters that count as one token.
CHARS_PER_TOKEN = 4


def token_estimate(characters: Column) -> Column:
    """Four characters a token, rounded down after the sum."""
    return F.floor(characters / CHARS_PER_TOKEN).cast("bigint")


def is_valid_input(text: Column) -> Column:
    """Non-empty; white space alone is valid."""
    return text.isNotNull() & (text != "")


def covered_share(wanted: Column, given: Column) -> Column:
    """Share of the distinct tokens of ``wanted`` that occur in the token array ``given``."""
    distinct = F.array_distinct(wanted)
    return F.try_divide(F.size(F.array_intersect(distinct, given)).cast("double"), F.size(distinct))
