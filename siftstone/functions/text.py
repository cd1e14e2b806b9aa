"""Text columns: normalisation, tokens, ids, context strings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def squeeze(text: Column) -> Column:
    """Runs of white space to one space, trimmed; null to the empty string."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", "")


def tokens(text: Column) -> Column:
    """ASCII letters and digits, lower-cased; the same in every regex dialect."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def shingle_words(text: Column) -> Column:
    """Lower-cased words of any script without punctuation, as shingles use them."""
    clean = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}_\s\p{Z}]", "")
    return F.filter(F.split(clean, r"[\s\p{Z}]+"), lambda w: w != "")


def short_id(text: Column, length: int = 16) -> Column:
    return F.substring(F.md5(text), 1, length)


def pad_row(row: Column, width: int) -> Column:
    """Pad a row with empty strings or cut it to the header's width."""
    return F.slice(F.concat(row, F.array_repeat(F.lit(""), width)), 1, width)


def json_object(text: Column) -> Column:
    """The outermost {...} in free text, null if none."""
    found = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)


def json_array(text: Column) -> Column:
    found = F.regexp_extract(text, r"(?s)(\[.*\])", 1)
    return F.when(found != "", found)


def protocol_value(text: Column, key: str) -> Column:
    """The value of the first line ``KEY: value``, null if there is none."""
    found = F.regexp_extract(text, rf"(?m)^[ \t]*{key}:[ \t]*([^\n\r]*)", 1)
    return F.when(F.regexp_like(text, F.lit(rf"(?m)^[ \t]*{key}:")), F.trim(found))


def one_of(value: Column, allowed: Sequence[str], default: str) -> Column:
    return F.when(F.lower(value).isin(*allowed), F.lower(value)).otherwise(F.lit(default))


def truncate(text: Column, length: int) -> Column:
    return F.substring(text, 1, length)


def contains_any(text: Column, phrases: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | text.contains(p)
    return out


def matches_any(text: Column, patterns: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(p)
    return out


def numbered_context(title: Column, body: Column, score: Column, number: Column, limit: int) -> Column:
    """One numbered source of a context string."""
    return F.concat(F.lit("["), number.cast("string"), F.lit("] "), title, F.lit(" (score: "), F.format_number(score, 3), F.lit(")\n"), truncate(body, limit))


def indented(level: Column, text: Column) -> Column:
    return F.concat(F.repeat(F.lit("  "), level), text)
