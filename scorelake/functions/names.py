"""Names, identifiers and dates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values. "no-thinking" is listed by its effective part: "thinking" is tried first.
VARIANT_SUFFIXES = (
    "xhigh", "high", "medium", "low", "minimal", "max", "thinking", "reasoning",
    "nothinking", "instant", "latest",
)
ID_PATTERN = "^[a-z0-9][a-z0-9._-]*\\z"
DATE_SUFFIX = "-(20\\d{6}|20\\d{2}-\\d{2}-\\d{2})$"
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd", "yyyyMMddHHmmss")


def slug(c: Column) -> Column:
    dashed = F.regexp_replace(F.lower(c), "[^a-z0-9.]+", "-")
    return F.regexp_replace(F.regexp_replace(dashed, "-{2,}", "-"), "^[-.]+|[-.]+$", "")


def normalise(c: Column) -> Column:
    """No vendor prefix, no serving tail, lower case, everything else a dash."""
    bare = F.regexp_replace(F.regexp_replace(c, "(?s)^[^/]*/", ""), "(?s):.*$", "")
    dashed = F.regexp_replace(F.lower(bare), "[^a-z0-9]+", "-")
    return F.regexp_replace(dashed, "^-+|-+$", "")


def _next_candidate(name: Column) -> Column:
    dated = F.regexp_replace(name, DATE_SUFFIX, "")
    short = F.regexp_replace(dated, "-(" + "|".join(VARIANT_SUFFIXES) + ")$", "")
    return F.when(short == "", name).otherwise(short)


def candidates(c: Column) -> Column:
    """The name itself, then with date and variant suffixes dropped one step at a time.
    Each step removes at least one dash, so the number of dashes bounds the steps."""
    base = normalise(c)
    steps = F.sequence(F.lit(1), F.size(F.split(base, "-")))
    chain = F.aggregate(
        steps, F.array(base), lambda acc, _: F.array_append(acc, _next_candidate(F.element_at(acc, -1)))
    )
    return F.array_distinct(chain)


def run_id(*parts: Column) -> Column:
    return F.concat_ws("__", *parts)


FULL_DATE = r"^\d{4}-\d{2}-\d{2}([T ]|$)"


def parse_date(c: Column) -> Column:
    """Four plain formats, then ISO with offset; without an offset the time is UTC."""
    text = F.trim(c)
    # A text that a format can't read costs an exception: those without its signs are not tried.
    digits = text.rlike("^[0-9+-]+\\z")
    fits = lambda f: F.contains(text, F.lit("-")) if "-" in f else F.contains(text, F.lit("/")) if "/" in f else digits
    plain = [F.when(fits(f), F.try_to_timestamp(text, F.lit(f))) for f in DATE_FORMATS]
    return F.coalesce(*plain, F.when(text.rlike(FULL_DATE), text.try_cast("timestamp")))


def error_kind(c: Column) -> Column:
    """Errors that differ only in ids, numbers or bodies share a kind."""
    two = c.startswith("HTTP") | c.startswith("gave up")
    head = F.when(two, F.substring_index(c, ":", 2)).otherwise(F.substring_index(c, ":", 1))
    return F.left(F.regexp_replace(head, "\\d+(\\.\\d+)?", "N"), F.lit(120))
