"""Text normalisation as column expressions. Everything stays in the JVM: Unicode
composition and case folding call the ICU classes that ship with Spark through ``reflect``,
and only for rows that are not plain ASCII."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
ZERO_WIDTH = "\u200b\u200c\u200d\u2060\ufeff"
WHITESPACE = "[\\t-\\r\\x1c-\\x20\\x85\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
# The same signs for Java's patterns: one look at a sign's category instead of a walk through a list of ranges.
SPACES = "[\\s\\x1c-\\x1f]+"
NOT_BLANK = "(?U)[^\\s\\x1c-\\x1f]"
DEVANAGARI_DIGITS = "०१२३४५६७८९"
LATIN_DIGITS = "0123456789"
PUNCTUATION = "[\\p{P}\\u0964\\u0965\\u0970]"
SPACES_AND_PUNCTUATION = "(?U)[\\s\\x1c-\\x1f\\p{P}\\u0964\\u0965\\u0970]+"
CONSONANT = "[\\u0915-\\u0939\\u0958-\\u095f]"
MARK = "[\\u0900-\\u0903\\u093a\\u093b\\u093e-\\u094c\\u094e\\u094f\\u0951-\\u0957\\u0962\\u0963]"
VOWEL = "[\\u0904-\\u0914\\u0960\\u0961\\u0972-\\u097f]"
NUKTA, VIRAMA = "\\u093c", "\\u094d"
# One syllable: consonants joined by virama with their marks, or a vowel with its marks,
# or any other single character.
AKSHARA = (
    f"(?s)(?:{CONSONANT}{NUKTA}?{VIRAMA})*{CONSONANT}{NUKTA}?{MARK}*{VIRAMA}?"
    f"|{VOWEL}{MARK}*"
    "|."
)
LOGO_TOKEN = "[LOGO]"

UNIT_SEPARATOR = "\x1f"  # never left in canonical text: it counts as whitespace


def _is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def _icu(cls: str, method: str, c: Column, flag: bool) -> Column:
    return F.call_function("reflect", F.lit(cls), F.lit(method), c, F.lit(flag))


def nfc(c: Column) -> Column:
    return F.when(c.isNull() | _is_ascii(c), c).otherwise(
        _icu("com.ibm.icu.text.Normalizer", "compose", c, False)
    )


def casefold(c: Column) -> Column:
    return F.when(c.isNull() | _is_ascii(c), F.lower(c)).otherwise(
        _icu("com.ibm.icu.lang.UCharacter", "foldCase", c, True)
    )


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "(?U)" + SPACES, " "))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"(?U)\\A{SPACES}|{SPACES}\\z", "")


def canonical(c: Column) -> Column:
    """NFC, whitespace runs to one space, trimmed."""
    return collapse(nfc(c))


def strip_zero_width(c: Column) -> Column:
    return F.translate(c, ZERO_WIDTH, "")


def spaced(c: Column) -> Column:
    """Canonical text without zero-width characters and punctuation. A run of spaces and punctuation, however mixed,
    ends as one space: one pass over the text."""
    return F.trim(F.regexp_replace(strip_zero_width(nfc(c)), SPACES_AND_PUNCTUATION, " "))


def loose(c: Column) -> Column:
    """Canonical text without zero-width characters, punctuation and case. ``casefold`` mentions its text several times
    and Spark makes each mention anew inside lambdas: there, let it read a column or variable that holds ``spaced``."""
    return casefold(spaced(c))


def fold_digits(c: Column) -> Column:
    return F.translate(c, DEVANAGARI_DIGITS, LATIN_DIGITS)


def aksharas(c: Column) -> Column:
    """What a reader sees as one character each, as an array."""
    return F.regexp_extract_all(strip_zero_width(c), F.lit(AKSHARA), F.lit(0))


#: What a sign can be in an akshara, for the signs 0x900 to 0x97f; 0 stands alone.
_KINDS = np.zeros(129, np.uint8)  # the last place is for all other signs
_C, _N, _V, _MARK, _VIRAMA = 1, 2, 3, 4, 5
for _pattern, _kind in ((CONSONANT, _C), (VOWEL, _V), (MARK, _MARK)):
    _listed = re.compile(_pattern)
    _KINDS[[i for i in range(128) if _listed.match(chr(0x900 + i))]] = _kind
_KINDS[0x3C], _KINDS[0x4D] = _N, _VIRAMA
_ZERO_WIDTH = np.array([ord(z) for z in ZERO_WIDTH], np.uint32)


def joined_aksharas(text: str, fold: bool = False) -> str:
    """The aksharas of a text with the unit separator between them, with ``fold`` digits the Latin way. Which signs go on with the unit before them
    follows from the signs just before (and, for marks, from what their run began with), so it is told for all at once."""
    signs = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not text.isascii():
        signs = signs[~np.isin(signs, _ZERO_WIDTH)]
    if fold:
        signs = np.where((signs >= 0x966) & (signs <= 0x96F), signs - np.uint32(0x966 - 0x30), signs)
    if not len(signs):
        return ""
    kind = _KINDS[np.minimum(signs - np.uint32(0x900), 128)]  # signs below wrap around
    before = np.concatenate([np.zeros(1, np.uint8), kind[:-1]])
    nukta = (kind == _N) & (before == _C)
    # A consonant with or without nukta, or a vowel, is what marks follow.
    place = np.arange(len(kind))
    head = np.maximum.accumulate(np.where(kind == _MARK, -1, place))
    led = np.where(head >= 0, kind[head], 0)
    led = np.where((led == _N) & nukta[head], _C, led)
    mark = (kind == _MARK) & ((led == _C) | (led == _V))
    prior = lambda x: np.concatenate([np.zeros(1, x.dtype), x[:-1]])
    virama = (kind == _VIRAMA) & (prior(led) == _C)
    conjunct = (kind == _C) & prior(virama & (before != _MARK))
    goes_on = nukta | mark | virama | conjunct
    starts = np.flatnonzero(~goes_on)[1:]
    out = np.insert(signs, starts, ord(UNIT_SEPARATOR))
    return out.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def words(c: Column) -> Column:
    """Words of a canonical (already collapsed) text."""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, " "))


def clean_model_output(c: Column) -> Column:
    """Drop reasoning blocks (closed, unclosed, closing tag only), the end-of-text token and
    a code fence around the whole reply."""
    out = plain = F.coalesce(c, F.lit(""))
    for pattern in ("(?is)<think>.*?</think>", "(?is)<think>.*", "(?is)\\A.*</think>"):
        out = F.regexp_replace(out, pattern, "")
    out = F.when(plain.rlike("(?i)think>"), out).otherwise(plain)  # most replies hold no such tag
    out = F.replace(out, F.lit("<|endoftext|>"), F.lit(""))
    s = WHITESPACE
    fence = f"(?s)\\A{s}*```[a-zA-Z0-9_-]*{s}*\\n(.*?)\\n?{s}*```{s}*\\z"
    return strip(F.regexp_replace(out, fence, "$1"))


def strip_logo(c: Column) -> Column:
    """Canonical non-empty lines without the logo token, as an array."""
    lines = F.split(F.replace(c, F.lit(LOGO_TOKEN), F.lit(" ")), "\n")
    return F.filter(F.transform(lines, canonical), lambda line: line != "")


def refs_array(c: Column, is_array: bool) -> Column:
    """References as an array: NULL is no reference, a scalar is one."""
    empty = F.array().cast("array<string>")
    if is_array:
        return F.coalesce(F.transform(c, lambda v: v.cast("string")), empty)
    return F.when(c.isNull(), empty).otherwise(F.array(c.cast("string")))


def render_prompt(template: str, question: Column) -> Column:
    return F.coalesce(F.replace(F.lit(template), F.lit("{question}"), question), F.lit(template))


def prompt_hash(system: Column, prompt: Column) -> Column:
    joined = F.concat(F.coalesce(system, F.lit("")), F.decode(F.unhex(F.lit("00")), "UTF-8"), prompt)
    return F.left(F.sha2(joined, 256), F.lit(12))
