"""Answer extraction and normalisation as native Columns.

NULL text is read as the empty text. Whitespace and digits are Unicode-aware.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

from rubrica.functions import fixed

_PLAIN = r"^[+-]?[0-9]+(?:\.[0-9]*)?$"
_DIGITS = rf"{fixed.D}+(?:_{fixed.D}+)*"
_FINITE = rf"^[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?$"
_INFINITE = r"(?i)^[+-]?inf(?:inity)?$"
_NAN = r"(?i)^[+-]?nan$"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(fixed.SPACE_CHARS))


def words(c: Column) -> Column:
    """Whitespace-separated words, no empty ones."""
    return F.array_remove(F.split(c, f"{fixed.S}+"), "")


def matches_any(c: Column, patterns: list[str]) -> Column:
    found = F.lit(False)
    for pattern in patterns:
        found = found | c.rlike(pattern)
    return found


def contains_any(c: Column, needles: list[str]) -> Column:
    found = F.lit(False)
    for needle in needles:
        found = found | F.contains(c, F.lit(needle))
    return found


def boxed_answer(text: Column) -> Column:
    r"""Content of the last ``\boxed{...}``, stripped; NULL if there is none."""
    found = F.regexp_extract_all(text, F.lit(fixed.BOXED), 1)
    last = F.try_element_at(found, F.lit(-1))
    return F.when(F.contains(text, F.lit("\\boxed{")), strip(last))


def after_marker(text: Column, marker: str) -> Column:
    """Text after the last ``marker`` (split left to right); NULL without the marker."""
    has = F.contains(text, F.lit(marker))
    return F.when(has, F.split_part(text, F.lit(marker), F.lit(-1)))


def marked_text(text: Column, marker: str = "####") -> Column:
    """What follows the marker without commas, stripped. Empty if the marker ends the text."""
    return strip(F.replace(strip(after_marker(text, marker)), F.lit(","), F.lit("")))


def marked_number(text: Column, markers: list[str]) -> Column:
    """First number after the first marker that is followed by one. A comma ends the number."""
    tails = [F.regexp_extract(after_marker(text, m), fixed.NUMBER, 0) for m in markers]
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in tails])


def is_json(c: Column) -> Column:
    """Whether the whole text is one JSON value.

    ``try_parse_json`` stops after the first value and accepts anything behind it. A text that
    parses both as the only array item and as the only object field has nothing behind it.
    """
    item = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    field = F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit("}")))
    starts = c.rlike(r'^\s*[\[{"\-0-9tfn]')
    return F.when(starts, item.isNotNull() & field.isNotNull()).otherwise(F.lit(False))


def json_answer(text: Column) -> Column:
    """Last flat ``{...}`` of the text as a VARIANT; NULL if none or not JSON."""
    return F.try_parse_json(last_object(text))


def last_object(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(fixed.FLAT_OBJECT), 0)
    return F.when(F.contains(text, F.lit("{")), F.try_element_at(found, F.lit(-1)))


@lru_cache(maxsize=1)
def _digits() -> tuple[str, str]:
    """Every non-ASCII decimal digit with the ASCII digit of its value."""
    found = [c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"]
    return "".join(found), "".join(str(unicodedata.digit(c)) for c in found)


def ascii_digits(c: Column) -> Column:
    source, target = _digits()
    return F.when(c.rlike(r"[^\x00-\x7f]"), F.translate(c, source, target)).otherwise(c)


def to_float(c: Column, special: bool = True) -> Column:
    """Number written in ``c`` as a double, NULL if it is not one.

    Accepts ``1_000`` and non-ASCII digits, refuses type suffixes such as ``1d``; ``special``
    also takes inf and nan.
    """
    other = ascii_digits(F.replace(c, F.lit("_"), F.lit("")))
    value = F.when(c.rlike(_PLAIN), c.try_cast("double"))
    value = value.when(c.rlike(_FINITE), other.try_cast("double"))
    if not special:
        return value
    return value.when(c.rlike(_INFINITE), c.try_cast("double")).when(c.rlike(_NAN), F.lit(float("nan")))


def without_commas(c: Column) -> Column:
    return strip(F.replace(F.replace(c, F.lit(","), F.lit("")), F.lit(" "), F.lit("")))


def normalize_number(c: Column) -> Column:
    """Number after dropping commas and spaces, NULL if it is not one."""
    return to_float(without_commas(c))


def finite_number(c: Column) -> Column:
    """Finite number written in ``c``, else NULL: inf and nan compare as text."""
    value = to_float(c, special=False)
    return F.when(c.rlike("[eE]") & (F.abs(value) == F.lit(float("inf"))), None).otherwise(value)


def same_answer(a: Column, b: Column, a_num: Column, b_num: Column) -> Column:
    """Equality of two answers without commas: both numbers, or both other text, case ignored."""
    return (
        F.when(a_num.isNotNull() & b_num.isNotNull(), a_num == b_num)
        .when(a_num.isNull() & b_num.isNull(), F.lower(a) == F.lower(b))
        .otherwise(F.lit(False))
    )


def word_overlap(wanted: Column, given: Column) -> Column:
    """Share of the distinct wanted words found in the given text, 0 without wanted words."""
    want = words(wanted)
    common = F.size(F.array_intersect(want, words(given))).cast("double")
    share = F.try_divide(common, F.size(F.array_distinct(want)).cast("double"))
    return F.coalesce(share, F.lit(0.0))
