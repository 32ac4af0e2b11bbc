"""Text, number and price expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from slotlake.constants import UNKNOWN


def strip(text: Column) -> Column:
    """Remove white space of any kind at both ends, full-width spaces included."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _run(letter: str, length: int) -> str:
    """What a run of a pattern letter stands for."""
    if letter == "S":
        return rf"\d{{{length}}}"
    if letter in "ML" and length > 2:
        return r"\p{L}+\.?"
    if letter in "yu":
        return r"\d{4}" if length != 2 else r"\d{2}"
    if letter == "a":
        return "[AaPp][Mm]"
    if letter == "E":
        return r"\p{L}+\.?"
    return rf"\d{{{length}}}" if length > 1 else r"\d{1,2}"


def _shape(pattern: str) -> str:
    """Regular expression of the texts a date pattern can match at all; brackets hold optional parts."""
    out = []
    for m in re.finditer(r"'((?:[^']|'')*)'|(([A-Za-z])\3*)|([^A-Za-z'])", pattern):
        quoted, letters, other = m[1], m[2], m[4]
        if letters:
            out.append(_run(letters[0], len(letters)))
        elif quoted is not None:
            out.append(re.escape(quoted.replace("''", "'") or "'"))
        else:
            out.append({"[": "(?:", "]": ")?"}.get(other, re.escape(other)))
    return "^" + "".join(out) + "$"


def parse_timestamp(text: Column, formats: Sequence[str]) -> Column:
    """First format that fits, else null.

    A format is tried only on texts of its shape: a failing parse costs an exception per row.
    """
    return F.coalesce(*[
        F.when(text.rlike(_shape(f)), F.try_to_timestamp(text, F.lit(f))) for f in formats])


def replace_values(column: Column, mapping: Mapping[str, str]) -> Column:
    """Exact replacement; values outside the mapping stay."""
    chain = None
    for old, new in mapping.items():
        chain = F.when(column == old, new) if chain is None else chain.when(column == old, new)
    return column if chain is None else chain.otherwise(column)


def to_number(column: Column) -> Column:
    """Double, or null where the text is no number."""
    return column.try_cast("double")


def average_price(low: Column, high: Column) -> Column:
    return (to_number(low) + to_number(high)) / 2


def category_text(column: Column) -> Column:
    """Text of a category; missing becomes a category of its own."""
    return F.coalesce(column.cast("string"), F.lit(UNKNOWN))


def hash_fraction(key: Column) -> Column:
    """Number in [0, 1) that depends on the key alone."""
    digits = F.substring(F.md5(key.cast("string")), 1, 8)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(4294967296.0)
