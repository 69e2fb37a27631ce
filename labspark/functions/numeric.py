"""Scalar number handling: decimal commas, missing tokens, guarded arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cell texts that count as missing.
MISSING_TOKENS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]

WHITESPACE = " \t\n\r\u000b\u000c "
PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(?i:inf(inity)?)$"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def missing_to_null(raw: Column) -> Column:
    return F.when(~raw.isin(MISSING_TOKENS), raw)


def plain_number(raw: Column) -> Column:
    """A DOUBLE where the stripped text is a decimal or infinite number, else NULL.

    The pattern is needed in front of the cast: Spark alone also reads ``1d``, ``1.0f`` and ``NaN``.
    """
    text = strip(raw)
    return F.when(text.rlike(PLAIN_NUMBER), text.try_cast("double"))


def as_number(raw: Column) -> Column:
    """As :func:`plain_number`, after every comma became a decimal point (``1.234,5`` stays NULL)."""
    return plain_number(F.replace(raw, F.lit(","), F.lit(".")))


def finite(number: Column) -> Column:
    """NULL instead of infinite or NaN, so that no moment ever becomes NaN."""
    return F.when(F.abs(number) < F.lit(float("inf")), number)


def is_nonfinite(number: Column) -> Column:
    return number.isNotNull() & ~F.coalesce(F.abs(number) < F.lit(float("inf")), F.lit(False))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that yields NULL on a zero divisor (ANSI mode raises otherwise)."""
    return F.try_divide(numerator, denominator)
