"""Normal form of values, so that 1, 1.0 and "1.00" are equal.

Plain decimals and plain words are settled natively; only what is left, such as exponents, units
and other scripts, goes to Python in Arrow batches (as nulls otherwise), whose float() and repr()
define the form.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from notewright.functions.text import strip

#: At most 15 digits in all, so that the shortest form of the double is the number as written.
_INTEGER = r"\A[+-]?[0-9]{1,15}(\.0*)?\z"
_DECIMAL = r"\A[+-]?[0-9]{1,12}\.[0-9]{1,3}\z"
_WORD = r"\A[\x20-\x2f\x3a-\x7e]+\z"
#: Numbers that are their own normal form.
_NORMAL = r"\A(?!-0\z)-?(?:0|[1-9][0-9]{0,11})(?:\.[0-9]{0,2}[1-9])?\z"
_NAMED = r"\A[+-]?(inf|infinity|nan)\z"


def number_text(x: float) -> str | None:
    """An integral number as an integer; another with trailing zeros, then a trailing point, removed."""
    if math.isnan(x):
        return None
    return str(int(x)) if x.is_integer() else repr(x).rstrip("0").rstrip(".")


def value_text(s: str | None) -> str | None:
    """The normal form of a string, stripped and in lower case."""
    s = (s or "").strip().lower()
    try:
        return number_text(float(s))
    except ValueError:
        return s or None


@F.pandas_udf(StringType())
def _value_text(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else value_text(x))


@F.pandas_udf(StringType())
def _number_text(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else number_text(float(x)))


def is_normal(x: Column) -> Column:
    """Whether x is null or a number in its normal form; false for some that are, such as long ones and words."""
    return F.coalesce(x.rlike(_NORMAL), F.lit(True))


def normalize_value(x: Column) -> Column:
    """The normal form of a string column; null for null, blank and nan."""
    s = F.lower(strip(x))
    negative = F.when(s.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    whole, part = F.regexp_extract(s, r"([0-9]+)", 1), F.regexp_extract(s, r"\.([0-9]*)", 1)
    digits = whole.try_cast("bigint").cast("string")
    integer = F.when(digits == "0", digits).otherwise(F.concat(negative, digits))
    kept = F.rtrim(part, F.lit("0"))
    decimal = F.when(kept == "", integer).otherwise(F.concat(negative, digits, F.lit("."), kept))
    plain_word = s.rlike(_WORD) & ~s.rlike(_NAMED)
    native = F.when(s == "", F.lit(None)).when(s.rlike(_INTEGER), integer).when(s.rlike(_DECIMAL), decimal).when(plain_word, s)
    settled = (s == "") | s.rlike(_INTEGER) | s.rlike(_DECIMAL) | plain_word
    return F.coalesce(native, _value_text(F.when(~settled, x)))


def normalize_number(x: Column) -> Column:
    """The normal form of a numeric column."""
    d = x.cast("double")
    integral = (d == F.floor(d)) & (F.abs(d) < 1e15)
    return F.when(integral, d.cast("bigint").cast("string")).otherwise(_number_text(F.when(~integral, d)))
