"""Division and rounding with the edge cases the report depends on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")


def ratio(a: Column, b: Column) -> Column:
    """``a / b`` as IEEE doubles: x/0 is a signed infinity, and an undefined result (0/0) is null.

    Spark's own ``/`` raises on a zero divisor under ANSI, ``try_divide`` gives null for x/0 as well, and
    NaN compares as larger than anything; none of these fits a rule such as "burden >= 0.3".
    """
    a, b = nan_to_null(a), nan_to_null(b)
    by_zero = F.when(a > 0, F.lit(INFINITY)).when(a < 0, F.lit(-INFINITY))
    return F.when(b == 0, by_zero).otherwise(nan_to_null(a / b))


def nan_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(float("nan")))


def round_share(c: Column) -> Column:
    """Three decimals, ties to even."""
    return F.bround(c, 3)


def plain_digits(c: Column, kind: str, decimal_mark: str = ",") -> Column:
    """A number of the SQL type ``kind`` as text without exponent: all digits of a decimal as they are, and those
    of the shortest text that stands for a double, without a fraction of zero."""
    text = c.cast("string")
    if not kind.startswith("decimal"):
        sign = F.when(text.startswith("-"), F.lit("-")).otherwise(F.lit(""))
        mantissa = F.regexp_extract(text, r"^-?([0-9.]+)", 1)
        power = F.regexp_extract(text, r"E(-?[0-9]+)$", 1).try_cast("int")
        whole, rest = F.substring_index(mantissa, ".", 1), F.regexp_extract(mantissa, r"\.([0-9]*)", 1)
        rest = F.when(rest == "0", F.lit("")).otherwise(rest)
        digits = F.concat(whole, rest)
        shifted = F.when(power < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)).otherwise(
            F.concat(F.rpad(F.substring(digits, F.lit(1), power + 1), power + 1, F.lit("0")), F.lit("."), F.substring(digits, power + 2, F.length(digits)))
        )
        plain = F.concat(sign, F.when(power.isNull(), F.concat(whole, F.lit("."), rest)).otherwise(shifted))
        text = F.when(F.regexp_like(text, F.lit(r"^-?[0-9]")), F.regexp_replace(plain, r"\.$", "")).otherwise(text)
    return F.translate(text, ".", decimal_mark)


def parsed_number(text: Column, decimal_mark: str = ".") -> Column:
    """A text as a double, null if it is no number. With a decimal comma, points may part the thousands."""
    text = F.trim(text)
    if decimal_mark == ",":
        grouped = F.regexp_like(text, F.lit(r"^[+-]?[0-9]{1,3}([.][0-9]{3})+(,[0-9]+)?$"))
        plain = F.regexp_like(text, F.lit(r"^[+-]?[0-9]+(,[0-9]*)?([eE][+-]?[0-9]+)?$"))
        text = F.when(grouped | plain, F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
    return text.try_cast("double")
