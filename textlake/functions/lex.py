"""Numbers and dates as strings whose order is that of what they stand for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDTH = 4
FORMATS = {"year": "yyyy", "month": "yyyy-MM", "day": "yyyy-MM-dd", "hour": "yyyy-MM-dd HH", "minute": "yyyy-MM-dd HH:mm", "second": "yyyy-MM-dd HH:mm:ss", "millisecond": "yyyy-MM-dd HH:mm:ss"}


def int_lex(n: Column) -> Column:
    """A whole number: its digits behind their number; negative ones complemented, behind a minus sign."""
    digits = F.translate(n.cast("string"), "-", "")
    size = F.length(digits)
    up = F.concat(F.lpad(size.cast("string"), WIDTH, "0"), digits)
    flipped = F.translate(digits, "0123456789", "9876543210").cast("decimal(38,0)") + 1  # 10 ** size less the number
    down = F.concat(F.lit("-"), F.lpad((F.lit(10**WIDTH) - size).cast("string"), WIDTH, "0"), F.lpad(flipped.cast("string"), size, F.lit("0")))
    return F.when(n >= 0, up).otherwise(down)


def lex_int(s: Column) -> Column:
    """The number that ``int_lex`` made ``s`` of."""
    negative = F.startswith(s, F.lit("-"))
    digits = F.when(negative, F.substr(s, F.lit(WIDTH + 2))).otherwise(F.substr(s, F.lit(WIDTH + 1)))
    whole = digits.cast("decimal(38,0)")
    ten = F.concat(F.lit("1"), F.repeat(F.lit("0"), F.length(digits))).cast("decimal(38,0)")
    return F.when(negative, whole - ten).otherwise(whole).cast("bigint")


def int_pad(n: Column, width: int = 10) -> Column:
    """A whole number padded with blanks on the left; longer ones stay whole."""
    s = n.cast("string")
    return F.lpad(s, F.greatest(F.length(s), F.lit(width)), F.lit(" "))


def date_lex(t: Column, precision: str = "day") -> Column:
    return F.date_format(t, FORMATS[precision])


def lex_time(s: Column) -> Column:
    """The timestamp of a string of any precision; what it lacks is the first of its kind."""
    return F.to_timestamp(F.concat(s, F.substr(F.lit("0000-01-01 00:00:00"), F.length(s) + 1)), "yyyy-MM-dd HH:mm:ss")


def lex_date(s: Column) -> Column:
    return F.to_date(lex_time(s))
