"""Mathematical functions; division by zero and overflow are errors in an ANSI session."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import as_column, trim

__all__ = ["ceil", "floor", "trunc", "log", "floor_div", "mod", "int_div", "to_number", "iff", "sign", "greatest", "least"]


def ceil(x: Column) -> Column:
    return F.ceil(x.cast("double")).cast("double")


def floor(x: Column) -> Column:
    return F.floor(x.cast("double")).cast("double")


def trunc(x: Column, digits: int = 0) -> Column:
    """Toward zero."""
    x = x.cast("double")
    scale = 10.0**digits
    scaled = x * scale
    whole = F.when(scaled < 0, F.ceil(scaled)).otherwise(F.floor(scaled)).cast("double")
    return F.when(F.isnan(x) | (F.abs(scaled) >= float(1 << 53)), x).otherwise(whole / scale)


def log(*args: Column | float) -> Column:
    """log(x) to base 10; log(b, x) to base b."""
    if len(args) == 1:
        return F.log10(as_column(args[0]))
    base, x = args
    return F.ln(as_column(x)) / F.ln(as_column(base))


def floor_div(a: Column, b: Column | int) -> Column:
    return F.floor(a.cast("double") / as_column(b)).cast("long")


def mod(a: Column, b: Column | int) -> Column:
    """The remainder, with the sign of a."""
    return a % as_column(b)


def int_div(a: Column, b: Column | int) -> Column:
    """Integers divided toward zero."""
    b = as_column(b)
    return ((a - a % b) / b).cast("long")


def to_number(s: Column) -> Column:
    return trim(s).cast("double")


def iff(condition: Column, yes: Column | object, no: Column | object = None) -> Column:
    return F.when(condition, as_column(yes)).otherwise(as_column(no))


def sign(x: Column) -> Column:
    return F.signum(x)


def greatest(*xs: Column) -> Column:
    """Skips NULLs."""
    return F.greatest(*xs)


def least(*xs: Column) -> Column:
    return F.least(*xs)
