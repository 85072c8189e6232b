"""String functions; NULL in gives NULL out unless said otherwise.  Characters are code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["as_column", "length", "trim", "ltrim", "rtrim", "substring", "split_part", "starts_with", "ends_with", "strpos", "concat", "concat_ws", "left", "right", "to_hex", "encode", "to_char", "nullif_empty", "lpad", "rpad", "text_to_bool"]

#: White space as Unicode has it, which the trimming functions take off by default.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"


def as_column(x: Column | str | int | float | None) -> Column:
    """A Column as it is, anything else as a literal."""
    return x if isinstance(x, Column) else F.lit(x)


def length(s: Column) -> Column:
    return F.length(s.cast("string")).cast("long")


def trim(s: Column, chars: str | Column = SPACES) -> Column:
    return F.btrim(s, as_column(chars))


def ltrim(s: Column, chars: str | Column = SPACES) -> Column:
    return F.ltrim(s, as_column(chars))


def rtrim(s: Column, chars: str | Column = SPACES) -> Column:
    return F.rtrim(s, as_column(chars))


def substring(s: Column, start: Column | int, n: Column | int | None = None) -> Column:
    """From the start-th character; a start below 1 counts as 1."""
    at = F.greatest(as_column(start), F.lit(1))
    return F.substring(s, at, F.lit((1 << 31) - 1) if n is None else as_column(n))


def split_part(s: Column, delimiter: str | Column, n: Column | int) -> Column:
    """The n-th field from 1; '' if there is none."""
    n = as_column(n)
    return F.when(s.isNull() | n.isNull(), F.lit(None).cast("string")).when(n < 1, F.lit("")).otherwise(F.split_part(s, as_column(delimiter), F.greatest(n, F.lit(1))))


def starts_with(s: Column, prefix: str | Column) -> Column:
    return F.startswith(s, as_column(prefix))


def ends_with(s: Column, suffix: str | Column) -> Column:
    return F.endswith(s, as_column(suffix))


def strpos(haystack: Column, needle: str | Column) -> Column:
    """Place of the first occurrence from 1; 0 if there is none."""
    return F.locate(needle, haystack).cast("long") if isinstance(needle, str) else F.call_function("position", needle, haystack).cast("long")


def concat(*parts: Column | str) -> Column:
    """Skips NULLs."""
    return F.concat_ws("", *[as_column(p).cast("string") for p in parts])


def concat_ws(separator: str | None, *parts: Column | str) -> Column:
    """Skips NULLs; a NULL separator is ''."""
    return F.concat_ws(separator or "", *[as_column(p).cast("string") for p in parts])


def left(s: Column, n: Column | int) -> Column:
    """A negative n leaves off as many characters at the other end."""
    n = as_column(n)
    return F.substring(s, F.lit(1), F.when(n < 0, F.greatest(F.length(s) + n, F.lit(0))).otherwise(n))


def right(s: Column, n: Column | int) -> Column:
    n = as_column(n)
    keep = F.when(n < 0, F.greatest(F.length(s) + n, F.lit(0))).otherwise(F.least(n, F.length(s)))
    return F.substring(s, F.length(s) - keep + 1, keep)


def lpad(s: Column, n: int, fill: str = " ") -> Column:
    return F.lpad(s, n, fill)


def rpad(s: Column, n: int, fill: str = " ") -> Column:
    return F.rpad(s, n, fill)


def to_hex(n: Column) -> Column:
    return F.lower(F.hex(n.cast("long")))


def encode(data: Column, form: str) -> Column:
    """Binary (or text as UTF-8) as 'hex', 'base64' or 'escape' text."""
    data = data.cast("binary")
    if form == "escape":
        return F.decode(data, "UTF-8")
    if form not in ("hex", "base64"):
        raise ValueError(f"unknown encoding {form}")
    return F.lower(F.hex(data)) if form == "hex" else F.base64(data)


def to_char(x: Column, form: str | None = None) -> Column:
    """Text of a value; with a form, of a date or timestamp by Spark's datetime pattern."""
    return x.cast("string") if form is None else F.date_format(x, form)


def nullif_empty(s: Column) -> Column:
    return F.nullif(s, F.lit(""))


def text_to_bool(s: Column) -> Column:
    """true, t, yes, on, 1 and their opposites, in any case; anything else is an error."""
    word = F.lower(trim(s))
    bad = F.raise_error(F.concat(F.lit("invalid input syntax for type boolean: "), s)).cast("boolean")
    return F.when(s.isNull(), F.lit(None).cast("boolean")).when(word.isin("true", "t", "yes", "y", "on", "1"), True).when(word.isin("false", "f", "no", "n", "off", "0"), False).otherwise(bad)
