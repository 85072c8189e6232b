"""Array functions; places count from 1."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import as_column

__all__ = ["subscript", "array_length", "array_lower", "array_upper", "array_cat", "array_append", "array_prepend", "array_to_string", "string_to_array", "unnest", "generate_series"]


def subscript(a: Column, i: Column | int) -> Column:
    """NULL outside the array."""
    return F.get(a, as_column(i) - 1)


def array_length(a: Column, dimension: int = 1) -> Column:
    return F.array_size(a).cast("long")


def array_upper(a: Column, dimension: int = 1) -> Column:
    return array_length(a)


def array_lower(a: Column, dimension: int = 1) -> Column:
    return F.when(a.isNotNull(), F.lit(1).cast("long"))


def array_cat(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def array_append(a: Column, x: Column | object) -> Column:
    return F.array_append(a, as_column(x))


def array_prepend(x: Column | object, a: Column) -> Column:
    return F.array_prepend(a, as_column(x))


def array_to_string(a: Column, separator: str = ",") -> Column:
    """Skips NULLs."""
    return F.array_join(a, separator)


def string_to_array(s: Column, separator: str) -> Column:
    return F.split(s, re.escape(separator), -1)


def unnest(a: Column) -> Column:
    return F.explode(a)


def generate_series(start: int, stop: int, step: int = 1) -> Column:
    """An array of the numbers from start to stop, both included; explode it for rows."""
    if step == 0:
        raise ValueError("step size cannot equal zero")
    if (stop - start) * step < 0:
        return F.array().cast("array<bigint>")
    return F.sequence(F.lit(start).cast("long"), F.lit(stop).cast("long"), F.lit(step).cast("long"))
