"""JSON functions on text; JSON that isn't valid gives NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import as_column

__all__ = ["json_get", "json_get_text", "json_extract_path", "json_extract_path_text", "json_array_length", "json_build_object", "json_build_array", "json_typeof", "json_object", "to_json"]


def _path(keys: tuple[str | int, ...]) -> str:
    return "$" + "".join(f"[{k}]" if isinstance(k, int) else f"['{k}']" for k in keys)


def json_extract_path(j: Column, *keys: str | int) -> Column:
    """JSON text of what stands there (strings stay quoted); NULL if nothing or null does."""
    found = F.try_variant_get(F.try_parse_json(j), _path(keys), "variant")
    text = F.to_json(found)
    return F.when(text != "null", text)


def json_extract_path_text(j: Column, *keys: str | int) -> Column:
    return F.get_json_object(j, _path(keys))


def json_get(j: Column, key: str | int) -> Column:
    """j -> key"""
    return json_extract_path(j, key)


def json_get_text(j: Column, key: str | int) -> Column:
    """j ->> key"""
    return json_extract_path_text(j, key)


def json_array_length(j: Column) -> Column:
    return F.json_array_length(j).cast("long")


def json_typeof(j: Column) -> Column:
    """object, array, string, number, boolean or null."""
    kind = F.schema_of_variant(F.try_parse_json(j))
    return (
        F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").when(kind.isNotNull(), "number")
    )


def json_build_object(*pairs: Column | str | object) -> Column:
    """From keys (strings) and values in turn; keys come sorted and NULLs stay."""
    names = sorted(zip(pairs[::2], pairs[1::2]), key=lambda p: p[0])
    return F.to_json(F.struct(*[as_column(v).alias(k) for k, v in names]), {"ignoreNullFields": "false"})


def json_build_array(*values: Column | object) -> Column:
    return F.to_json(F.array(*[as_column(v) for v in values]), {"ignoreNullFields": "false"})


def json_object(keys: Column, values: Column) -> Column:
    return F.to_json(F.map_from_arrays(keys, values))


def to_json(x: Column) -> Column:
    """JSON text of a scalar: strings quoted, other values as they print."""
    wrapped = F.to_json(F.array(x), {"ignoreNullFields": "false"})
    return F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)
