"""Dynamically typed record fields: ``MAP<STRING, VARIANT>`` (O-02, O-26, O-27)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrine.functions.binding import let

_RECORD, _END = "record", "end"


def wrapped_fields(line: Column) -> Column:
    """The line parsed as one field of a small object, with a sentinel field behind it.

    Spark's JSON functions stop after the first value and ignore what follows; inside an
    object, trailing text is an error or shows as a further field.
    """
    wrapped = F.concat(F.lit(f'{{"{_RECORD}":'), line, F.lit(f',"{_END}":0}}'))
    return F.try_variant_get(F.try_parse_json(wrapped), "$", "map<string,variant>")


def wrapped_value(fields: Column) -> Column:
    """The line's JSON value as VARIANT, NULL when the line is not exactly one value."""
    whole = (F.size(fields) == 2) & F.map_contains_key(fields, _END)
    return F.when(whole, F.try_element_at(fields, F.lit(_RECORD)))


def is_object(value: Column) -> Column:
    return F.schema_of_variant(value).startswith("OBJECT")


def fields_of(value: Column) -> Column:
    """Object VARIANT to ``MAP<STRING, VARIANT>``; other kinds give NULL."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def kind(value: Column) -> Column:
    """JSON kind: string, number, boolean, null, array or object."""
    return let(
        F.schema_of_variant(value),
        lambda name: F.when(name == "STRING", "string")
        .when(name == "BOOLEAN", "boolean")
        .when(name.startswith("ARRAY"), "array")
        .when(name.startswith("OBJECT"), "object")
        .when(name == "VOID", "null")
        .when(name.isNotNull(), "number"),
    )


def text_field(fields: Column, key: str) -> Column:
    """A field's value when it is a string; NULL for absent, null or any other kind."""
    value = F.try_element_at(fields, F.lit(key))
    return F.when(kind(value) == "string", F.try_variant_get(value, "$", "string"))


def scalar_metadata(fields: Column) -> Column:
    """O-26: keep strings, numbers and booleans; drop nulls, arrays and objects."""
    return F.map_filter(fields, lambda _, v: kind(v).isin("string", "number", "boolean"))


def metadata_except(
    fields: Column, excluded: tuple[str, ...] = ("id", "image_url", "description")
) -> Column:
    """O-27: keep every field but the named ones, nulls and arrays included."""
    return F.map_filter(fields, lambda k, _: ~k.isin(*excluded))


def replace_text(fields: Column, key: str, change) -> Column:
    """Apply ``change`` to a field that is present and a string, else leave it alone."""

    def update(k: Column, v: Column) -> Column:
        text = F.try_variant_get(v, "$", "string")
        changed = change(text).cast("variant")
        return F.when((k == key) & (kind(v) == "string"), changed).otherwise(v)

    return F.transform_values(fields, update)
