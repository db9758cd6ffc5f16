"""Document keys: the fields that identify a document, and the order of those that share a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import canonical, ordering


def with_id(keys: Sequence[str]) -> list[str]:
    """_id first, then the others; none twice."""
    return list(dict.fromkeys(["_id", *keys]))


def path(schema: T.StructType, dotted: str) -> tuple[Column, T.DataType]:
    """The value at a dotted path. It descends objects only: a field whose own name has dots isn't found; a missing or scalar parent gives null."""
    first, *rest = dotted.split(".")
    if first not in schema.fieldNames():
        return F.lit(None).cast("string"), T.NullType()
    column, kind = F.col(f"`{first}`"), schema[first].dataType
    for name in rest:
        if isinstance(kind, T.StructType) and name in kind.fieldNames():
            column, kind = column.getField(name), kind[name].dataType
        elif isinstance(kind, T.MapType):
            column, kind = F.try_element_at(column, F.lit(name)), kind.valueType
        else:
            return F.lit(None).cast("string"), T.NullType()
    return column, kind


def key_columns(df: DataFrame, keys: Sequence[str]) -> list[Column]:
    return [path(df.schema, k)[0].alias(f"key{i}") for i, k in enumerate(keys)]


def key_text(df: DataFrame, keys: Sequence[str]) -> Column:
    """All keys as one canonical text: type-strict, null where a key is missing."""
    return F.concat(*(canonical.sorted_(*path(df.schema, k)) if not isinstance(path(df.schema, k)[1], T.NullType) else F.lit("z;") for k in keys))


def order_text(df: DataFrame, keys: Sequence[str]) -> Column:
    """All keys as one text in the order of their values, field by field."""
    return F.concat(*(ordering.encoded(*path(df.schema, k)) for k in keys))


#: Tags of the types whose values can be read back from a canonical text, and how.
_READ = {
    "i": lambda x, kind: x.try_cast(kind), "l": lambda x, kind: x.try_cast(kind), "n": lambda x, kind: x.try_cast(kind), "b": lambda x, kind: x.try_cast(kind),
    "t": lambda x, kind: F.timestamp_micros(x.try_cast("bigint")), "D": lambda x, kind: F.date_from_unix_date(x.try_cast("int")), "u": lambda x, kind: x.try_cast(kind), "x": lambda x, kind: F.unhex(x),
}


def _tag(kind: T.DataType) -> str | None:
    tag = "n" if isinstance(kind, T.DecimalType) else canonical.ATOMS.get(type(kind), ("",))[0]
    return tag if tag in (*_READ, "s") else None


def raw(text: Column, schema: T.StructType, keys: Sequence[str]) -> tuple[list[Column], Column] | None:
    """The key fields' own values, from a key text, and whether the text is of their types; None if some field's type can't be read back.

    So a recheck finds documents by plain columns, which file statistics know, before anything is encoded.
    """
    values, fits, rest = [], F.lit(True), text
    for k in keys:
        _, kind = path(schema, k)
        tag = None if isinstance(kind, T.NullType) or "." in k else _tag(kind)
        if tag is None:
            return None
        null = rest.startswith("z;")
        fits = fits & (null | rest.startswith(tag))
        if tag == "s":
            n = F.substring_index(rest.substr(F.lit(2), F.length(rest)), ":", 1)
            value, size = rest.substr(F.length(n) + 3, n.try_cast("int")), F.length(n) + n.try_cast("int") + 3
        else:
            own = F.substring_index(rest, ";", 1)
            value, size = _READ[tag](own.substr(F.lit(2), F.length(own)), kind), F.length(own) + 1
        values.append(F.when(~null, value.cast(kind)))
        rest = rest.substr(F.when(null, F.lit(3)).otherwise(size + 1), F.length(rest))
    return values, fits


def text_of_plain(value: Column, schema: T.StructType, key: str) -> Column:
    """The key text of an id that a change feed gives as plain text, by the type of the table's key. An id that isn't of that type is an error."""
    _, kind = path(schema, key)
    if isinstance(kind, T.NullType):
        return F.lit("z;")
    if isinstance(kind, T.StringType):
        return canonical.sorted_(value, kind)
    read = F.unhex(value) if isinstance(kind, T.BinaryType) else F.try_parse_json(value) if isinstance(kind, T.VariantType) else F.from_json(value, kind) if isinstance(kind, T.StructType | T.MapType | T.ArrayType) else value.try_cast(kind)
    odd = F.raise_error(F.concat(F.lit(f"a change event's {key} isn't {kind.simpleString()}: "), value)).cast(kind)
    return canonical.sorted_(F.when(value.isNotNull() & read.isNull(), odd).otherwise(read), kind)


def text_of_plain_keys(value: Column, schema: T.StructType, keys: Sequence[str]) -> Column:
    """The same for keys of several fields, which a change feed gives as a JSON object of plain texts, and for one, which it may give either way."""
    if len(keys) == 1:
        return text_of_plain(F.when(value.startswith("{"), F.coalesce(F.get_json_object(value, f"$['{keys[0]}']"), value)).otherwise(value), schema, keys[0])
    return F.concat(*(text_of_plain(F.get_json_object(value, f"$['{k}']"), schema, k) for k in keys))


def occurrence(key: str, order: Sequence[Column | str]) -> Column:
    """Place among documents of one key, from 1, in an order of the documents themselves: the same on both sides whatever order they arrive in."""
    return F.row_number().over(Window.partitionBy(key).orderBy(*order))
