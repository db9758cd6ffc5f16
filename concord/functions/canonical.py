"""Canonical text of values, so that equality of text is equality of type and value.

Every value gets a type tag; strings carry their length, so nothing can be
mistaken for structure. ordered() keeps the fields of objects as they stand,
sorted_() puts them in the order of their names at every level; arrays always
keep their order. int, long, double and decimal never equal each other; 0.0 and -0.0 differ;
null is a value and differs from a field that isn't there. A day, a timestamp and a timestamp without zone never equal each other; timestamps count by microseconds.
Objects whose names are strings are the same as structs and as maps; maps with other keys tell the keys' type.
A VARIANT value has its own type in each row. VARIANT objects keep no order of fields.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordering import let

#: Type tag and name of the atomic types.
ATOMS: dict[type, tuple[str, str]] = {
    T.ByteType: ("i", "int"),
    T.ShortType: ("i", "int"),
    T.IntegerType: ("i", "int"),
    T.LongType: ("l", "long"),
    T.FloatType: ("d", "double"),
    T.DoubleType: ("d", "double"),
    T.StringType: ("s", "string"),
    T.BooleanType: ("b", "bool"),
    T.BinaryType: ("x", "binData"),
    T.DateType: ("D", "day"),
    T.TimestampType: ("t", "date"),
    T.TimestampNTZType: ("u", "localDate"),
    T.DayTimeIntervalType: ("w", "interval"),
    T.YearMonthIntervalType: ("m", "interval"),
}


def type_name(kind: T.DataType) -> str:
    if isinstance(kind, T.DecimalType):
        return "decimal"
    if isinstance(kind, T.StructType | T.MapType):
        return "object"
    if isinstance(kind, T.ArrayType):
        return "array"
    if isinstance(kind, T.NullType):
        return "null"
    return ATOMS[type(kind)][1]


def _text(c: Column) -> Column:
    return F.concat(F.char_length(c).cast("string"), F.lit(":"), c)


def _atom(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.DecimalType):
        tag, value = "n", c.cast("string")
    else:
        tag = ATOMS[type(kind)][0]
        if isinstance(kind, T.BinaryType):
            value = F.hex(c)
        elif isinstance(kind, T.StringType):
            value = _text(c)
        elif isinstance(kind, T.DateType):
            value = F.unix_date(c).cast("string")
        elif isinstance(kind, T.TimestampType):
            value = F.unix_micros(c).cast("string")
        elif isinstance(kind, T.FloatType):
            value = c.cast("double").cast("string")
        else:
            value = c.cast("string")
    return F.concat(F.lit(tag), value, F.lit(";"))


def _encode(c: Column, kind: T.DataType, by_name: bool) -> Column:
    if isinstance(kind, T.NullType):
        return F.lit("z;")
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name) if by_name else kind.fields
        parts = [x for f in fields for x in (F.lit(f"{len(f.name)}:{f.name}="), _encode(c.getField(f.name), f.dataType, by_name))]
        body = F.concat(F.lit("{"), *parts, F.lit("}"))
    elif isinstance(kind, T.MapType):
        entries = F.map_entries(c)
        name = lambda k: _text(k) if isinstance(kind.keyType, T.StringType) else _encode(k, kind.keyType, by_name)
        texts = F.transform(entries, lambda e: F.concat(name(e["key"]), F.lit("="), _encode(e["value"], kind.valueType, by_name)))
        body = F.concat(F.lit("{"), F.array_join(F.array_sort(texts) if by_name else texts, ""), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        body = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: _encode(x, kind.elementType, by_name)), ""), F.lit("]"))
    elif isinstance(kind, T.VariantType):
        body = _of_variant(c)
    else:
        body = _atom(c, kind)
    return F.when(c.isNull(), F.lit("z;")).otherwise(body)


#: How a variant's schema names its atomic types, what type of a column each is read as, and the type's name.
VARIANTS = {
    "BIGINT": (T.LongType(), "long"), "STRING": (T.StringType(), "string"), "BOOLEAN": (T.BooleanType(), "bool"), "DOUBLE": (T.DoubleType(), "double"), "FLOAT": (T.DoubleType(), "double"), "BINARY": (T.BinaryType(), "binData"),
    "DATE": (T.DateType(), "day"), "TIMESTAMP": (T.TimestampType(), "date"), "TIMESTAMP_NTZ": (T.TimestampNTZType(), "localDate"),
}


#: Of these the frequent ones, which are asked for first: within a lambda, branches are tried one by one and aren't compiled.
_FREQUENT = ("BIGINT", "STRING")


def _variant_text(c: Column, schema: Column) -> Column:
    def atom(name: str) -> Column:
        kind = VARIANTS[name][0]
        value = F.try_variant_get(c, "$", kind.simpleString())
        return let(value, lambda x: _atom(x, kind)) if isinstance(kind, T.StringType) else _atom(value, kind)

    whole = F.concat(F.lit("v"), let(F.to_json(c), _text), _text(schema), F.lit(";"))
    rest = F.when(schema == "VOID", "z;").when(schema.startswith("DECIMAL"), F.concat(F.lit("n"), F.try_variant_get(c, "$", "string"), F.lit(";")))
    for name in (n for n in VARIANTS if n not in _FREQUENT):
        rest = rest.when(schema == name, atom(name))
    out = F.when(schema.startswith("OBJECT"), whole)
    for name in _FREQUENT:
        out = out.when(schema == name, atom(name))
    return out.otherwise(rest.otherwise(whole))


def _variant_type(schema: Column) -> Column:
    rest = F.when(schema.isNull() | (schema == "VOID"), "null").when(schema.startswith("DECIMAL"), "decimal").when(schema.startswith("ARRAY"), "array")
    for name in (n for n in VARIANTS if n not in _FREQUENT):
        rest = rest.when(schema == name, VARIANTS[name][1])
    out = F.when(schema.startswith("OBJECT"), "object")
    for name in _FREQUENT:
        out = out.when(schema == name, VARIANTS[name][1])
    return out.otherwise(rest.otherwise(F.lower(schema)))


def _of_variant(c: Column) -> Column:
    """An atomic value has the text that a column of its type would give. An object or array has its JSON text, whose names are sorted, and its schema, which tells 1 from 1.0."""
    return let(F.schema_of_variant(c), lambda schema: _variant_text(c, schema))


def type_of(c: Column, kind: T.DataType) -> Column:
    """The name of a value's type: null has its own, and a variant that of the value it holds."""
    if not isinstance(kind, T.VariantType):
        return F.when(c.isNull(), F.lit("null")).otherwise(F.lit(type_name(kind)))
    return let(F.schema_of_variant(c), _variant_type)


def ordered(c: Column, kind: T.DataType) -> Column:
    return _encode(c, kind, False)


def sorted_(c: Column, kind: T.DataType) -> Column:
    return _encode(c, kind, True)


#: A document as the comparison sees it: its top-level fields in their order.
FIELDS = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("name", "ordered", "sorted", "type")]))


def fields_of(schema: T.StructType, missing_if_null: bool = False, source: str | None = None) -> Column:
    """The columns of a schema as a document. missing_if_null: a null column is a field that isn't there."""
    parts = []
    for f in schema.fields:
        c = F.col(f"`{f.name}`") if source is None else F.col(source).getField(f.name)
        entry = F.struct(
            F.lit(f.name).alias("name"), ordered(c, f.dataType).alias("ordered"), sorted_(c, f.dataType).alias("sorted"), type_of(c, f.dataType).alias("type")
        )
        parts.append(F.when(c.isNotNull(), entry) if missing_if_null else entry)
    return F.array_compact(F.array(*parts)) if parts else F.array().cast(FIELDS)


def _of_each_field(c: Column, made: Callable[[Column, Column, Column], Column], kind: T.ArrayType) -> Column:
    """What is made of name, canonical text and schema of each field that a variant's object has. Null is a document without fields; what holds anything else is an error."""
    odd = F.raise_error(F.concat(F.lit("not a document: "), F.schema_of_variant(c))).cast(kind)

    def entry(e: Column) -> Column:
        v = e["value"]
        return let(F.schema_of_variant(v), lambda schema: made(e["key"], F.when(v.isNull(), "z;").otherwise(_variant_text(v, schema)), schema))

    every = lambda m: F.when(c.isNull(), F.array().cast(kind)).when(m.isNull(), odd).otherwise(F.transform(F.map_entries(m), entry))
    return let(F.try_variant_get(c, "$", "map<string,variant>"), every)


def fields_of_variant(c: Column) -> Column:
    """A variant that holds an object as a document: the fields that this very row has."""
    told = lambda name, text, schema: let(text, lambda t: F.struct(name.alias("name"), t.alias("ordered"), t.alias("sorted"), _variant_type(schema).alias("type")))
    return _of_each_field(c, told, FIELDS)


def texts_of_variant(c: Column) -> Column:
    """The parts that ordered_text and sorted_text join for the same document, in the order of its fields."""
    return _of_each_field(c, lambda name, text, schema: F.concat(_text(name), F.lit("="), text), T.ArrayType(T.StringType()))


def variant_text(c: Column, by_name: bool) -> Column:
    """What ordered_text or sorted_text say of the same document."""
    parts = texts_of_variant(c)
    return F.array_join(F.sort_array(parts) if by_name else parts, "")


def row_text(schema: T.StructType, by_name: bool, missing_if_null: bool = False, source: str | None = None) -> Column:
    """What ordered_text or sorted_text say of a row as a document, by plain concatenation of its columns. source: a column that holds the row."""
    parts = []
    head = lambda f: f"{len(f.name)}:{f.name}="
    for f in sorted(schema.fields, key=head) if by_name else schema.fields:
        c = F.col(f"`{f.name}`") if source is None else F.col(source).getField(f.name)
        entry = F.concat(F.lit(head(f)), _encode(c, f.dataType, by_name))
        parts.append(F.when(c.isNotNull(), entry).otherwise("") if missing_if_null else entry)
    return F.concat(*parts) if parts else F.lit("")


def ordered_text(fields: Column) -> Column:
    return F.array_join(F.transform(fields, lambda f: F.concat(_text(f["name"]), F.lit("="), f["ordered"])), "")


def sorted_text(fields: Column) -> Column:
    return F.array_join(F.sort_array(F.transform(fields, lambda f: F.concat(_text(f["name"]), F.lit("="), f["sorted"]))), "")


def document(value: dict) -> list[tuple[str, str, str, str]]:
    """A Python dict as a document, for tables without a schema. int is long; wrap a value as Typed to name its type."""
    return [(k, python_text(v, False), python_text(v, True), python_type(v)) for k, v in value.items()]


class Typed(tuple):
    """(type name, value) of a value whose Python type doesn't tell: int, long, double, decimal, symbol, objectId, ..."""

    def __new__(cls, kind: str, value):
        return super().__new__(cls, (kind, value))


_TAGS = {"int": "i", "long": "l", "double": "d", "decimal": "n", "symbol": "y", "objectId": "o", "regex": "r", "code": "c", "minKey": "-", "maxKey": "+", "date": "t", "timestamp": "T"}


def python_type(v) -> str:
    if isinstance(v, Typed):
        return v[0]
    for kinds, name in (((bool,), "bool"), ((int,), "long"), ((float,), "double"), ((str,), "string"), ((bytes,), "binData"), ((dict,), "object"), ((list,), "array")):
        if isinstance(v, kinds):
            return name
    if v is None:
        return "null"
    raise TypeError(f"no type name for {type(v).__name__}")


def python_text(v, by_name: bool) -> str:
    if isinstance(v, Typed):
        return f"{_TAGS[v[0]]}{v[1]};"
    kind = python_type(v)
    if kind == "object":
        items = sorted(v.items()) if by_name else v.items()
        return "{" + "".join(f"{len(k)}:{k}={python_text(x, by_name)}" for k, x in items) + "}"
    if kind == "array":
        return "[" + "".join(python_text(x, by_name) for x in v) + "]"
    if kind == "string":
        return f"s{len(v)}:{v};"
    return {"bool": lambda: f"b{str(v).lower()};", "long": lambda: f"l{v};", "double": lambda: f"d{v!r};", "binData": lambda: f"x{v.hex().upper()};", "null": lambda: "z;"}[kind]()
