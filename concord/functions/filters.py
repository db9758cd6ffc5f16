"""Document filters: a SQL predicate, a Column, or a query document.

Query documents know $eq $ne $gt $gte $lt $lte $in $nin $exists $not $regex (of Java) $mod $size $all $elemMatch $type, $and $or $nor, and $expr.

With the schema of what is filtered, comparisons stay within a type, as documents' own queries do: a text never equals a number nor is less than one, numbers of all types compare as numbers, days with days and times with times.
An operand that isn't of the field's type matches nothing (and everything for $ne, $nin and $not). A field that holds an array matches by any of its elements, or as a whole if the operand is an array. An operand that is an object
equals objects with the same fields in the same order. A field that the schema doesn't have is missing: it equals null only, and doesn't exist. VARIANT fields, and paths into them, compare by the type that each row holds.
Columns are typed, so apart from that a field that is missing and one that is null are the same here. $expr compares values as they are.
"""

from __future__ import annotations

import json
from datetime import date, datetime
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import canonical


def condition(query: str | dict | Column, schema: T.StructType | None = None) -> Column:
    """True for the rows that pass; null (unknown) is false. schema: of the rows, by which query documents compare within types."""
    if isinstance(query, dict):
        query = compiled(query) if schema is None else typed(query, schema)
    elif isinstance(query, str):
        query = F.expr(query)
    return F.coalesce(query, F.lit(False))


def _field(name: str) -> Column:
    return F.col(".".join(f"`{part}`" for part in name.split(".")))


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def _never_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


#: Type names of query documents, and the types of columns they are.
TYPES = {
    "double": ("double", "float"), "string": ("string",), "object": ("struct", "map"), "array": ("array",), "binData": ("binary",), "bool": ("boolean",), "date": ("timestamp", "timestamp_ntz", "date"),
    "int": ("int", "smallint", "tinyint"), "long": ("bigint",), "decimal": ("decimal",), "number": ("double", "float", "int", "smallint", "tinyint", "bigint", "decimal"),
}


def _of_type(c: Column, names: str | list) -> Column:
    """Whether a value has one of the types; null is of type null. A column has one type, so this is settled before rows are read."""
    kind, out = F.regexp_extract(F.typeof(c), r"^[a-z_]+", 0), F.lit(False)
    for name in [names] if isinstance(names, str) else names:
        if name == "null":
            out = out | c.isNull()
        elif name in TYPES:
            out = out | (c.isNotNull() & kind.isin(*TYPES[name]))
        else:
            raise ValueError(f"unknown type {name}")
    return out


def _element(value: dict, item: Column) -> Column:
    """Whether an element of an array passes: by operators on itself, or by a query on its fields."""
    if value and all(k.startswith("$") for k in value):
        return _all([_one(item, o, v) for o, v in value.items()])
    return _all([_all([_one(item.getField(k), o, x) for o, x in v.items()]) if isinstance(v, dict) else _one(item.getField(k), "$eq", v) for k, v in value.items()])


def _one(c: Column, op: str, value) -> Column:
    """A comparison. A missing field is null here: it equals null, and differs from all else."""
    if op == "$regex":
        return _never_null(c.rlike(value))
    if op == "$mod":
        return _never_null(c % F.lit(value[0]) == F.lit(value[1]))
    if op == "$size":
        return _never_null(F.size(c) == F.lit(value))
    if op == "$all":
        return _all([_never_null(F.array_contains(c, F.lit(v))) for v in value])
    if op == "$elemMatch":
        return _never_null(F.exists(c, lambda item: _element(value, item)))
    if op == "$type":
        return _of_type(c, value)
    if op == "$eq":
        return c.eqNullSafe(F.lit(value))
    if op == "$ne":
        return ~c.eqNullSafe(F.lit(value))
    if op in ("$in", "$nin"):
        held = _any([c.eqNullSafe(F.lit(v)) for v in value])
        return held if op == "$in" else ~held
    if op == "$exists":
        return c.isNotNull() if value else c.isNull()
    if op == "$not":
        return ~_all([_one(c, o, v) for o, v in value.items()])
    ordered = {"$gt": c > F.lit(value), "$gte": c >= F.lit(value), "$lt": c < F.lit(value), "$lte": c <= F.lit(value)}
    if op not in ordered:
        raise ValueError(f"unknown operator {op}")
    return _never_null(ordered[op])


def _value(x) -> Column:
    """An operand of $expr: a field's path, an expression, or a value."""
    if isinstance(x, str) and x.startswith("$"):
        return _field(x[1:])
    return _expression(x) if isinstance(x, dict) else F.lit(x)


def _expression(value: dict) -> Column:
    """A comparison of fields with each other, and their combinations. Null is less than all else and equals null."""
    ((op, parts),) = value.items()
    if op in ("$and", "$or", "$not"):
        each = [_expression(p) for p in (parts if isinstance(parts, list) else [parts])]
        return _all(each) if op == "$and" else _any(each) if op == "$or" else ~each[0]
    if op in ("$add", "$subtract", "$multiply"):
        first, *rest = map(_value, parts)
        return reduce({"$add": lambda a, b: a + b, "$subtract": lambda a, b: a - b, "$multiply": lambda a, b: a * b}[op], rest, first)
    a, b = map(_value, parts)
    same = a.eqNullSafe(b)
    less = F.coalesce(a < b, a.isNull() & b.isNotNull())
    found = {"$eq": same, "$ne": ~same, "$lt": less, "$lte": less | same, "$gt": ~(less | same), "$gte": ~less}
    if op not in found:
        raise ValueError(f"unknown expression {op}")
    return found[op]


def compiled(query: dict) -> Column:
    """A query document as a condition that is never null."""
    parts = []
    for name, value in query.items():
        if name in ("$and", "$or", "$nor"):
            each = [compiled(q) for q in value]
            parts.append(_all(each) if name == "$and" else _any(each) if name == "$or" else ~_any(each))
        elif name == "$expr":
            parts.append(_expression(value))
        elif name.startswith("$"):
            raise ValueError(f"unknown operator {name}")
        elif isinstance(value, dict) and value and all(k.startswith("$") for k in value):
            parts += [_one(_field(name), op, v) for op, v in value.items()]
        else:
            parts.append(_one(_field(name), "$eq", value))
    return _all(parts)


# With a schema.


def _found(schema: T.StructType, name: str) -> tuple[Column, T.DataType] | None:
    """The value at a dotted path and its type; None if the schema has no such field. Paths go on into VARIANT values and maps."""
    column, kind = None, schema
    parts = name.split(".")
    for i, part in enumerate(parts):
        if isinstance(kind, T.StructType) and part in kind.fieldNames():
            column, kind = F.col(f"`{part}`") if column is None else column.getField(part), kind[part].dataType
        elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
            column, kind = F.try_element_at(column, F.lit(part)), kind.valueType
        elif isinstance(kind, T.VariantType):
            return F.try_variant_get(column, "$." + ".".join(parts[i:]), "variant"), kind
        else:
            return None
    return column, kind


def _class(value) -> str | None:
    """What a Python operand compares with; None if with nothing that this module knows."""
    for kinds, name in (((bool,), "bool"), ((int, float, Decimal), "number"), ((str,), "string"), ((bytes, bytearray), "binData"), ((datetime,), "date"), ((date,), "day"), ((dict,), "object"), ((list, tuple), "array")):
        if isinstance(value, kinds):
            return name
    return None


def _class_of(kind: T.DataType) -> str:
    if isinstance(kind, T.NumericType):
        return "number"
    name = canonical.type_name(kind)
    return "date" if name == "localDate" else name


def _of_variant(c: Column, value) -> Column | None:
    """A VARIANT value as an operand's type, null in rows that hold another."""
    schema, name = F.schema_of_variant(c), _class(value)
    read = {"bool": ("boolean", schema == "BOOLEAN"), "string": ("string", schema == "STRING"), "number": ("double" if isinstance(value, float) else "decimal(38,10)", schema.isin("BIGINT", "DOUBLE", "FLOAT") | schema.startswith("DECIMAL")),
            "date": ("timestamp", schema.startswith("TIMESTAMP")), "day": ("date", schema == "DATE"), "binData": ("binary", schema == "BINARY")}.get(name)
    return None if read is None else F.when(read[1], F.try_variant_get(c, "$", read[0]))


def _compared(c: Column, kind: T.DataType, op: str, value) -> Column:
    """op is =, <, <=, > or >=, of one value that isn't looked into; false where the types differ."""
    if value is None:
        held = c.isNull() | (F.schema_of_variant(c) == "VOID") if isinstance(kind, T.VariantType) else c.isNull()
        return _never_null(held) if op in ("=", "<=", ">=") else F.lit(False)
    if isinstance(kind, T.VariantType):
        if isinstance(value, dict | list | tuple):
            same = canonical.sorted_(c, kind) == canonical.sorted_(F.parse_json(F.lit(json.dumps(value))), kind)
            return _never_null(same) if op == "=" else F.lit(False)
        c = _of_variant(c, value)
        if c is None:
            return F.lit(False)
    elif isinstance(value, dict):
        if op != "=" or not isinstance(kind, T.StructType) or list(value) != kind.fieldNames():
            return F.lit(False)
        return _never_null(c.isNotNull() & _all([_compared(c.getField(f.name), f.dataType, "=", value[f.name]) for f in kind.fields]))
    elif isinstance(value, list | tuple):
        if op != "=" or not isinstance(kind, T.ArrayType):
            return F.lit(False)
        return _never_null((F.size(c) == len(value)) & _all([_compared(F.get(c, F.lit(i)), kind.elementType, "=", x) for i, x in enumerate(value)]))
    elif _class_of(kind) != _class(value):
        return F.lit(False)
    other = F.lit(value)
    return _never_null({"=": c == other, "<": c < other, "<=": c <= other, ">": c > other, ">=": c >= other}[op])


def _any_element(c: Column, kind: T.DataType, test) -> Column:
    """test of the value, or of any element of an array."""
    if isinstance(kind, T.ArrayType):
        return test(c, kind) | _never_null(F.exists(c, lambda x: test(x, kind.elementType)))
    if isinstance(kind, T.VariantType):
        inside = F.when(F.schema_of_variant(c).startswith("ARRAY"), F.try_variant_get(c, "$", "array<variant>"))
        return test(c, kind) | _never_null(F.exists(inside, lambda x: test(x, kind)))
    return test(c, kind)


_ORDERED = {"$gt": ">", "$gte": ">=", "$lt": "<", "$lte": "<="}


def _typed_one(c: Column | None, kind: T.DataType | None, op: str, value) -> Column:
    """One operator on one field; c is None for a field that isn't there."""
    if op == "$not":
        return ~_all([_typed_one(c, kind, o, v) for o, v in value.items()])
    if op in ("$ne", "$nin"):
        return ~_typed_one(c, kind, "$eq" if op == "$ne" else "$in", value)
    if op == "$in":
        return _any([_typed_one(c, kind, "$eq", v) for v in value])
    if c is None:
        known = {"$eq": value is None, "$exists": not value, "$gte": value is None, "$lte": value is None}
        return F.lit(bool(known.get(op, False)))
    if op == "$eq" or op in _ORDERED:
        return _any_element(c, kind, lambda x, t: _compared(x, t, _ORDERED.get(op, "="), value))
    if op == "$exists":
        return c.isNotNull() if value else c.isNull()
    if op == "$regex":
        text = lambda x, t: _never_null(x.rlike(value)) if isinstance(t, T.StringType) else _never_null(_of_variant(x, "").rlike(value)) if isinstance(t, T.VariantType) else F.lit(False)
        return _any_element(c, kind, text)
    if op == "$mod":
        number = lambda x, t: _never_null(x.cast("decimal(38,0)") % value[0] == value[1]) if isinstance(t, T.NumericType) else F.lit(False)
        return _any_element(c, kind, number)
    if op == "$all":
        return _all([_typed_one(c, kind, "$eq", v) for v in value])
    if op == "$type" and isinstance(kind, T.VariantType):
        names = [value] if isinstance(value, str) else value
        told = canonical.type_of(c, kind)
        return _never_null(told.isin(*[x for n in names for x in (("int", "long", "double", "decimal") if n == "number" else ("date", "day", "localDate") if n == "date" else ("int", "long") if n in ("int", "long") else (n,))]))
    if op in ("$size", "$elemMatch") and not isinstance(kind, T.ArrayType):
        return F.lit(False)
    if op == "$elemMatch":
        return _never_null(F.exists(c, lambda item: _typed_element(value, item, kind.elementType)))
    return _one(c, op, value)


def _typed_element(value: dict, item: Column, kind: T.DataType) -> Column:
    if value and all(k.startswith("$") for k in value):
        return _all([_typed_one(item, kind, o, v) for o, v in value.items()])
    fields = kind.fieldNames() if isinstance(kind, T.StructType) else []
    at = lambda k: (item.getField(k), kind[k].dataType) if k in fields else (None, None)
    return _all([_all([_typed_one(*at(k), o, x) for o, x in v.items()]) if isinstance(v, dict) and v and all(o.startswith("$") for o in v) else _typed_one(*at(k), "$eq", v) for k, v in value.items()])


def typed(query: dict, schema: T.StructType) -> Column:
    """compiled() for rows of a schema, within types."""
    parts = []
    for name, value in query.items():
        if name in ("$and", "$or", "$nor"):
            each = [typed(q, schema) for q in value]
            parts.append(_all(each) if name == "$and" else _any(each) if name == "$or" else ~_any(each))
        elif name.startswith("$"):
            parts.append(compiled({name: value}))
        else:
            c, kind = _found(schema, name) or (None, None)
            operators = isinstance(value, dict) and value and all(k.startswith("$") for k in value)
            parts += [_typed_one(c, kind, op, v) for op, v in value.items()] if operators else [_typed_one(c, kind, "$eq", value)]
    return _all(parts)
