"""Builders of the expressions that aggregation stages are made of, as Columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import canonical


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def eq(a, b) -> Column:
    """Equality in which null equals null."""
    return _c(a).eqNullSafe(_c(b))


def gt(a, b) -> Column:
    return _c(a) > _c(b)


def in_(needle, haystack) -> Column:
    """Membership in a Python list or in an array column."""
    if isinstance(haystack, Column):
        return F.coalesce(F.array_contains(haystack, _c(needle)), F.lit(False))
    return reduce(lambda a, b: a | b, (eq(needle, v) for v in haystack), F.lit(False))


def not_(a) -> Column:
    return ~_c(a)


def and_(*parts) -> Column:
    return reduce(lambda a, b: a & b, map(_c, parts), F.lit(True))


def or_(*parts) -> Column:
    return reduce(lambda a, b: a | b, map(_c, parts), F.lit(False))


def bson_size(c: Column, kind: T.DataType) -> Column:
    """Size of a value: bytes of its canonical text."""
    return F.octet_length(canonical.ordered(c, kind))


def type_of(c: Column, kind: T.DataType) -> Column:
    """Name of a value's type; of a VARIANT, that of the value it happens to hold."""
    if isinstance(kind, T.VariantType):
        return F.when(c.isNull(), F.lit("missing")).otherwise(canonical.type_of(c, kind))
    return F.when(c.isNull(), F.lit("missing")).otherwise(F.lit(canonical.type_name(kind)))


def exists(c: Column) -> Column:
    """Whether a field is there. One that get_path() gives is, if it is null; a typed column can't tell null from missing."""
    return c.isNotNull()


def merge_objects(*maps: Column) -> Column:
    """Entries of all maps; a later map's value stays."""
    names = F.array_distinct(F.flatten(F.array(*(F.map_keys(m) for m in maps))))

    def value(n):
        out = F.try_element_at(maps[0], n)
        for m in maps[1:]:
            out = F.when(F.map_contains_key(m, n), F.try_element_at(m, n)).otherwise(out)
        return out

    return F.map_from_arrays(names, F.transform(names, value))


def get_field(c: Column, name: str) -> Column:
    return c.getField(name)


def get_path(document: Column, path: str) -> Column:
    """A field of a VARIANT document, as VARIANT: null if it is missing, a VARIANT null if it is null."""
    return F.try_variant_get(document, f"$.{path}", "variant")


def object_(fields: Mapping[str, Column | tuple[Column, Column]]) -> Column:
    """A map of fields whose values share a type. A pair (condition, value) is a field that is there only where the condition holds: with a null value it stays."""
    some = []
    for name, value in fields.items():
        there, own = value if isinstance(value, tuple) else (F.lit(True), value)
        some.append(F.when(there, F.struct(F.lit(name).alias("k"), own.alias("v"))))
    return F.map_from_entries(F.array_compact(F.array(*some)))


def without(object: Column, *names: str) -> Column:
    """A map without some fields."""
    return F.map_filter(object, lambda k, v: ~k.isin(*names))


def cond(if_, then, otherwise) -> Column:
    return F.when(_c(if_), _c(then)).otherwise(_c(otherwise))


def switch(branches: Sequence[tuple], default=None) -> Column:
    """The value of the first branch whose condition holds."""
    (first, value), *rest = branches
    out = F.when(_c(first), _c(value))
    for condition, then in rest:
        out = out.when(_c(condition), _c(then))
    return out.otherwise(_c(default))


def map_(array: Column, f: Callable[[Column], Column]) -> Column:
    return F.transform(array, f)


def filter_(array: Column, f: Callable[[Column], Column], limit: int | None = None) -> Column:
    kept = F.filter(array, f)
    return kept if limit is None else F.slice(kept, 1, limit)


def slice_(array: Column, start: int, n: int | None = None) -> Column:
    """n elements from a place (from 0, or from the end if negative); with one number only, so many from the start or, if negative, the end."""
    if n is None:
        return F.slice(array, 1, start) if start >= 0 else F.slice(array, F.greatest(F.size(array) + start, F.lit(0)) + 1, -start)
    at = F.lit(start) if start >= 0 else F.greatest(F.size(array) + start, F.lit(0))
    return F.slice(array, at + 1, n)


def array_elem_at(array: Column, i: int) -> Column:
    """From 0, or from the end if negative; null beyond."""
    return F.get(array, F.lit(i) if i >= 0 else F.size(array) + i)


def subtract(a, b) -> Column:
    return _c(a) - _c(b)


def has_prefix(c, prefix) -> Column:
    return _c(c).startswith(_c(prefix))


def object_to_array(m: Column) -> Column:
    """Entries as structs k and v."""
    return F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))


def array_to_object(entries: Column) -> Column:
    return F.map_from_entries(F.transform(entries, lambda e: F.struct(e["k"], e["v"])))


def literal(x) -> Column:
    return F.lit(x)


def hashed(c: Column, kind: T.DataType) -> Column:
    """A hash of a value and its type."""
    return F.xxhash64(canonical.ordered(c, kind))


# Accumulators, for agg().


def sum_(c) -> Column:
    return F.sum(_c(c))


def push(c: Column) -> Column:
    return F.collect_list(c)


def max_(c: Column) -> Column:
    return F.max(c)


def first(c: Column, order: Column) -> Column:
    """The value of the row that an order puts first."""
    return F.min_by(c, order)


def first_n(c: Column, order: Column, n: int) -> Column:
    """Values of the first n rows; for groups that fit a task. diff.ends_of_each() does it for any."""
    return F.transform(F.slice(F.array_sort(F.collect_list(F.struct(order.alias("o"), c.alias("c")))), 1, n), lambda x: x["c"])


def top_n(c: Column, order: Column, n: int) -> Column:
    """Values of the last n rows, the last first."""
    return F.transform(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct(order.alias("o"), c.alias("c"))))), 1, n), lambda x: x["c"])


def strict_cast(c: Column, kind: str, what: str = "value") -> Column:
    """The value as another type; one that can't be is an error, null stays null."""
    tried = c.try_cast(kind)
    return F.when(c.isNotNull() & tried.isNull(), F.raise_error(F.concat(F.lit(f"{what} is not {kind}: "), c.cast("string"))).cast(kind)).otherwise(tried)
