"""Texts whose UTF-8 bytes, compared as unsigned numbers, are in the order of the values across all types.

A value is a letter for its rank among types, then its own order:

* numbers of all types together, exactly: sign, decimal exponent and digits without zeros at the ends. So 2^53 and 2^53 + 1 are apart, and 1, 1.0 and 1.00 are one;
* strings as they are, binary in hex, both ended so that a prefix comes first; dates and timestamps by microseconds;
* objects field by field, each by rank, name and value; arrays element by element; what ends first is less.

Of doubles that no long or decimal equals the shortest digits count. Such texts are in range bounds, plan files and scans across types: they can be written anywhere that takes text, and
value() reads those of atomic types back. Spark and DuckDB compare strings by bytes, so both order them alike.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timedelta, timezone
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The order of types where keys of several types are ordered. Numbers have one rank, and so do strings and symbols, and dates.
RANKS = {
    "minKey": "A", "null": "C", "int": "E", "long": "E", "double": "E", "decimal": "E", "string": "G", "symbol": "G", "object": "I", "array": "J", "binData": "K", "objectId": "L",
    "bool": "M", "date": "N", "timestamp": "O", "dbPointer": "P", "code": "Q", "codeWithScope": "R", "maxKey": "Z",
}

#: What ends a string, and an object or array: less than anything that could follow.
END, CLOSE = "\x00\x00", "\x01"
_NINES = ("0123456789", "9876543210")
#: Added to exponents, and to microseconds, so that none is negative.
_EXPONENT, _ZERO_TIME = 1000, 1 << 63
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def _escaped(text: Column) -> Column:
    return F.concat(F.replace(text, F.lit("\x00"), F.lit("\x00\x01")), F.lit(END))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def of_number_text(text: Column) -> Column:
    """The order of a number that is written plainly or with an exponent (E)."""

    def placed(t: Column, m: Column) -> Column:
        every = F.replace(m["mantissa"], F.lit("."))
        trimmed = F.ltrim(every, F.lit("0"))
        point = F.length(F.substring_index(m["mantissa"], ".", 1)) - F.length(every) + F.length(trimmed) + m["exponent"]
        return F.when(trimmed != "", F.concat(F.lpad((point + _EXPONENT).cast("string"), 4, "0"), F.rtrim(trimmed, F.lit("0"))))

    def number(t: Column) -> Column:
        body = F.ltrim(t, F.lit("-"))
        parts = F.struct(F.substring_index(body, "E", 1).alias("mantissa"), F.when(t.contains("E"), F.substring_index(body, "E", -1).try_cast("int")).otherwise(0).alias("exponent"))
        signed = lambda d: F.when(d.isNull(), "d").when(t.startswith("-"), F.concat(F.lit("c"), F.translate(d, *_NINES), F.lit("~"))).otherwise(F.concat(F.lit("e"), d, F.lit("!")))
        return F.when(t == "NaN", "a").when(t == "-Infinity", "b").when(t == "Infinity", "f").otherwise(let(let(parts, lambda m: placed(t, m)), signed))

    return let(text, number)


def number_text(c: Column, kind: T.DataType) -> Column:
    """A number's exact digits."""
    if not isinstance(kind, T.FractionalType) or isinstance(kind, T.DecimalType):
        return c.cast("string")

    def exact(d: Column) -> Column:
        high = F.floor(d / 2.0**64)
        low = ((d - high.cast("double") * 2.0**64) / 2048).cast("long")
        large = (high.cast("decimal(19,0)") * F.lit(Decimal(1 << 64)).cast("decimal(20,0)") + low.cast("decimal(19,0)") * 2048).cast("string")
        size = F.abs(d)
        return F.when(size < 2.0**53, d.cast("string")).when(size < 2.0**63, d.cast("long").cast("string")).when(size < 1e37, large).otherwise(d.cast("string"))

    return let(c.cast("double"), exact)


def _micros(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.DateType):
        micros = F.unix_date(c).cast("decimal(20,0)") * 86_400_000_000
    else:
        micros = F.unix_micros(c.cast("timestamp") if isinstance(kind, T.TimestampType) else F.to_utc_timestamp(c.cast("timestamp"), F.current_timezone())).cast("decimal(20,0)")
    return F.lpad((micros + F.lit(Decimal(_ZERO_TIME))).cast("decimal(20,0)").cast("string"), 20, "0")


def _value(c: Column, kind: T.DataType) -> Column:
    """What follows the letter of a value that isn't null."""
    if isinstance(kind, T.NumericType):
        return of_number_text(number_text(c, kind))
    if isinstance(kind, T.StringType):
        return _escaped(c)
    if isinstance(kind, T.BinaryType):
        return F.concat(F.hex(c), F.lit(END))
    if isinstance(kind, T.BooleanType):
        return F.when(c, "1").otherwise("0")
    if isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType):
        return _micros(c, kind)
    if isinstance(kind, T.StructType):
        return F.concat(*(_field(F.lit(f.name), encoded(c.getField(f.name), f.dataType)) for f in kind.fields), F.lit(CLOSE))
    if isinstance(kind, T.MapType):
        each = F.transform(F.map_entries(c), lambda e: _field(e["key"].cast("string"), encoded(e["value"], kind.valueType)))
        return F.concat(F.array_join(each, ""), F.lit(CLOSE))
    if isinstance(kind, T.ArrayType):
        return F.concat(F.array_join(F.transform(c, lambda x: encoded(x, kind.elementType)), ""), F.lit(CLOSE))
    raise ValueError(f"not a key's type: {kind.simpleString()}")


def _field(name: Column, value: Column) -> Column:
    return F.concat(F.substr(value, F.lit(1), F.lit(1)), _escaped(name), F.substr(value, F.lit(2)))


def rank(kind: T.DataType) -> str:
    for types, name in (((T.NumericType,), "int"), ((T.StringType,), "string"), ((T.StructType, T.MapType), "object"), ((T.ArrayType,), "array"), ((T.BinaryType,), "binData"), ((T.BooleanType,), "bool"), ((T.DateType, T.TimestampType, T.TimestampNTZType), "date")):
        if isinstance(kind, types):
            return RANKS[name]
    raise ValueError(f"not a key's type: {kind.simpleString()}")


def _of_variant(c: Column) -> Column:
    """A value whose type its row tells. Objects and arrays are in the order of their JSON text."""
    got = lambda kind: F.try_variant_get(c, "$", kind)
    told = lambda name, what: F.concat(F.lit(RANKS[name]), what)

    def by(kind: Column) -> Column:
        number = F.when(kind.isin("DOUBLE", "FLOAT"), number_text(got("double"), T.DoubleType())).otherwise(got("string"))
        return (
            F.when(kind == "VOID", RANKS["null"]).when(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), told("int", of_number_text(number)))
            .when(kind == "STRING", told("string", _escaped(got("string")))).when(kind == "BOOLEAN", told("bool", F.when(got("boolean"), "1").otherwise("0"))).when(kind == "BINARY", told("binData", F.concat(F.hex(got("binary")), F.lit(END))))
            .when(kind.isin("DATE", "TIMESTAMP", "TIMESTAMP_NTZ"), told("date", _micros(got("timestamp"), T.TimestampType())))
            .when(kind.startswith("OBJECT"), told("object", _escaped(F.to_json(c)))).when(kind.startswith("ARRAY"), told("array", _escaped(F.to_json(c))))
            .otherwise(F.raise_error(F.concat(F.lit("not a key's type: "), kind)).cast("string"))
        )

    return let(F.schema_of_variant(c), by)


def encoded(c: Column, kind: T.DataType) -> Column:
    """A value in the order across types; null is a value."""
    if isinstance(kind, T.NullType):
        return F.lit(RANKS["null"])
    own = _of_variant(c) if isinstance(kind, T.VariantType) else F.concat(F.lit(rank(kind)), _value(c, kind))
    return F.when(c.isNull(), RANKS["null"]).otherwise(own)


def of_parts(type_: Column, number: Column, text: Column, kind: T.DataType | None = None) -> Column:
    """The same for a value told by the name of its type, a number and a text, of which it has one or none. kind: the number's type. Types that can't be keys are an error."""
    letters = F.create_map(*(F.lit(x) for item in RANKS.items() for x in item if item[0] != "array"))
    letter = F.coalesce(F.try_element_at(letters, type_), F.raise_error(F.concat(F.lit("not a key's type: "), type_)).cast("string"))
    told = of_number_text(number_text(number, kind or T.DoubleType()))
    return F.concat(letter, F.when(number.isNull(), "").otherwise(told), F.when(text.isNull(), "").otherwise(_escaped(text)))


def _number(x) -> str:
    """of_number_text of a Python number: doubles of 2^53 and more by their exact digits, as there."""
    if isinstance(x, float):
        if x != x:
            return "a"
        if x in (float("inf"), float("-inf")):
            return "f" if x > 0 else "b"
        x = Decimal(int(x)) if 2.0**53 <= abs(x) < 1e37 else Decimal(repr(x))
    sign, digits, exponent = Decimal(x).as_tuple()
    plain = "".join(map(str, digits)).lstrip("0")
    if not plain:
        return "d"
    out = f"{len(plain) + exponent + _EXPONENT:04d}{plain.rstrip('0')}"
    return f"c{out.translate(str.maketrans(*_NINES))}~" if sign else f"e{out}!"


def _text(x: str) -> str:
    return x.replace("\x00", "\x00\x01") + END


def bound(kind: str, number=None, text: str | None = None) -> str:
    """of_parts() of a value in hand."""
    if kind not in RANKS or kind == "array":
        raise ValueError(f"not a key's type: {kind}")
    return RANKS[kind] + ("" if number is None else _number(number)) + ("" if text is None else _text(text))


def of_value(x) -> str:
    """encoded() of a Python value of an atomic type."""
    if x is None:
        return RANKS["null"]
    if isinstance(x, bool):
        return RANKS["bool"] + str(int(x))
    if isinstance(x, int | float | Decimal):
        return RANKS["int"] + _number(x)
    if isinstance(x, str):
        return RANKS["string"] + _text(x)
    if isinstance(x, bytes | bytearray):
        return RANKS["binData"] + bytes(x).hex().upper() + END
    if isinstance(x, date):
        at = x if isinstance(x, datetime) else datetime(x.year, x.month, x.day)
        at = (at if at.tzinfo else at.replace(tzinfo=timezone.utc)) - _EPOCH
        return f"{RANKS['date']}{at // timedelta(microseconds=1) + _ZERO_TIME:020d}"
    raise ValueError(f"not a key's type: {type(x).__name__}")


def reads_back(kind: T.DataType) -> bool:
    """Whether literal() knows the type."""
    return isinstance(kind, T.NumericType | T.StringType | T.BinaryType | T.BooleanType | T.DateType | T.TimestampType | T.TimestampNTZType)


def literal(text: str, kind: T.DataType) -> Column:
    """The value of such a text as a literal of an atomic type, so that a filter on the column itself reaches file statistics."""
    if text[:1] == RANKS["null"]:
        return F.lit(None).cast(kind)
    if text[:1] != rank(kind):
        raise ValueError(f"{text!r} is no {kind.simpleString()}")
    own = text[1:]
    if isinstance(kind, T.NumericType):
        if own[0] in "abf":
            return F.lit({"a": "NaN", "b": "-Infinity", "f": "Infinity"}[own[0]]).cast(kind)
        body = own[1:-1].translate(str.maketrans(*_NINES)) if own[0] == "c" else own[1:-1]
        value = "0" if own[0] == "d" else f"{'-' if own[0] == 'c' else ''}0.{body[4:]}E{int(body[:4]) - _EXPONENT}"
        plain = value if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType) else f"{Decimal(value):f}"
        return F.lit(plain.split(".")[0] if isinstance(kind, T.IntegralType) else plain).cast(kind)
    if isinstance(kind, T.StringType):
        return F.lit(own[: -len(END)].replace("\x00\x01", "\x00"))
    if isinstance(kind, T.BinaryType):
        return F.lit(bytes.fromhex(own[: -len(END)]))
    if isinstance(kind, T.BooleanType):
        return F.lit(own == "1")
    micros = int(own) - _ZERO_TIME
    if isinstance(kind, T.DateType):
        return F.date_from_unix_date(F.lit(micros // 86_400_000_000).cast("int"))
    at = F.timestamp_micros(F.lit(micros))
    return at if isinstance(kind, T.TimestampType) else F.from_utc_timestamp(at, F.current_timezone()).cast(kind)


def _checked(lower: tuple, upper: tuple) -> tuple[str, str]:
    """Bounds (type, number, text) in the order; those that stand the wrong way round, or whose type can't be a key, are an error."""
    low, high = bound(*lower), bound(*upper)
    if low.encode() > high.encode():
        raise ValueError(f"bounds are inverted: {lower} > {upper}")
    return low, high


def between(type_: Column, number: Column, text: Column, lower: tuple, upper: tuple, kind: T.DataType | None = None) -> Column:
    """lower <= key < upper in the order across types; bounds are (type, number, text)."""
    low, high = _checked(lower, upper)
    key = of_parts(type_, number, text, kind)
    return (key >= F.lit(low)) & (key < F.lit(high))


def between_by_types(type_: Column, number: Column, text: Column, lower: tuple, upper: tuple, kind: T.DataType | None = None) -> Column:
    """The same range by lists of types: those wholly inside, and of the bounds' own types what is on the right side of the bound."""
    low, high = _checked(lower, upper)
    key = of_parts(type_, number, text, kind)
    of = lambda wanted: type_.isin(*(k for k, r in RANKS.items() if wanted(r) and k != "array"))
    first, last = low[0], high[0]
    if first == last:
        return of(lambda r: r == first) & (key >= F.lit(low)) & (key < F.lit(high))
    ends = (of(lambda r: r == first) & (key >= F.lit(low))) | (of(lambda r: r == last) & (key < F.lit(high)))
    return ends | of(lambda r: first < r < last)
