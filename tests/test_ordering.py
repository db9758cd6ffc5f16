import itertools
import random
from datetime import date, datetime, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.functions import canonical, keys, ordering


def texts(spark, kind, values):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r[0] for r in frame.select("i", ordering.encoded(F.col("c"), frame.schema["c"].dataType).alias("t")).orderBy("i").select("t").collect()]


NUMBERS = {
    "bigint": [0, 1, -1, 9, 10, 99, 100, -100, 2**53, 2**53 + 1, 2**53 - 1, 2**60, 2**62 + 1, -(2**53) - 1, 2**63 - 1, -(2**63)],
    "int": [5, -5, 2**31 - 1, -(2**31)],
    "double": [0.0, 0.5, -0.5, 1e-300, -1e-300, 1e300, 123.456, 2.0**53, 2.0**60, 2.0**63, 2.0**64 + 4096 * 2, 1e22, 5e-324],
    "decimal(38,10)": [Decimal("0.1"), Decimal("-0.1"), Decimal("123.4560000001"), Decimal(2**60) + Decimal("0.5"), Decimal(2**63), Decimal(2**64 + 8192), Decimal("9007199254740992.5")],
}


def test_numbers_of_all_types_are_ordered_exactly(spark):
    both = [(v, t) for kind, values in NUMBERS.items() for v, t in zip(values, texts(spark, kind, values), strict=True)]
    for (a, x), (b, y) in itertools.combinations(both, 2):
        a, b = (Decimal(repr(n)) if isinstance(n, float) and abs(n) < 2**53 else Decimal(n) if abs(n) < 1e37 else Decimal(repr(n)) for n in (a, b))
        assert (a < b, a == b) == (x.encode() < y.encode(), x == y), (a, b, x, y)
    nan, low, high = texts(spark, "double", [float("nan"), float("-inf"), float("inf")])
    assert nan < low < min(t for _, t in both) and high > max(t for _, t in both)


ATOMS = {
    "bigint": NUMBERS["bigint"], "double": [0.5, -1.25, 1e300, 3.0], "decimal(20,5)": [Decimal("1.50000"), Decimal("-3.00001"), Decimal("0.00000")], "string": ["", "a", "ab", "a\x00b", "é", "zz", "\U0001f600"],
    "binary": [b"", b"\x00", b"\x00\xff", b"\xff", b"Z\xbc"], "boolean": [False, True], "date": [date(1969, 12, 31), date(2024, 2, 29)],
    "timestamp": [datetime(1969, 12, 31, 23, 59, 59, 999999), datetime(2024, 1, 1, 0, 0, 0, 123456), datetime(2024, 1, 1, 0, 0, 0, 123999)],
}


@pytest.mark.parametrize("kind", ATOMS)
def test_atoms_read_back_and_agree_with_python(spark, kind):
    values = ATOMS[kind]
    got = texts(spark, kind, values)
    assert sorted(got, key=str.encode) == [t for _, t in sorted(zip(values, got, strict=True), key=lambda x: x[0].encode() if kind == "string" else x[0])]
    assert [ordering.of_value(v.replace(tzinfo=timezone.utc) if isinstance(v, datetime) else v) for v in values] == got
    frame = spark.createDataFrame([(v,) for v in values], f"c {kind}")
    for v, t in zip(values, got, strict=True):
        assert frame.where(F.col("c") == ordering.literal(t, frame.schema["c"].dataType)).count() == 1, (v, t)
    assert texts(spark, kind, [None]) == ["C"]


def test_ranks_nested_values_and_variants(spark):
    one = lambda kind, v: texts(spark, kind, [v])[0]
    line = [one("int", None), one("double", 1e300), one("string", "zzz"), one("struct<a:int>", (5,)), one("array<int>", [1]), one("binary", b"\xff"), one("boolean", False), one("timestamp", datetime(1970, 1, 1))]
    assert line == sorted(line, key=str.encode)
    pairs = [(1, None), (1, "a"), (1, "b"), (2, None), (None, "a")]
    got = texts(spark, "struct<x:int,y:string>", pairs)
    assert [p for _, p in sorted(zip(got, pairs, strict=True))] == [(None, "a"), (1, None), (1, "a"), (1, "b"), (2, None)]
    lists = [[], [1], [1, 2], [2], [10]]
    got = texts(spark, "array<int>", lists)
    assert got == sorted(got) and len(set(got)) == 5
    rows = ["null", "-3", "2.5", "9007199254740993", '"abc"', '"b"', '{"a":1}', "[1]", "true"]
    frame = spark.createDataFrame(list(enumerate(rows)), "i int, j string").select("i", F.parse_json("j").alias("v"))
    got = [r[0] for r in frame.select("i", ordering.encoded(F.col("v"), T.VariantType()).alias("t")).orderBy("i").select("t").collect()]
    assert got == sorted(got, key=str.encode)
    assert got[1:5] == [ordering.of_value(x) for x in (-3, Decimal("2.5"), 2**53 + 1, "abc")]


def test_types_that_cannot_be_keys_are_errors(spark):
    with pytest.raises(ValueError):
        ordering.encoded(F.lit(1), T.DayTimeIntervalType())
    with pytest.raises(ValueError):
        ordering.of_value([1])
    with pytest.raises(ValueError):
        ordering.literal("G" + ordering.END, T.LongType())


def test_canonical_texts_tell_microseconds_days_and_names_types(spark):
    row = spark.sql(
        "SELECT timestamp'2024-01-01 00:00:00.123456' a, timestamp'2024-01-01 00:00:00.123999' b, date'2024-01-01' c, timestamp'2024-01-01' d, timestamp_ntz'2024-01-01' e, map(1, 'x') f, map('1', 'x') g, named_struct('1', 'x') h, interval 1 day i"
    )
    text = row.select(*(canonical.sorted_(F.col(f.name), f.dataType).alias(f.name) for f in row.schema)).first()
    assert len({text.a, text.b, text.c, text.d, text.e}) == 5
    assert text.f != text.g and text.g == text.h and text.i.startswith("w")


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date", "bigint", "decimal(20,5)", "string", "binary", "boolean"])
def test_keys_read_back_exactly(spark, kind):
    values = ATOMS.get(kind, ATOMS["timestamp"])
    frame = spark.createDataFrame([(v,) for v in values] + [(None,)], f"k {kind}")
    told = frame.select("k", keys.key_text(frame, ["k"]).alias("key"))
    read, fits = keys.raw(F.col("key"), frame.schema, ["k"])
    assert told.where(fits & read[0].eqNullSafe(F.col("k"))).count() == len(values) + 1


def test_random_strings_keep_their_order(spark):
    rng = random.Random(1)
    values = ["".join(rng.choices("\x00\x01ab", k=rng.randint(0, 4))) for _ in range(60)]
    got = texts(spark, "string", values)
    assert all((a.encode() < b.encode()) == (x.encode() < y.encode()) for (a, x), (b, y) in itertools.combinations(zip(values, got, strict=True), 2))
