import itertools
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from concord.functions import canonical, keys, ordering
from concord.functions.canonical import Typed
from concord.model import DST, SRC
from concord.operators import diff

DOCS = "key string, fields array<struct<name:string,ordered:string,sorted:string,type:string>>"


def docs(spark, values, key=("_id",)):
    rows = [("".join(canonical.python_text(v[k], True) for k in key), canonical.document(v)) for v in values]
    return diff.sized(spark.createDataFrame(rows, DOCS))


def found(spark, src, dst, method="ignoreOrder", **more):
    return sorted((r.id, r.field, r.details, r.cluster) for r in diff.compare(docs(spark, src), docs(spark, dst), method, **more).collect())


I = lambda n: Typed("int", n)  # noqa: E731, E741
A = {"_id": I(1), "a": I(1), "b": I(2)}
NESTED = A | {"c": {"d": I(3), "e": I(4), "f": I(5)}}
K = "i1;"


@pytest.mark.parametrize(
    "src, dst, expected",
    [
        (A, A, []),
        (A, {"_id": I(1)}, [(K, "a", "Missing", DST), (K, "b", "Missing", DST)]),
        (A, A | {"aa": I(11), "c": I(3)}, [(K, "aa", "Missing", SRC), (K, "c", "Missing", SRC)]),
        (A, {"b": I(2), "a": I(1), "_id": I(1)}, []),
        (NESTED, A | {"c": {"e": I(4), "f": I(5), "d": I(3)}}, []),
        (NESTED, NESTED | {"b": "2", "c": "cvalue"}, [(K, "b", "Mismatch : type mismatch: src=int, dst=string", DST), (K, "c", "Mismatch : type mismatch: src=object, dst=string", DST)]),
        (NESTED, NESTED | {"b": I(3), "c": {"d": I(3), "e": I(4), "f": I(4)}}, [(K, "b", "Mismatch", DST), (K, "c", "Mismatch", DST)]),
        (A | {"bb": I(5)}, A | {"e": I(7)}, [(K, "bb", "Missing", DST), (K, "e", "Missing", SRC)]),
        (A | {"arr": [I(0), I(1), I(2)]}, A | {"arr": {"0": I(0), "1": I(1), "2": I(2)}}, [(K, "arr", "Mismatch : type mismatch: src=array, dst=object", DST)]),
        (A | {"arr": [I(0), I(1)]}, A | {"arr": [I(1), I(0)]}, [(K, "arr", "Mismatch", DST)]),
        (A | {"arr": [I(0), I(1)]}, A | {"arr": [I(0), I(1), I(2)]}, [(K, "arr", "Mismatch", DST)]),
        (A | {"arr": [{"x": I(1), "y": I(2)}]}, A | {"arr": [{"y": I(2), "x": I(1)}]}, []),
        (A | {"n": None}, A, [(K, "n", "Missing", DST)]),
        (A | {"z": 0.0}, A | {"z": -0.0}, [(K, "z", "Mismatch", DST)]),
        (A | {"s": "x"}, A | {"s": Typed("symbol", "x")}, [(K, "s", "Mismatch : type mismatch: src=string, dst=symbol", DST)]),
    ],
)
def test_unordered(spark, src, dst, expected):
    assert found(spark, [src], [dst]) == expected


def test_methods(spark):
    turned = dict(reversed(A.items()))
    assert found(spark, [A], [turned], "binary") == [(K, "", diff.ORDER_ONLY, DST)]
    assert found(spark, [A], [turned], "ignoreFieldOrder") == []
    assert found(spark, [A], [A | {"b": I(9)}], "toHashedIndexKey") == [(K, "", "Mismatch", DST)]
    for a, b in itertools.combinations([I(42), Typed("long", 42), 42.0, Typed("decimal", "42")], 2):
        assert found(spark, [A | {"n": a}], [A | {"n": b}], "toHashedIndexKey")


def test_missing_and_natural(spark):
    other = A | {"_id": I(2)}
    assert found(spark, [A], []) == [(K, "", "Missing", DST)]
    assert found(spark, [], [A]) == [(K, "", "Missing", SRC)]
    assert found(spark, [A], [A, other], natural=True) == []
    assert found(spark, [], []) == []


def test_recheck_reads_the_ids_only(spark):
    src, dst = [A, A | {"_id": I(2)}], [A | {"b": I(0)}]
    ids = spark.createDataFrame([("i2;",)], "key string")
    assert found(spark, src, dst, ids=ids) == [("i2;", "", "Missing", DST)]


def test_any_order_of_arrival_gives_the_same(spark):
    values = [{"_id": I(1), "sharded": I(n)} for n in (123, 234, 345)]
    other = values[:2] + [{"_id": I(1), "sharded": I(999)}]
    results = set()
    for perm in itertools.permutations(values):
        assert found(spark, perm, values) == []
        results.add(tuple(found(spark, perm, random.Random(1).sample(other, 3))))
    assert len(results) == 1


def test_copies_of_a_key_meet_their_equals_first(spark):
    one, other = A, A | {"b": I(7)}
    assert found(spark, [one, other, one], [other, one]) == [(K, "", "Missing", DST)]
    assert found(spark, [one], [one, one, other]) == [(K, "", "Missing", SRC)] * 2


def test_sizes_and_ages(spark):
    (row,) = diff.compare(docs(spark, [A]), docs(spark, [A | {"b": "longer text"}])).collect()
    assert row.data_size > 20
    now = F.timestamp_millis(F.lit(100_000))
    rows = diff.compare(docs(spark, [A, A | {"_id": I(2)}]), docs(spark, []))
    prior = spark.createDataFrame([(K, 40)], "id string, s long").select("id", F.timestamp_seconds("s").alias("first_mismatch_time"))
    aged = {r.id: r.duration_ms for r in diff.aged(rows, now, prior).collect()}
    assert aged == {K: 60_000, "i2;": 0}


def test_document_keys(spark):
    frame = spark.createDataFrame(
        [("abc", ({"baz": 1},), None), ("ccc", (None,), None)], "`_id` string, foo struct<bar:map<string,int>>, `foo.bar.baz` int"
    )
    got = frame.select(keys.path(frame.schema, "foo.bar.baz")[0]).collect()
    assert [r[0] for r in got] == [1, None]
    assert keys.path(frame.schema, "_id.x")[1].typeName() == "void"
    assert keys.with_id(["foo", "_id"]) == ["_id", "foo"]


def test_columns_agree_with_documents(spark):
    rng = random.Random(3)
    rows = lambda: [(i, rng.choice([None, 1, 2]), rng.choice(["a", "b", None])) for i in rng.sample(range(40), 30)]
    a, b = (spark.createDataFrame(rows(), "k long, x int, y string") for _ in range(2))
    plain = sorted((f"l{r.k};", r.field, r.details, r.cluster) for r in diff.compare_columns(a, b, ["k"]).collect())
    typed = sorted((r.id, r.field, r.details.split(" :")[0], r.cluster) for r in diff.compare(diff.documents(a, ["k"]), diff.documents(b, ["k"])).collect())
    assert plain == typed


@pytest.mark.parametrize("kind", ["struct<a:int,b:array<string>>", "map<string,int>", "array<double>", "decimal(10,2)", "binary", "date", "timestamp"])
def test_canonical_of_types(spark, kind):
    frame = spark.createDataFrame([(None,)], f"c {kind}")
    kind = frame.schema["c"].dataType
    assert frame.select(canonical.ordered(F.col("c"), kind), canonical.sorted_(F.col("c"), kind)).first()[0] == "z;"


def test_sort_key(spark):
    rows = [("null", None, None), ("long", 5.0, None), ("double", 4.5, None), ("symbol", None, "a"), ("string", None, "b"), ("bool", None, "true"), ("maxKey", None, None)]
    frame = spark.createDataFrame(rows, "t string, n double, s string").select("t", ordering.of_parts(F.col("t"), F.col("n"), F.col("s")).alias("k"))
    assert [r.t for r in frame.orderBy("k").collect()] == ["null", "double", "long", "symbol", "string", "bool", "maxKey"]


def test_a_rows_text_is_that_of_its_fields(spark):
    frame = spark.createDataFrame([(1, None, (2, "x"), [1.0], "é"), (2, "s", None, None, None)], "abc long, b string, longer_name struct<y:int,x:string>, d array<double>, e string")
    for missing in (False, True):
        fields = canonical.fields_of(frame.schema, missing)
        for r in frame.select(canonical.row_text(frame.schema, False, missing), canonical.ordered_text(fields), canonical.row_text(frame.schema, True, missing), canonical.sorted_text(fields)).collect():
            assert r[0] == r[1] and r[2] == r[3]


def test_null_keys_meet(spark):
    rows = [(None, 1, "a"), (1, None, "b"), (None, None, "c"), (0, 0, "d"), (0, 1, "e")]
    src = spark.createDataFrame(rows, "a long, b int, v string")
    assert diff.compare_columns(src, src, ["a", "b"]).count() == 0
    dst = spark.createDataFrame([(None, 1, "x"), (1, None, "b"), (0, 0, "d"), (0, 1, "e"), (None, 0, "n")], "a long, b int, v string")
    got = {(r.a, r.b, r.field, r.details, r.cluster) for r in diff.compare_columns(src, dst, ["a", "b"]).collect()}
    assert got == {(None, 1, "v", "Mismatch", "dstClient"), (None, None, "", "Missing", "dstClient"), (None, 0, "", "Missing", "srcClient")}


def test_keys_of_other_types_that_are_null(spark):
    from datetime import date, datetime
    from decimal import Decimal

    for kind, value in (("string", "x"), ("date", date(2024, 1, 2)), ("timestamp", datetime(2024, 1, 2)), ("decimal(9,2)", Decimal("1.50")), ("boolean", True), ("double", 1.5)):
        frame = spark.createDataFrame([(value, 1), (None, 2)], f"k {kind}, v int")
        assert diff.compare_columns(frame, frame, ["k"]).count() == 0
        (row,) = diff.compare_columns(frame, frame.where("k is not null"), ["k"]).collect()
        assert row.k is None and row.details == "Missing"


@pytest.mark.parametrize("side", ["src", "dst"])
def test_a_key_that_repeats_is_an_error(spark, side):
    once, twice = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k long, v string")
    with pytest.raises(Exception, match="repeats"):
        diff.compare_columns(*((twice, once) if side == "src" else (once, twice)), ["k"]).collect()
    assert diff.compare_columns(once, twice, ["k"], unique=True).count() == 0


def test_tables_and_fields_give_the_same_rows(spark):
    src = spark.createDataFrame([(1, "a", 1.0, None), (2, "b", -0.0, [1]), (3, None, float("nan"), [1, 2]), (4, "d", 2.0, None)], "k long, v string, d double, a array<int>")
    dst = spark.createDataFrame([(1, 7, 1.0, None), (2, 8, 0.0, [1]), (3, None, float("nan"), [2, 1]), (5, 9, 1.0, None)], "k long, v int, d double, e array<int>")
    for absent in (False, True):
        tables = [diff.documents(x, ["k"], missing_if_null=absent) for x in (src, dst)]
        for method in ("ignoreOrder", "binary"):
            rows = [sorted(map(tuple, diff.compare(*(f(x) for x in tables), method).collect())) for f in (lambda x: x, diff.by_fields)]
            strip = lambda found: [r[:4] for r in found]
            assert strip(rows[0]) == strip(rows[1]) and len(rows[0]) > 5


LEFT = "key string, a long, b long, size int, n long"


def test_keys_that_are_dealt_to_blocks_meet_the_same_way(spark, monkeypatch):
    monkeypatch.setattr(diff, "BLOCK_BITS", 2)  # many blocks, and stretches that reach over several
    rng = random.Random(5)
    rows = []
    for k in range(12):
        for a in {rng.randrange(-(1 << 63), 1 << 63) for _ in range(rng.randrange(1, 9))}:
            for b in range(rng.randrange(1, 3)):
                rows.append((f"k{k}", a, b, rng.randrange(9), rng.choice([-1, 1]) * rng.choice([1, 2, 3, 17])))
    left = spark.createDataFrame(rows, LEFT)
    for natural in (False, True):
        told = [sorted(map(repr, diff.paired(left, natural, dealt).collect())) for dealt in (None, 20, 0)]
        assert told[0] == told[1] == told[2] and told[0]
    # Against lines that are walked in Python.
    expected = []
    for k in {r[0] for r in rows}:
        lines = [[r[1:4] for r in sorted(rows) if r[0] == k and (r[4] > 0) == side for _ in range(abs(r[4]))] for side in (True, False)]
        expected += [(k, *met) for met in itertools.zip_longest(*lines)]
    got = [(r.key, r.s and tuple(r.s), r.d and tuple(r.d)) for r in diff.paired(left, False, 0).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, expected))


def test_hot_keys_are_looked_for_where_left_over_documents_are_written(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(diff, "DEALT", 8)
    written = []

    def settle(df, name):
        written.append(name)
        df.write.parquet(str(tmp_path / str(len(written))))
        return spark.read.parquet(str(tmp_path / str(len(written))))

    rows = lambda n, side: spark.range(n).select(F.lit("k").alias("key"), F.concat(F.lit(side), F.col("id").cast("string")).alias("ordered")).withColumn("sorted", F.col("ordered"))
    for n, expected in ((0, None), (3, None), (30, 8)):
        left = diff.left_over(rows(n, "s"), rows(n // 2, "d"), diff.Method.HASH)
        assert diff._looked_at(left, settle)[1] == expected
    told = [sorted(map(tuple, diff.compare(rows(30, "s"), rows(11, "d"), "toHashedIndexKey", **more).collect())) for more in ({}, {"settle": settle}, {"hot": 8})]
    assert told[0] == told[1] == told[2] and len(told[0]) == 30


def test_a_key_with_very_many_differing_copies_is_many_tasks(spark):
    n = 300_000
    own = lambda side: spark.range(n).select(F.lit("k").alias("key"), F.concat(F.lit(side), F.col("id").cast("string")).alias("ordered")).withColumn("sorted", F.col("ordered"))
    kept = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        left = diff.left_over(own("s"), own("d").where("ordered < 'd5'"), diff.Method.HASH)
        tasks = diff.paired(left, False).groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"), F.count("d").alias("d"))
        by_task = tasks.collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept)
    assert sum(r.n for r in by_task) == n and sum(r.d for r in by_task) == own("d").where("ordered < 'd5'").count()
    assert len(by_task) == 4 and max(r.n for r in by_task) < n * 0.75  # five blocks of 65,536 places over four tasks


def test_documents_that_differ_are_fetched_once_a_side(spark, tmp_path):
    make = lambda n, v: spark.range(40).select(F.col("id").alias("_id"), F.when(F.col("id") % 4 == 0, v).otherwise("a").alias("v")).write.parquet(str(tmp_path / n))
    make("s", "b"), make("d", "c")
    tables = [spark.read.parquet(str(tmp_path / n)) for n in "sd"]
    variants = [t.select(F.parse_json(F.to_json(F.struct("*"))).alias("doc")) for t in tables]
    for docs in ([diff.documents(t, ["_id"]) for t in tables], [diff.variant_documents(v, ["_id"], "doc") for v in variants]):
        found = diff.compare(*docs)
        assert sorted(r.id for r in found.collect()) == sorted(f"l{i};" for i in range(0, 40, 4))
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") == 10  # four times what differs, of both sides; and each side for its documents
        assert not [line for line in plan.split("\n") if "Join" in line and "size(" in line]  # rows of differences are made once, not in a join's condition too


def test_a_variant_documents_texts_are_those_of_its_fields(spark):
    rows = ['{"b":1,"a":"ä\\"x","long name":[1,{"c":2.50}],"n":null,"o":{"y":1,"x":"z"},"d":1e3,"t":true}', "{}", '{"bb":"","c":-1}', None]
    docs = spark.createDataFrame([(r,) for r in rows], "j string").select(F.parse_json("j").alias("v"))
    fields = canonical.fields_of_variant(F.col("v"))
    for r in docs.select(canonical.variant_text(F.col("v"), False), canonical.ordered_text(fields), canonical.variant_text(F.col("v"), True), canonical.sorted_text(fields)).collect():
        assert r[0] == r[1] and r[2] == r[3]
    one = docs.where("v is not null").select(canonical.variant_text(F.col("v"), True)).first()[0]
    assert one.startswith("1:a=s3:ä\"x;1:b=l1;1:d=") and "1:n=z;" in one and "1:t=btrue;" in one and "9:long name=v" in one
    with pytest.raises(PySparkException, match="not a document: BIGINT"):
        spark.range(1).select(F.parse_json(F.lit("1")).alias("v")).select(canonical.variant_text(F.col("v"), True)).collect()
