import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from concord.functions import expressions as X
from concord.functions import filters, formats, namespaces
from concord.operators import classify, metadata, partitioning, recheck, statistics


@pytest.mark.parametrize("n, parts", [(0, 3), (1, 3), (10, 3), (100, 7), (1000, 7)])
def test_bounds_and_ranks(spark, n, parts):
    keys = random.Random(n).sample(range(-5000, 5000), n)
    frame = spark.createDataFrame([(k,) for k in keys], "k long").repartition(3)
    assert {r.k: r["rank"] for r in partitioning.ranked(frame, "k").collect()} == {k: i for i, k in enumerate(sorted(keys))}
    ranges = partitioning.bounds(frame, "k", parts)
    sizes = [r.documents for r in partitioning.counts(frame, "k", ranges).orderBy("part").collect()]
    assert sum(sizes) == n and (not sizes or max(sizes) - min(sizes) <= 1)


def test_partition_arithmetic():
    assert partitioning.ideal(1000, 400) == 3 and partitioning.ideal(1000, 400, capped=True) == 1 and partitioning.ideal(0, 400) == 1
    assert partitioning.sample_rate(1000, 100, 400) == pytest.approx(1 / 40)
    assert partitioning.sample_rate(1000, 1, 400) is None


def test_sampled_bounds(spark):
    ranges = partitioning.sampled_bounds(spark.range(5000).withColumnRenamed("id", "k"), "k", 500).orderBy("part").collect()
    assert ranges[0].lower is None and ranges[-1].upper is None
    assert all(a.upper == b.lower for a, b in zip(ranges, ranges[1:], strict=False)) and 4 < len(ranges) < 30


def specs(spark, rows):
    return spark.createDataFrame(rows, "namespace string, type string, read_only boolean, options string")


@pytest.mark.parametrize(
    "src, dst, comparable, expected",
    [
        (("collection", False, "{}"), ("collection", False, "{}"), True, []),
        (("view", False, '{"a":1}'), ("collection", True, "{}"), False, [("", "type", "Mismatch: src: view, dst: collection")]),
        (("collection", False, "{}"), ("collection", True, "{}"), True, [("", "readOnly", "Mismatch: src: false, dst: true")]),
        (("collection", False, "{}"), ("collection", False, '{"capped":true,"size":5}'), False, [("spec", "options.capped", "Missing"), ("spec", "options.size", "Missing")]),
        (("collection", False, '{"collation":{"strength":1}}'), ("collection", False, '{"collation":{"strength":2}}'), True, [("spec", "options.collation", "Mismatch")]),
        (("collection", False, '{"a":1,"b":2}'), ("collection", False, '{"b":2,"a":1}'), True, [("spec", "options (field order only)", "Mismatch")]),
        (("view", False, "{}"), ("view", False, "{}"), False, []),
        (("timeseries", False, "{}"), ("timeseries", False, "{}"), True, []),
    ],
)
def test_specs(spark, src, dst, comparable, expected):
    got = metadata.compare_specs(specs(spark, [("db.a", *src)]), specs(spark, [("db.a", *dst)]))
    assert got.first().comparable == comparable
    assert sorted((r.id, r.field, r.details) for r in metadata.rows(got).collect()) == expected


def test_spec_of_one_side_and_unknown_type(spark):
    one = metadata.compare_specs(specs(spark, [("db.a", "collection", False, "{}")]), specs(spark, []))
    assert [(r.field, r.details, r.cluster) for r in metadata.rows(one).collect()] == [("", "Missing", "dstClient")]
    with pytest.raises(PySparkException):
        metadata.compare_specs(specs(spark, [("db.a", "odd", False, "{}")]), specs(spark, [])).collect()


def indexes(spark, *rows):
    return spark.createDataFrame([("db.a", n, s) for n, s in rows], "namespace string, name string, spec string")


def test_indexes(spark):
    src = indexes(spark, ("x_1", '{"v":2,"key":{"x":1}}'), ("ttl", '{"key":{"t":1},"expireAfterSeconds":123,"unique":true}'), ("f", '{"key":{"foo":1}}'), ("ab", '{"key":{"a":1,"b":1}}'), ("num", '{"key":{"n":1},"expireAfterSeconds":5}'))
    dst = indexes(spark, ("x_1", '{"key":{"x":1},"background":true}'), ("ttl", '{"key":{"t":1},"expireAfterSeconds":12123}'), ("f", '{"key":{"foo":-1}}'), ("ab", '{"key":{"b":1,"a":1}}'), ("z", '{"key":{"z":1}}'), ("num", '{"key":{"n":1},"expireAfterSeconds":5.0}'))
    got = metadata.compare_indexes(src, dst)
    assert sorted((r.id, r.cluster) for r in got.collect()) == [("ab", "dstClient"), ("f", "dstClient"), ("ttl", "dstClient"), ("z", "srcClient")]
    ttl = got.where("id = 'ttl'")
    count = lambda t: classify.without_tolerated(ttl, t).count()
    assert (count(()), count(("expireAfterSeconds",)), count(("expireAfterSeconds", "unique"))) == (1, 1, 0)
    with pytest.raises(PySparkException):
        metadata.compare_indexes(indexes(spark, (None, "{}")), dst).collect()


def test_shard_keys(spark):
    side = lambda *rows: spark.createDataFrame(rows, "namespace string, key string")
    src, dst = side(("a", '{"k": 1}'), ("b", '{"k":1}'), ("c", '{"k":1}')), side(("a", '{"k":1.0}'), ("b", '{"k":"hashed"}'))
    got = {r.namespace: r.details for r in metadata.compare_shard_keys(src, dst).collect()}
    assert got == {"b": 'Mismatch: src={"k":1}; dst={"k":"hashed"}', "c": "Missing"}
    assert metadata.compare_shard_keys(src, dst, both_sharded=False).count() == 0


QUEUE = "db string, coll string, doc_id string, data_size int, change_op_time struct<t:long,i:int>, from_dst boolean, first_mismatch_time timestamp"


@pytest.mark.parametrize("seed", range(3))
def test_an_event_clears_the_first_time_in_any_order(spark, seed):
    from datetime import datetime

    t = datetime(2024, 1, 1)
    rows = [("d", "c", "1", 5, None, False, t)] + [("d", "c", "1", 7, (a, b), side, None) for a, b in ((123, 234), (234, 345), (345, 456)) for side in (False, True)] + [("d", "c", "2", 9, None, False, t)]
    random.Random(seed).shuffle(rows)
    got = {r.doc_id: r for r in recheck.reduced(spark.createDataFrame(rows, QUEUE)).collect()}
    assert got["1"].first_mismatch_time is None and tuple(got["1"].src_ts) == (345, 456) == tuple(got["1"].dst_ts) and got["1"].data_size == 7
    assert got["2"].first_mismatch_time == t and got["2"].src_ts is None


def test_greedy_chunks(spark):
    rows = [("n", "a", 400), ("n", "b", 700), ("n", "c", 1), ("m", "a", 1)]
    frame = spark.createDataFrame(rows, "namespace string, doc_id string, data_size int")
    got = recheck.greedy(frame, most_bytes=1000, ranges=1)
    groups = {}
    for r in got.collect():
        groups.setdefault(r.task, []).append((r.namespace, r.doc_id))
    assert sorted(groups.values()) == [[("m", "a")], [("n", "a"), ("n", "b")], [("n", "c")]]
    big = spark.createDataFrame([("n", f"{i}" * 7, 1) for i in range(3)], "namespace string, doc_id string, data_size int")
    assert recheck.tasks(recheck.greedy(big, most_id_bytes=7, ranges=1)).count() == 3
    assert recheck.tasks(recheck.greedy(big, most_ids=2, ranges=1)).count() == 2
    assert recheck.greedy(frame.limit(0)).count() == 0


def test_eta_phase_and_rates(spark):
    assert statistics.eta_seconds("check", 1024, 512.0) == 2.0
    assert statistics.eta_seconds("check", 1024, 0.0) is None
    assert statistics.eta_seconds("check", 0, 0.0) == 0
    assert statistics.eta_seconds("recheck", 1024, 512.0) is None
    assert [statistics.phase(*x) for x in ((False, 3), (True, 0), (True, 2))] == ["idle", "check", "recheck"]
    samples = spark.createDataFrame([(100, 10), (150, 20), (158, 5)], "s long, n long").select(F.timestamp_seconds("s").alias("time"), "n")
    assert statistics.rates(samples, F.timestamp_seconds(F.lit(160))).first()[0] == pytest.approx(35 / 60)
    assert statistics.rates(samples, F.timestamp_seconds(F.lit(999))).first()[0] == 0.0
    assert statistics.event_rate(samples).first()[0] == pytest.approx(25 / 58)
    assert statistics.event_rate(samples.limit(1)).first()[0] is None


def test_formats():
    assert [formats.duration(x) for x in (60, 0, 3723.45, 23.4, 90_000)] == ["1m 0s", "0s", "1h 2m 3.45s", "23.4s", "1d 1h 0m 0s"]
    assert formats.percent(999_999, 1_000_000) == "99.99" and formats.percent(5, 5) == "100" and formats.percent(23_45, 100_00) == "23.45"
    assert formats.bytes_(1_123_999) == "1.07 MiB" and formats.number(1097.66) == "1,097.66" and formats.unit(1 << 30) == "GiB"
    assert formats.version("6.0.12-rc1") < formats.version("7.1")


def test_filters(spark):
    frame = spark.createDataFrame([(1, False, 5), (2, True, None), (3, None, 7)], "k int, b boolean, x int")
    ids = lambda q: [r.k for r in frame.where(filters.condition(q)).orderBy("k").collect()]
    assert ids({"b": {"$ne": False}}) == [2, 3]
    assert ids({"b": None}) == [3]
    assert ids({"x": {"$gt": 5}}) == [3]
    assert ids({"x": {"$not": {"$gt": 5}}}) == [1, 2]
    assert ids({"x": {"$exists": False}}) == [2]
    assert ids({"$nor": [{"k": 1}, {"x": {"$in": [7]}}]}) == [2]
    assert ids({"k": {"$nin": [1, 2]}}) == [3]
    assert ids("x > 5") == [3] and ids({}) == [1, 2, 3]
    with pytest.raises(ValueError):
        filters.condition({"x": {"$near": 1}})


def test_namespaces(spark):
    rows = ["a.b.c", "admin.x", "local.x", "db.system.views", "db.system.buckets.m", "__internal_1.x", "nodot"]
    frame = spark.createDataFrame([(r,) for r in rows], "namespace string")
    assert [r[0] for r in frame.where(namespaces.is_user(F.col("namespace"))).collect()] == ["a.b.c", "db.system.buckets.m", "nodot"]
    split = frame.select(namespaces.database(F.col("namespace")), namespaces.collection(F.col("namespace"))).collect()
    assert tuple(split[0]) == ("a", "b.c") and tuple(split[-1]) == ("nodot", "")
    other = spark.createDataFrame([("a.b.c",)], "namespace string")
    assert namespaces.one_sided(frame, other).count() == 2
    with pytest.raises(ValueError):
        namespaces.one_sided(frame, other, strict=True)
    with pytest.raises(PySparkException):
        namespaces.remap(frame, {"x": "y"}).collect()


def test_expressions(spark):
    row = spark.createDataFrame([({"a": 1, "b": 2}, {"b": 3}, [1, 2, 3, 4], None, "x")], "m map<string,int>, n map<string,int>, v array<int>, z int, s string")
    pick = lambda c: row.select(c).first()[0]
    v = F.col("v")
    assert pick(X.merge_objects(F.col("m"), F.col("n"))) == {"a": 1, "b": 3}
    assert [pick(X.slice_(v, *a)) for a in ((2,), (-2,), (1, 2), (-3, 2), (9, 1))] == [[1, 2], [3, 4], [2, 3], [2, 3], []]
    assert [pick(X.array_elem_at(v, i)) for i in (0, -1, 9)] == [1, 4, None]
    assert pick(X.filter_(v, lambda x: X.gt(x, 1), 2)) == [2, 3] and pick(X.map_(v, lambda x: x + 1)) == [2, 3, 4, 5]
    assert pick(X.cond(X.exists(F.col("z")), 1, 2)) == 2 and pick(X.eq(F.col("z"), None)) is True
    assert pick(X.array_to_object(X.object_to_array(F.col("m")))) == {"a": 1, "b": 2}
    assert pick(X.and_(True, X.not_(X.or_(False, False)))) is True
    assert pick(X.strict_cast(F.lit("12"), "int")) == 12
    with pytest.raises(PySparkException):
        pick(X.strict_cast(F.col("s"), "int"))


@pytest.mark.parametrize("n, parts", [(0, 4), (50, 4), (5000, 1), (5000, 4), (5000, 40)])
def test_bucket_bounds_hold_all_keys(spark, n, parts):
    frame = spark.createDataFrame([(k,) for k in range(n)] + [(None,)], "k long")
    ranges = partitioning.bucket_bounds(frame, "k", parts).orderBy("part").collect()
    assert ranges[0].lower is None and ranges[-1].upper is None and len(ranges) <= parts
    assert all(a.upper == b.lower and a.upper is not None for a, b in zip(ranges, ranges[1:], strict=False))
    assert len(ranges) == 1 if parts == 1 or n < 101 else len(ranges) > parts // 2
    assert sum(frame.where(partitioning.within(F.col("k"), r.lower, r.upper)).count() for r in ranges[:3] + ranges[3:4]) == n + 1 or len(ranges) > 4


def test_chunks_of_a_hot_namespace(spark):
    rng = random.Random(1)
    rows = [("hot", f"{i:05}") for i in range(900)] + [(f"n{i % 7}", f"{i:05}") for i in range(100)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "ns string, id string").repartition(5)
    place = {}
    for ns, own in sorted(rows):
        place[ns, own] = sum(1 for k in place if k[0] == ns)
    for ranges in (1, 3, 16):
        got = {(r.ns, r.id): r.chunk for r in recheck.by_count(frame, "ns", "id", 40, ranges).collect()}
        assert got == {k: n // 40 for k, n in place.items()}


@pytest.mark.parametrize(
    "query, kept",
    [
        ({"s": {"$regex": "^a.c"}}, [1]),
        ({"n": {"$mod": [4, 1]}}, [1, 5]),
        ({"a": {"$size": 2}}, [1, 3]),
        ({"a": {"$all": [1, 2]}}, [1, 3]),
        ({"a": {"$elemMatch": {"$gt": 2, "$lt": 9}}}, [3]),
        ({"o": {"$elemMatch": {"x": 1, "y": {"$gte": 5}}}}, [3]),
        ({"n": {"$type": "long"}}, [1, 2, 3, 5]),
        ({"n": {"$type": ["string", "null"]}}, [4]),
        ({"s": {"$type": "number"}}, []),
        ({"$expr": {"$gt": ["$n", {"$add": ["$m", 1]}]}}, [5]),
        ({"$expr": {"$or": [{"$eq": ["$n", "$m"]}, {"$lt": ["$n", 0]}]}}, [1, 4]),  # null is less than a number
        ({"$nor": [{"n": {"$gte": 2}}, {"n": None}]}, [1]),
    ],
)
def test_more_query_operators(spark, query, kept):
    rows = [(1, 1, "abc", [1, 2], [(1, 1)], 1), (2, 2, "xabc", [], [], 7), (3, 3, None, [2, 1], [(2, 9), (1, 5)], 9), (4, None, "b", None, None, 4), (5, 5, "aXd", [9, 3, 2], [(1, None)], 0)]
    rows[2] = (3, 3, None, [2, 1], [(2, 9), (1, 5)], 9)
    frame = spark.createDataFrame(rows, "k long, n long, s string, a array<long>, o array<struct<x:long,y:long>>, m long")
    if "$elemMatch" in str(query.get("a")):
        frame = frame.withColumn("a", F.when(F.col("k") == 3, F.array(F.lit(5), F.lit(1)).cast("array<long>")).when(F.col("k") == 5, F.array(F.lit(9)).cast("array<long>")).otherwise(F.col("a")))
    assert sorted(r.k for r in frame.where(filters.condition(query)).collect()) == kept


@pytest.mark.parametrize("query", [{"a": {"$odd": 1}}, {"a": {"$type": "odd"}}, {"$where": "x"}, {"$expr": {"$odd": [1, 2]}}])
def test_unknown_operators_are_errors(spark, query):
    with pytest.raises(ValueError):
        filters.compiled(query)


@pytest.mark.parametrize("lower, upper", [(("string", None, "a"), ("int", 1.0, None)), (("int", 5.0, None), ("double", 4.0, None)), (("string", None, "b"), ("string", None, "a")), (("array", None, None), ("int", 1.0, None))])
def test_inverted_bounds_are_errors(spark, lower, upper):
    from concord.functions import ordering

    for f in (ordering.between, ordering.between_by_types):
        with pytest.raises(ValueError):
            f(F.lit("int"), F.lit(1.0), F.lit(None), lower, upper)


def test_both_forms_of_a_range_are_one(spark):
    from concord.functions import ordering

    rng = random.Random(2)
    some = lambda: rng.choice([("int", float(rng.randint(0, 9)), None), ("double", rng.random() * 9, None), ("string", None, rng.choice("abcd")), ("bool", float(rng.randint(0, 1)), None), ("null", None, None), ("date", float(rng.randint(0, 9)), None)])
    frame = spark.createDataFrame([some() for _ in range(300)], "type string, number double, text string")
    c = [F.col(x) for x in ("type", "number", "text")]
    tried = 0
    while tried < 12:
        lower, upper = some(), some()
        try:
            two = [f(*c, lower, upper).alias(n) for n, f in (("x", ordering.between), ("y", ordering.between_by_types))]
        except ValueError:
            continue
        tried += 1
        assert frame.select(*two).where("x is distinct from coalesce(y, false)").count() == 0


def test_sizes_beyond_a_tebibyte_are_in_gib_as_the_sql_has_them(spark, tmp_path):
    from concord.plans.catalogue_operators import formatted

    i, of_a = F.col("id"), (1 << 20) + 416
    spark.range(of_a + 1524).select(i.alias("o_orderkey"), F.when(i < of_a, "a").otherwise("b").alias("o_orderpriority")).write.parquet(str(tmp_path / "orders.parquet"))
    assert sorted(tuple(r) for r in formatted(spark, str(tmp_path)).collect()) == [("a", "1,048,992", "99.85", "23m 11s", "1,024.41 GiB"), ("b", "1,524", "0.15", "48m 35s", "1.49 GiB")]
    assert formats.bytes_(1 << 41) == "2 TiB" and formats.bytes_(1 << 41, "GiB") == "2,048 GiB" and formats.bytes_(1 << 9, "GiB") == "512 bytes"
