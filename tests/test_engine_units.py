import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_streams_and_engine import feed_line, side, write

from concord.model import DST, SRC, Options
from concord.plans.engine import Engine
from concord.sources import keyindex, store
from concord.sources.catalog import Side
from concord.sources.retry import TransientError
from concord.streaming import changes


def frames(spark, path, df):
    df.write.mode("overwrite").parquet(str(path))
    return lambda: spark.read.parquet(str(path))


def jobs(spark):
    return max(spark.sparkContext.statusTracker().getJobIdsForGroup(), default=0)


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "double", "struct<a:int,b:timestamp>"])
def test_rechecks_find_keys_of_any_type(spark, tmp_path, kind):
    times = [datetime(2024, 1, 1) + timedelta(microseconds=7 * i) for i in range(40)]
    value = {"double": lambda i: i + 0.1, "struct<a:int,b:timestamp>": lambda i: (i, times[i])}.get(kind, lambda i: times[i])
    rows = lambda changed: spark.createDataFrame([(value(i), "b" if changed and i % 8 == 3 else "a") for i in range(40)], f"`_id` {kind}, v string")
    sides = [Side(spark, {"db.c": frames(spark, tmp_path / n, rows(n == "d"))}) for n in "sd"]
    engine = Engine(*sides, str(tmp_path / "state"))
    assert engine.run_generation()["contentDiffers"] == 5
    engine.finish_generation()
    assert engine.run_generation()["contentDiffers"] == 5


def test_documents_deleted_on_both_sides_are_no_difference_and_wrong_lookups_an_error(spark, tmp_path, monkeypatch):
    src, dst = [(1, "a"), (2, "b")], [(1, "a"), (2, "x")]
    engine = Engine(side(spark, src), side(spark, dst), str(tmp_path / "state"))
    engine.run_generation()
    engine.finish_generation()
    monkeypatch.setattr(engine, "_rows_of", lambda cluster, ns, df, ids, key: df.where("false"))
    with pytest.raises(RuntimeError, match="l2;"):
        engine.run_generation()
    src.pop(), dst.pop()
    assert engine.run_generation()["documents"] == 0


def test_only_queued_tables_are_units(spark, tmp_path):
    make = lambda n, k: frames(spark, tmp_path / f"{n}{k}", spark.createDataFrame([(1, "a"), (2, "x" if (n, k) == ("d", 3) else "a")], "`_id` long, v string").coalesce(1))
    sides = [Side(spark, {f"db.c{k}": make(n, k) for k in range(12)}) for n in "sd"]
    engine = Engine(*sides, str(tmp_path / "state"))
    assert engine.run_generation()["documents"] == 1
    engine.finish_generation()
    before = jobs(spark)
    assert engine.run_generation()["documents"] == 1
    assert jobs(spark) - before < 90
    assert [r.namespace for r in engine.tasks().where("generation = 1 and type = 'verifyDocuments'").collect()] == ["db.c3"]


def test_rechecks_of_one_table_are_cut_into_units(spark, tmp_path):
    src, dst = [(i, "a") for i in range(50)], [(i, "b") for i in range(50)]
    engine = Engine(side(spark, src), side(spark, dst), str(tmp_path / "state"), Options(recheck_unit_ids=20))
    engine.run_generation()
    engine.finish_generation()
    dst[:25] = src[:25]
    assert engine.run_generation()["contentDiffers"] == 25
    tasks = engine.tasks().where("generation = 1 and type = 'verifyDocuments'").collect()
    assert len(tasks) >= 3 and sum(t.documents_count for t in tasks) == 50


def test_the_key_index_opens_files_that_hold_the_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(2000).select(F.col("id").alias("_id"), F.lit("v").alias("v")).repartition(100, "_id").write.parquet(path)
    df = spark.read.parquet(path)
    assert len(df.inputFiles()) > 80
    index = keyindex.KeyIndex(spark, str(tmp_path / "index"))
    ids = spark.createDataFrame([(f"l{i};",) for i in range(0, 2000, 200)], "key string")
    few = keyindex.narrowed(df, index, ids, ["_id"], 16)
    files = index.files(ids, index.update(df, ["_id"]))
    assert 0 < len(files) <= 10 and {r[0] for r in few.select("_id").collect()} >= set(range(0, 2000, 200))
    assert len({r[0] for r in few.select("_metadata.file_path").distinct().collect()}) == len(files)
    # Of a table that has changed, only the new files are indexed; those that are gone are passed over.
    spark.createDataFrame([(5000, "new")], "`_id` long, v string").coalesce(1).write.mode("append").parquet(path)
    df = spark.read.parquet(path)
    before = jobs(spark)
    few = keyindex.narrowed(df, index, spark.createDataFrame([("l5000;",)], "key string"), ["_id"], 16)
    assert [tuple(r) for r in few.where("_id = 5000").collect()] == [(5000, "new")] and jobs(spark) - before < 20
    assert keyindex.narrowed(df, index, ids, ["_id"], 1000) is df
    grouped = df.groupBy("_id").count()
    assert keyindex.narrowed(grouped, index, ids, ["_id"], 1) is grouped


def test_a_second_driver_takes_the_folder_over(spark, tmp_path):
    one, two = (Engine(side(spark, [(1, "a")]), side(spark, [(1, "b")]), str(tmp_path / "state")) for _ in range(2))
    one.run_generation()
    one.finish_generation()
    two.run_generation()
    for work in (one.finish_generation, one.run_generation, one.writes_off):
        with pytest.raises(store.FencedError):
            work()
    assert two.finish_generation() == 2
    assert store.create(spark, str(tmp_path / "x")) and not store.create(spark, str(tmp_path / "x"))


def test_files_that_change_while_they_are_read(spark, tmp_path, monkeypatch):
    path = tmp_path / "s"
    read = frames(spark, path, spark.createDataFrame([(1, "a")], "`_id` long, v string").coalesce(1))
    engine = Engine(Side(spark, {"db.c": read}), side(spark, [(1, "a")]), str(tmp_path / "state"))
    plan, moment = engine._plan(0, F.current_timestamp()), F.current_timestamp()
    compare, times = engine._compare_unit, []

    def meanwhile(*args):
        compare(*args)
        if not times:
            times.append(1)
            read().sparkSession.createDataFrame([(1, "changed")], "`_id` long, v string").coalesce(1).write.mode("overwrite").parquet(str(path))

    monkeypatch.setattr(engine, "_compare_unit", meanwhile)
    with pytest.raises(TransientError):
        engine._work_unit(0, plan["units"][0], moment)
    assert not store.exists(spark, f"{tmp_path}/state/done/generation=0/0")
    assert engine.run_generation()["contentDiffers"] == 1


def test_drain_waits_for_the_time_at_which_writes_went_off(spark, tmp_path):
    for name in ("s", "d"):
        write(tmp_path / name, "1.json", [feed_line("update", "1", 5)])
    make = lambda n: Side(spark, {"db.c": lambda: spark.createDataFrame([(1, "a")], "`_id` long, v string")}, feed=str(tmp_path / n))
    engine = Engine(make("s"), make("d"), str(tmp_path / "state"), Options(pause_seconds=0.1, drain_seconds=4))
    engine.run_generation()
    engine.writes_off({SRC: (9, 1), DST: (5, 1)})
    with pytest.raises(TimeoutError, match=SRC):
        engine.drain()
    import threading

    late = threading.Timer(3, lambda: (write(tmp_path / "tmp", "2.json", [feed_line("update", "2", 8), feed_line("noop", None, 9, ns=(None, None))]), os.rename(tmp_path / "tmp/2.json", tmp_path / "s/2.json")))
    late.start()
    engine.options.drain_seconds = 60
    engine.drain()
    assert changes.mark(spark, f"{tmp_path}/state/changes", SRC) == (9, 1)
    assert {r.doc_id for r in engine.queue(1).collect()} == {"1", "2"}
    assert engine.event_counts().agg(F.sum("total")).first()[0] == 3


def test_many_batches_leave_few_files_and_one_row_a_document(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(changes, "FOLDED", 4)
    monkeypatch.setattr(changes, "REMEMBERED", 3)
    where = str(tmp_path / "out")
    events = lambda n: changes.from_feed(spark.read.schema(changes.FEED).json(spark.sparkContext.parallelize([feed_line("update", "1", 10 * n + i) for i in range(50)], 1)), SRC)
    for n in range(12):
        changes.RecheckWriter(where, lambda: 0, SRC)(events(n), n)  # a writer of its own each time, as after a restart
    rows = spark.read.option("recursiveFileLookup", "true").parquet(f"{where}/generation=1").collect()
    assert len(rows) <= 5 and max(r.change_op_time.t for r in rows) == 159
    assert len(store.names(spark, f"{where}/generation=1")) <= 4 + 1
    assert len(store.names(spark, f"{where}-counts/{SRC}")) <= 4 and store.names(spark, f"{where}-noted") == [f"{SRC}.json"]
    (total,) = changes.counts(spark, where).collect()
    assert (total.update, total.total, total.last.t) == (600, 600, 159)


def test_feeds_with_keys_of_several_fields_and_ids_that_do_not_fit(spark, tmp_path):
    schema = "a long, b string, v string"
    make = lambda rows, n: Side(spark, {"db.c": lambda: spark.createDataFrame(rows, schema)}, feed=str(tmp_path / n))
    src, dst = [(1, "x", "new"), (2, "y", "same")], [(1, "x", "old"), (2, "y", "same")]
    line = lambda key: '{"operationType": "update", "ns": {"db": "db", "coll": "c"}, "documentKey": %s, "clusterTime": {"t": 1, "i": 1}}' % key
    write(tmp_path / "s", "1.json", [line('{"a": 1, "b": "x"}')])
    write(tmp_path / "d", "1.json", [])
    engine = Engine(make(dst, "s"), make(dst, "d"), str(tmp_path / "state"), Options(keys=("a", "b")))
    assert engine.run_generation()["documents"] == 0
    engine.src = make(src, "s")
    engine.drain()
    engine.finish_generation()
    assert engine.run_generation()["contentDiffers"] == 1
    write(tmp_path / "s", "2.json", [line('{"a": "no number", "b": "x"}')])
    engine.drain()
    engine.finish_generation()
    with pytest.raises(Exception, match="no number"):
        engine.run_generation()


def test_ranges_over_binary_and_composite_keys_hold_all_rows(spark, tmp_path):
    rows = spark.range(4000).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("_id"), (F.col("id") % 7).cast("string").alias("v"))
    changed = rows.withColumn("v", F.when(F.hex("_id").startswith("A"), "z").otherwise(F.col("v")))
    sides = [Side(spark, {"db.c": frames(spark, tmp_path / n, df)}) for n, df in (("s", rows), ("d", changed))]
    expected = rows.where(F.hex("_id").startswith("A")).count()
    for i, keys in enumerate((("_id",), ("v", "_id"))):
        engine = Engine(*sides, str(tmp_path / f"state{i}"), Options(partition_bytes=1 << 14, ranges=4, keys=keys))
        counts = engine.run_generation()
        assert counts["contentDiffers"] == expected if i == 0 else counts["missingOnDst"] == expected
        tasks = [t.documents_count for t in engine.tasks().where("type = 'verifyDocuments'").collect()]
        assert len(tasks) == 4 and sum(tasks) == 4000 and min(tasks) > 0


def test_progress_has_an_estimate_while_a_check_runs(spark, tmp_path):
    engine = Engine(side(spark, [(1, "a")]), side(spark, [(1, "a")]), str(tmp_path / "state"))
    seen, work = [], engine._work_unit
    engine._work_unit = lambda g, u, m: (work(g, u, m), seen.append(engine.summary()["etaSecs"]))
    engine.run_generation()
    assert seen == [0.0] and engine.summary()["etaSecs"] is None


def test_a_table_that_asks_for_many_units_has_about_as_many_as_ranges(spark, tmp_path):
    src, dst = [(i, "a") for i in range(60)], [(i, "b") for i in range(60)]
    engine = Engine(side(spark, src), side(spark, dst), str(tmp_path / "state"), Options(recheck_unit_ids=2, ranges=3))
    engine.run_generation()
    engine.finish_generation()
    dst[:30] = src[:30]
    assert engine.run_generation()["contentDiffers"] == 30
    tasks = engine.tasks().where("generation = 1 and type = 'verifyDocuments'").collect()
    assert 3 <= len(tasks) <= 6 and sum(t.documents_count for t in tasks) == 60


def test_units_of_one_table_share_one_index(spark, tmp_path):
    make = lambda n, v: frames(spark, tmp_path / n, spark.range(400).select(F.col("id").alias("_id"), F.lit(v).alias("v")).repartition(8, "_id"))
    sides = [Side(spark, {"db.c": make(*nv)}) for nv in (("s", "a"), ("d", "b"))]
    engine = Engine(*sides, str(tmp_path / "state"), Options(recheck_unit_ids=50, indexed_files=1, workers=8))
    engine.run_generation()
    engine.finish_generation()
    assert engine.run_generation()["contentDiffers"] == 400
    for cluster in (SRC, DST):
        assert spark.read.parquet(str(tmp_path / f"state/index/{cluster}/db.c/keys")).count() == 400  # not once a unit
