import json
import urllib.request
from datetime import datetime, timedelta, timezone

import pytest

from concord.model import DdlPolicy, Options
from concord.plans import cli, reports
from concord.plans.api import Server
from concord.plans.engine import Engine
from concord.sources import store
from concord.sources.catalog import Side
from concord.streaming import changes


def feed_line(op, doc_id, t, doc=None, ns=("db", "c")):
    return json.dumps({"operationType": op, "ns": {"db": ns[0], "coll": ns[1]}, "documentKey": {"_id": doc_id}, "fullDocument": doc, "clusterTime": {"t": t, "i": 1}})


def log_line(op, doc_id, t, size=None, replacement=False, ns="db.c", **more):
    entry = {"op": op, "ts": {"t": t, "i": 1}, "ns": ns, "docLen": size, "isReplacement": replacement} | more
    return json.dumps(entry | ({"o2": {"_id": doc_id}} if op == "u" else {"o": {"_id": doc_id}}))


def write(path, name, lines):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(lines))


def test_both_formats_are_one(spark, tmp_path):
    write(tmp_path / "feed", "1.json", [feed_line("insert", "a", 1, "xxxx"), feed_line("update", "a", 2), feed_line("replace", "a", 3, "xx"), feed_line("delete", "a", 4), feed_line("insert", "b", 5, "y", ("local", "c"))])
    flat = [{"op": "d", "ns": "db.c", "o": {"_id": "a"}}, {"op": "i", "ns": "admin.x", "o": {"_id": "q"}}]
    write(
        tmp_path / "log", "1.json",
        [log_line("i", "a", 1, 4), log_line("u", "a", 2, 9), log_line("u", "a", 3, 2, True), log_line("c", None, 4, ns="admin.$cmd", cmdName="applyOps", applyOps=flat), log_line("n", None, 5, ns=""), log_line("c", None, 6, cmdName="startIndexBuild")],
    )
    got = [sorted(map(tuple, f(changes.read(spark, f"{tmp_path}/{k}", k, streaming=False), "srcClient").collect()), key=str) for k, f in (("feed", changes.from_feed), ("log", changes.from_log))]
    assert got[0] == got[1] and len(got[0]) == 4
    sizes = {r.change_op_time.t: r.data_size for r in changes.rechecks(changes.from_feed(changes.read(spark, f"{tmp_path}/feed", streaming=False), "dstClient"), 1).collect()}
    assert sizes == {1: 4, 2: 1024, 3: 2, 4: 1024}


def test_stream_resumes_and_lands_in_the_generation_at_hand(spark, tmp_path):
    where, generation = str(tmp_path / "out"), [0]
    follow = lambda: changes.start(changes.from_feed(changes.read(spark, f"{tmp_path}/in", max_files=1), "srcClient"), changes.RecheckWriter(where, lambda: generation[0], "src"), str(tmp_path / "cp")).awaitTermination()
    write(tmp_path / "in", "1.json", [feed_line("insert", str(i), i) for i in range(5)])
    follow()
    generation[0] = 1
    write(tmp_path / "in", "2.json", [feed_line("update", str(i), i) for i in range(3)])
    follow()
    follow()
    rows = spark.read.option("recursiveFileLookup", "true").parquet
    assert rows(f"{where}/generation=1").count() == 5 and rows(f"{where}/generation=2").count() == 3
    # A batch that is replayed stays in its generation and replaces what it wrote.
    generation[0] = 7
    changes.RecheckWriter(where, lambda: generation[0], "src")(changes.from_feed(changes.read(spark, f"{tmp_path}/in/1.json", streaming=False), "srcClient"), 0)
    assert rows(f"{where}/generation=1").count() == 5 and not store.exists(spark, f"{where}/generation=8")


@pytest.mark.parametrize("op, policy, until, fails", [("drop", "fail", None, True), ("drop", "warnMost", None, False), ("odd", "warnMost", None, True), ("drop", "fail", (9, 9), False), ("drop", "fail", (1, 0), True)])
def test_schema_events(spark, tmp_path, op, policy, until, fails):
    write(tmp_path / "in", "1.json", [feed_line("insert", "a", 1), feed_line(op, None, 5)])
    events = changes.read(spark, f"{tmp_path}/in", streaming=False)
    writer = changes.RecheckWriter(str(tmp_path / "out"), lambda: 0, "src", DdlPolicy(policy), allowed_until=until)
    writer(changes.from_feed(events, "dstClient"), 0)
    if fails:
        with pytest.raises(changes.SchemaChange):
            writer(changes.from_feed(events, "srcClient"), 1)
    else:
        writer(changes.from_feed(events, "srcClient"), 1)


def test_remapped_events(spark, tmp_path):
    write(tmp_path / "in", "1.json", [feed_line("insert", "a", 1, ns=("other", "x")), feed_line("insert", "b", 1, ns=("concord_metadata", "x"))])
    events = changes.from_feed(changes.read(spark, f"{tmp_path}/in", streaming=False), "dstClient")
    assert [(r.db, r.coll, r.doc_id) for r in changes.rechecks(events, 1, {"db.c": "other.x"}).collect()] == [("db", "c", "a")]


def side(spark, rows, ns="db.c"):
    return Side(spark, {ns: lambda: spark.createDataFrame(rows, "`_id` long, v string")})


def test_generations(spark, tmp_path):
    src, dst = [(1, "a"), (2, "b"), (3, "c")], [(1, "a"), (3, "x"), (4, "d")]
    engine = Engine(side(spark, src), side(spark, dst), str(tmp_path / "state"))
    at = datetime(2024, 1, 1, tzinfo=timezone.utc)
    assert engine.run_generation(at) == {"contentDiffers": 1, "missingOnDst": 1, "extraOnDst": 1, "documents": 3}
    assert engine.run_generation(at)["documents"] == 3  # an attempt that is repeated replaces the one before
    engine.finish_generation()
    assert engine.queue(1).count() == 3
    dst[:] = [(1, "a"), (2, "b"), (3, "x")]
    assert engine.run_generation(at + timedelta(seconds=90)) == {"contentDiffers": 1, "missingOnDst": 0, "extraOnDst": 0, "documents": 1}
    assert engine.finish_generation() == 2 and not store.exists(spark, f"{tmp_path}/state/rechecks/generation=1")
    (row,) = engine.doc_mismatches().collect()
    assert (row.type, row.field, row.durationSecs) == ("content", "v", 90.0)
    assert engine.doc_mismatches(91).count() == 0
    assert engine.progress()["longestDocMismatch"]["durationSecs"] == 90.0
    assert engine.summary()["docMismatches"]["total"] == 1
    text = reports.document_mismatches(engine.reported().where("task_type = 'verifyDocuments'"), 1, 5)
    assert "1m 30s" in text and "differing content" in text
    engine.writes_off()
    with pytest.raises(RuntimeError):
        engine.writes_off()
    dst[:] = src
    assert engine.run()["documents"] == 0


def test_filter_holds_on_each_side(spark, tmp_path):
    src, dst = [(1, "in"), (2, "out"), (3, "in")], [(1, "in"), (2, "in"), (3, "out")]
    engine = Engine(side(spark, src), side(spark, dst), str(tmp_path / "state"), Options(filter={"v": {"$ne": "out"}}))
    assert engine.run_generation() == {"contentDiffers": 0, "missingOnDst": 1, "extraOnDst": 1, "documents": 2}
    assert engine.document_counts().split("\n")[3].split() == ["|", "db.c", "|", "2", "|", "2", "|"]


def test_http(spark, tmp_path):
    engine = Engine(side(spark, [(1, "a")]), side(spark, [(1, "b")]), str(tmp_path / "state"), Options(pause_seconds=0.1))
    server = Server(engine, 0)
    run = engine.run
    engine.run = lambda: run(2)
    server.serve()

    def call(path, data=None):
        with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{server.port}{path}", data)) as r:
            return r.read().decode()

    try:
        v1 = "/api/v1"
        for bad in (b'{"filter": "reflect(1)"}', b'{"filter": {"v": {"$odd": 1}}}'):
            with pytest.raises(urllib.error.HTTPError):
                call(f"{v1}/check", bad)
        assert json.loads(call(f"{v1}/check", b'{"filter": {"v": {"$ne": "z"}}}')) == {"success": True}
        server.worker.join(120)
        assert not server.worker.is_alive() and server.failed is None and engine.options.filter == {"v": {"$ne": "z"}}
        progress = json.loads(call(f"{v1}/progress"))["progress"]
        assert progress["generation"] > 0 and progress["phase"] == "idle" and progress["srcChangeStats"]["totalEvents"] == {}
        assert json.loads(call(f"{v1}/docMismatches").splitlines()[0])["detail"] == "Mismatch"
        assert json.loads(call(f"{v1}/summary"))["summary"]["docMismatches"]["total"] == 1
        assert call(f"{v1}/nsMismatches") == ""
        assert json.loads(call(f"{v1}/writesOff", b"{}")) == {"success": True}
        for path, data in ((f"{v1}/writesOff", b"{}"), (f"{v1}/nothing", None), ("/progress", None)):
            with pytest.raises(urllib.error.HTTPError):
                call(path, data)
    finally:
        server.close()


def tables(spark, path, rows):
    spark.createDataFrame(rows, "`_id` long, v string").repartitionByRange(4, "_id").write.mode("overwrite").parquet(str(path))
    return str(path)


def test_feeds_are_followed_drained_and_resumed(spark, tmp_path):
    src, dst = [[i, "a"] for i in range(60)], [[i, "a"] for i in range(60)]
    dst[7][1] = "b"
    put = lambda name, rows: tables(spark, tmp_path / name, [tuple(r) for r in rows])
    paths = {"src": put("src", src), "dst": put("dst", dst)}
    read = lambda name: Side(spark, {"db.c": lambda: spark.read.parquet(paths[name])}, feed=str(tmp_path / f"{name}-feed"))
    for name in ("src", "dst"):
        write(tmp_path / f"{name}-feed", "0.json", [])
    engine = Engine(read("src"), read("dst"), str(tmp_path / "state"), Options(pause_seconds=0.1))
    engine.follow()
    assert engine.run_generation()["documents"] == 1
    # While generation 0 ran, documents changed: 9 and 11 on the source only, 10 on both sides, and 7 was mended.
    for i, v in ((9, "n"), (10, "n"), (11, "n")):
        src[i][1] = v
    dst[10][1], dst[7][1], dst[20][1] = "n", "a", "silent"
    paths |= {"src": put("src1", src), "dst": put("dst1", dst)}
    write(tmp_path / "src-feed", "1.json", [feed_line("update", str(i), 5) for i in (9, 10, 11)])
    write(tmp_path / "dst-feed", "1.json", [feed_line("replace", "10", 6, "xx"), feed_line("update", "7", 6)])
    engine.drain()
    engine.finish_generation()
    assert {(r.doc_id, r.plain) for r in engine.queue(1).collect()} == {("l7;", False), ("9", True), ("10", True), ("11", True), ("7", True)}
    # Only what is queued is compared: 20 changed without an event.
    assert engine.run_generation() == {"contentDiffers": 2, "missingOnDst": 0, "extraOnDst": 0, "documents": 2}
    assert {r.id for r in engine.mismatches().where("generation = 1").collect()} == {"l9;", "l11;"}
    (task,) = engine.tasks().where("generation = 1 and type = 'verifyDocuments'").collect()
    assert (task.documents_count, task.src_ts.t, task.dst_ts.t, task.status) == (4, 5, 6, "failed")
    engine.finish_generation()
    # Another engine goes on from there, to the end: events that came meanwhile, writes off, the last generation.
    dst[9][1] = dst[11][1] = "n"
    paths["dst"] = put("dst2", dst)
    write(tmp_path / "dst-feed", "2.json", [feed_line("update", "20", 9), feed_line("update", "9", 9)])
    other = Engine(read("src"), read("dst"), str(tmp_path / "state"), Options(pause_seconds=0.1))
    other.writes_off()
    assert other.run() == {"contentDiffers": 1, "missingOnDst": 0, "extraOnDst": 0, "documents": 1}
    stats = other.progress()["dstChangeStats"]
    assert stats["totalEvents"]["update"] == 3 and stats["totalEvents"]["replace"] == 1 and stats["lastHandledTS"] == {"t": 9, "i": 1}
    assert "Change events" in other.report(1.0) or "Events" in other.report(1.0)


def test_a_schema_event_of_the_source_ends_the_run(spark, tmp_path):
    write(tmp_path / "feed", "1.json", [feed_line("drop", None, 5)])
    path = tables(spark, tmp_path / "t", [(1, "a")])
    make = lambda policy, name: Engine(Side(spark, {"db.c": lambda: spark.read.parquet(path)}, feed=str(tmp_path / "feed")), Side(spark, {"db.c": lambda: spark.read.parquet(path)}), str(tmp_path / name), Options(src_ddl=policy))
    engine = make("fail", "a")
    engine.writes_off()
    with pytest.raises(changes.SchemaChange):
        engine.run()
    milder = make("warnMost", "b")
    milder.writes_off()
    assert milder.run()["documents"] == 0
    assert "schema events were seen" not in milder.report(1.0)  # it was said within the last minute
    milder._warning.at = None
    assert "schema events were seen" in milder.report(1.0)


def test_large_tables_are_compared_in_ranges_and_open_ranges_only_are_repeated(spark, tmp_path, monkeypatch):
    src, dst = [(i, "a") for i in range(4000)], [(i, "a" if i % 500 else "b") for i in range(4000)]
    paths = [tables(spark, tmp_path / n, rows) for n, rows in (("s", src), ("d", dst))]
    sides = [Side(spark, {"db.c": lambda p=p: spark.read.parquet(p)}) for p in paths]
    engine = Engine(*sides, str(tmp_path / "state"), Options(partition_bytes=1 << 12, ranges=5, workers=1))
    work, done = engine._work_unit, []

    def cut_off(g, unit, moment):
        if unit["unit"] == "3":
            raise RuntimeError("lost")
        work(g, unit, moment)

    monkeypatch.setattr(engine, "_work_unit", cut_off)
    with pytest.raises(RuntimeError):
        engine.run_generation()
    written = {u: store.names(spark, f"{tmp_path}/state/mismatches/generation=0/unit={u}") for u in "0124"}
    monkeypatch.setattr(engine, "_work_unit", lambda g, unit, moment: (done.append(unit), work(g, unit, moment)))
    assert engine.run_generation() == {"contentDiffers": 8, "missingOnDst": 0, "extraOnDst": 0, "documents": 8}
    assert len(done) == 5 and written == {u: store.names(spark, f"{tmp_path}/state/mismatches/generation=0/unit={u}") for u in "0124"}
    rows = engine.tasks().where("type = 'verifyDocuments'").orderBy("task_id").collect()
    assert len(rows) == 5 and sum(r.documents_count for r in rows) == 4000 and rows[0].lower is None and rows[-1].upper is None
    assert all(a.upper == b.lower for a, b in zip(rows, rows[1:], strict=False))
    engine.finish_generation()
    assert engine.recheck_tasks(1).agg({"ids": "sum"}).first()[0] == 8


def test_rechecks_find_rows_by_plain_keys(spark, tmp_path):
    from concord.operators import diff

    path = tables(spark, tmp_path / "t", [(i, "text" * 10) for i in range(1000)])
    ids = spark.createDataFrame([("l5;",), ("l250;",), ("i6;",), ("s1:7;",)], "key string")
    few = diff.restricted_rows(spark.read.parquet(path), ids, ["_id"])
    assert sorted(r._id for r in few.collect()) == [5, 250]
    plan = few._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(_id), GreaterThanOrEqual(_id,5), LessThanOrEqual(_id,250)]" in plan
    strings = spark.createDataFrame([("a:b;", 1), (None, 2), ("", 3), ("é", 4)], "k string, n int")
    docs = diff.documents(strings, ["k", "n"])
    found = diff.restricted_rows(strings, docs.where("ordered like '%n=i1%' or ordered like '%n=i2%' or ordered like '%n=i4%'").select("key"), ["k", "n"])
    assert sorted(r.n for r in found.collect()) == [1, 2, 4]


def test_command_line(tmp_path):
    (tmp_path / "c.json").write_text('{"failureDisplaySize": 7, "srcNamespace": ["a.b,c.d"], "folder": "f"}')
    args = cli.parse(["--configFile", str(tmp_path / "c.json"), "--docCompareMethod", "ignoreFieldOrder"])
    options = cli.options(args)
    assert options.failure_display_size == 7 and options.namespaces == {"a.b": "a.b", "c.d": "c.d"} and options.method.value == "ignoreOrder"
    assert options.ddl_until is None and cli.options(cli.parse(["--ddlUntil", "5,2"])).ddl_until == (5, 2) and cli.options(cli.parse(["--ddlUntil", "5"])).ddl_until == (5, 0)
    with pytest.raises(SystemExit):
        cli.parse(["--srcNamespace", "a.b,c.d", "--dstNamespace", "x.y"])
    with pytest.raises(ValueError):
        Options(namespaces={"a": "x", "b": "x"})


def test_check_only(spark, tmp_path, capsys):
    paths = [tables(spark, tmp_path / n, rows) for n, rows in (("s", [(1, "a"), (2, "b")]), ("d", [(1, "a"), (2, "c")]))]
    argv = ["--src", f"db.c={paths[0]}", "--dst", f"db.c={paths[1]}", "--folder", str(tmp_path / "f"), "--checkOnly"]
    assert cli.main(argv) == 1
    said = capsys.readouterr().out
    assert "Documents with differing content" in said and "Generation 0 ended" in said and "| db.c      | 2      | 2           |" in said


def test_status_lines():
    assert reports.status(True, 0, False, False, False, True).startswith("❗")
    assert reports.status(False, 0, False, False, False, True).startswith("✅")
    assert reports.status(False, 0, True, False, False, False).startswith("❓")
