"""Command line: python -m concord.plans.cli --src ns=path --dst ns=path --folder F [--checkOnly]. A JSON or YAML file may hold the same settings."""

from __future__ import annotations

import argparse
import json
import logging
import sys
import time
from pathlib import Path

from concord.model import DdlPolicy, Method, Options
from concord.session import session
from concord.sources.catalog import parquet_side

from .api import Server
from .engine import Engine


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="concord", description=__doc__)
    p.add_argument("--configFile", help="JSON, or YAML if a YAML parser is installed")
    p.add_argument("--src", action="append", default=[], metavar="NAMESPACE=PATH", help="Parquet table of the source")
    p.add_argument("--dst", action="append", default=[], metavar="NAMESPACE=PATH", help="Parquet table of the destination")
    p.add_argument("--srcNamespace", action="append", default=[], help="source namespaces to compare, comma-separated or repeated")
    p.add_argument("--dstNamespace", action="append", default=[], help="their names on the destination, in the same order")
    p.add_argument("--folder", help="where mismatches, tasks and rechecks are kept")
    p.add_argument("--key", action="append", default=[], help="key fields besides the first; dotted paths descend")
    p.add_argument("--docCompareMethod", default="ignoreOrder", choices=[m.value for m in Method] + ["ignoreFieldOrder"])
    p.add_argument("--partitioningScheme", default="id", choices=["id", "natural"])
    p.add_argument("--partitionSizeMB", type=int, default=0, help="size of the key ranges that a large table is compared in; 0: 400")
    p.add_argument("--numWorkers", type=int, default=10, help="tables or key ranges that are compared at a time")
    p.add_argument("--generationPauseDelay", type=int, default=1000, help="milliseconds between generations while writes go on")
    p.add_argument("--srcFeed", help="folder of the source's change events (JSON files)")
    p.add_argument("--dstFeed", help="folder of the destination's change events (JSON files)")
    p.add_argument("--srcChangeReader", default="feed", choices=["feed", "log"], help="format of the source's change events")
    p.add_argument("--dstChangeReader", default="feed", choices=["feed", "log"], help="format of the destination's change events")
    p.add_argument("--ddlHandling", default="fail", choices=[d.value for d in DdlPolicy], help="what schema events of the source do")
    p.add_argument("--ddlUntil", metavar="SECONDS[,ORDINAL]", help="logical time up to which schema events of the source are old news, as after a restart")
    p.add_argument("--drainSeconds", type=float, default=600.0, help="how long feeds are waited for that haven't come to where writes went off")
    p.add_argument("--indexSpecIgnore", action="append", default=[], help="parts of index specifications that may differ")
    p.add_argument("--verifyAll", action=argparse.BooleanOptionalAction, default=True, help="compare time series, too")
    p.add_argument("--logPath", default="stdout")
    p.add_argument("--logLevel", default="info", choices=["debug", "info", "warn", "error"])
    p.add_argument("--failureDisplaySize", type=int, default=20)
    p.add_argument("--filter", help="query document (JSON) or SQL predicate")
    p.add_argument("--strictNamespaces", action="store_true")
    p.add_argument("--serverPort", type=int, default=27020)
    p.add_argument("--checkOnly", action="store_true", help="compare once, report, and end")
    p.add_argument("--start", action="store_true", help="start the check without waiting for POST /check")
    p.add_argument("--clean", action="store_true", help="drop what an earlier run left")
    return p


def config(path: str) -> dict:
    text = Path(path).read_text()
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError:
        raise SystemExit("no YAML parser is installed; use a .json file") from None
    return yaml.safe_load(text) or {}


def parse(argv: list[str]) -> argparse.Namespace:
    p = parser()
    args = p.parse_args(argv)
    if args.configFile:
        given = config(args.configFile)
        unknown = given.keys() - vars(args).keys()
        if unknown:
            p.error(f"unknown settings: {', '.join(sorted(unknown))}")
        p.set_defaults(**given)
        args = p.parse_args(argv)
    split = lambda values: [x for v in values for x in v.split(",") if x]
    args.srcNamespace, args.dstNamespace = split(args.srcNamespace), split(args.dstNamespace)
    if args.dstNamespace and len(args.dstNamespace) != len(args.srcNamespace):
        p.error("as many --dstNamespace as --srcNamespace are needed")
    return args


def options(args: argparse.Namespace) -> Options:
    text = args.filter
    query = json.loads(text) if isinstance(text, str) and text.lstrip().startswith("{") else text
    until = tuple(int(x) for x in f"{args.ddlUntil},0".split(",")[:2]) if args.ddlUntil else None
    pairs = dict(zip(args.srcNamespace, args.dstNamespace or args.srcNamespace, strict=True))
    return Options(
        method=args.docCompareMethod, natural=args.partitioningScheme == "natural", keys=tuple(args.key) or ("_id",), filter=query, namespaces=pairs, strict_namespaces=args.strictNamespaces,
        partition_bytes=(args.partitionSizeMB or 400) << 20, src_ddl=args.ddlHandling, index_tolerances=tuple(x for v in args.indexSpecIgnore for x in v.split(",") if x), failure_display_size=args.failureDisplaySize,
        workers=args.numWorkers, pause_seconds=args.generationPauseDelay / 1000, verify_all=args.verifyAll, ddl_until=until, drain_seconds=args.drainSeconds,
    )


def main(argv: list[str] | None = None) -> int:
    args = parse(sys.argv[1:] if argv is None else argv)
    if not args.folder or not args.src or not args.dst:
        parser().error("--folder, --src and --dst are needed")
    spark = session()
    table = lambda pairs: dict(p.split("=", 1) for p in pairs)
    logging.basicConfig(level={"warn": "WARNING"}.get(args.logLevel, args.logLevel.upper()), format="%(message)s", **({"stream": sys.stdout} if args.logPath == "stdout" else {"filename": args.logPath}))
    side = lambda name: parquet_side(spark, table(getattr(args, name)), feed=getattr(args, f"{name}Feed"), feed_kind=getattr(args, f"{name}ChangeReader"))
    engine = Engine(side("src"), side("dst"), args.folder, options(args))
    if args.clean:
        engine.clean()
    if args.checkOnly:
        print(engine.document_counts())
        began = time.monotonic()
        engine.run_generation()
        engine.finish_generation()
        print(engine.report(time.monotonic() - began))
        return int(not engine.reported().isEmpty())
    server = Server(engine, args.serverPort)
    if args.start:
        server._post_check({}, {})
    print(f"listening on {server.port}")
    server.http.serve_forever()
    return 0


if __name__ == "__main__":
    sys.exit(main())
