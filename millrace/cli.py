"""Command line over the engine."""

from __future__ import annotations

import argparse
import datetime
import json
import sys
from pathlib import Path

from millrace import config as configuration
from millrace import templates

STARTER = {
    "project": {"name": "my-project"},
    "data_sources": [{"name": "docs", "type": "local", "config": {"path": "./docs"}}],
    "chunking": {"strategy": "auto", "max_chunk_size": 512, "overlap": 50},
    "embedding": {"model": "local/dev", "dimensions": 384},
    "retrieval": {"method": "hybrid", "top_k": 5},
}


def _engine(args):
    from pyspark.sql import SparkSession

    from millrace.engine import Engine

    spark = SparkSession.builder.appName("millrace").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return Engine(spark, configuration.load(args.config), args.folder)


def _now() -> str:
    return datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%d %H:%M:%S")


def _init(args) -> int:
    path = Path(args.config)
    if path.exists() and not args.force:
        print(f"{path} exists; --force overwrites it")
        return 1
    path.write_text(json.dumps(STARTER, indent=2), "utf-8")
    print(f"wrote {path}")
    return 0


def _show(df, n: int = 20) -> int:
    for row in df.limit(n).collect():
        print(json.dumps(row.asDict(recursive=True), default=str, ensure_ascii=False))
    return 0


def _ingest(args) -> int:
    return _show(_engine(args).ingest(None, _now()))


def _query(args) -> int:
    engine = _engine(args)
    asked = engine.spark.createDataFrame([(0, args.text)], "query_id long, query string")
    for row in engine.query_logged(asked, _now(), k=args.top_k or 0, expand=args.expand).orderBy("rank").collect():
        print(f"{row['rank']}. {row['score']:.4f} {row['source']}\n   {row['content'][:200]}")
    return 0


def _eval(args) -> int:
    if not Path(args.golden).exists():
        print(f"{args.golden} doesn't exist")
        return 1
    return _show(_engine(args).evaluate(args.golden, _now()))


def _analytics(args) -> int:
    from millrace.operators import oplog

    log = _engine(args).query_log()
    _show(oplog.analytics_summary(log))
    if args.zero_results:
        _show(oplog.zero_results(log))
    if args.low_confidence:
        _show(oplog.low_confidence(log, args.threshold))
    return 0


def _cost(args) -> int:
    from pyspark.sql import functions as F

    engine = _engine(args)
    _show(engine.cost_report(_now()))
    return _show(engine.costs().orderBy(F.desc("ts")).limit(10))


def _optimize(args) -> int:
    from millrace.operators import oplog

    return _show(oplog.embedding_share(_engine(args).costs()))


def _status(args) -> int:
    c = configuration.load(args.config)
    print(f"{c.project_name} {c.project_version}: {len(c.data_sources)} sources, {c.chunking.strategy} chunks of {c.chunking.max_chunk_size}, {c.embedding.model} ({c.embedding.dimensions}), {c.retrieval.method} top {c.retrieval.top_k}")
    return 0


def _deploy(args) -> int:
    c = configuration.for_environment(configuration.load(args.config), args.env)
    print(json.dumps(templates.serverless(c, args.env), indent=2))
    return 0


def _eject(args) -> int:
    out = Path(args.output)
    out.mkdir(parents=True, exist_ok=True)
    c = configuration.load(args.config)
    (out / "template.json").write_text(json.dumps(templates.serverless(c, "prod"), indent=2), "utf-8")
    (out / "workflow.json").write_text(json.dumps(templates.workflow(c), indent=2), "utf-8")
    print(f"wrote {out}")
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="millrace")
    p.add_argument("--config", default="millrace.json")
    p.add_argument("--folder", default="millrace-data")
    sub = p.add_subparsers(dest="command")
    add = lambda name, f: (s := sub.add_parser(name), s.set_defaults(run=f))[0]
    add("init", _init).add_argument("--force", action="store_true")
    add("ingest", _ingest)
    q = add("query", _query)
    q.add_argument("text")
    q.add_argument("--top-k", type=int)
    q.add_argument("--expand", action="store_true")
    add("eval", _eval).add_argument("golden")
    a = add("analytics", _analytics)
    a.add_argument("--zero-results", action="store_true")
    a.add_argument("--low-confidence", action="store_true")
    a.add_argument("--threshold", type=float, default=0.5)
    add("cost", _cost)
    add("optimize", _optimize)
    add("status", _status)
    add("deploy", _deploy).add_argument("--env", default="dev", choices=configuration.ENVIRONMENTS)
    add("eject", _eject).add_argument("--output", default="deploy")
    return p


def main(argv: list[str] | None = None) -> int:
    p = parser()
    args = p.parse_args(argv)
    if not args.command:
        p.print_help()
        return 0
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())
