"""Command line: ``exec`` runs SQL on a database, ``bench`` fills one and times the benchmark's queries."""

from __future__ import annotations

import argparse
import sys
import time

from logstrata.database import Database, Options
from logstrata.errors import EngineError
from logstrata.sources import workload


def _exec(args: argparse.Namespace) -> None:
    with Database.open(args.database, Options(query_threads=args.query_threads)) as db:
        for result in db.execute_sql(args.sql):
            if result.frame is not None:
                print(result.show())


def _bench(args: argparse.Namespace) -> None:
    with Database.open(args.database, Options(row_group_size=32768, sync_on_flush=False, query_threads=args.query_threads)) as db:
        db.execute_sql(workload.CREATE)
        data = workload.logs(db.spark, args.rows).toArrow()
        began = time.perf_counter()
        db.insert_columnar_batch("logs", data)
        db.flush_all()
        took = time.perf_counter() - began
        print(f"ingest: {args.rows} rows in {took:.3f} s ({args.rows / took:.0f} rows/s)")
        for name, sql in workload.QUERIES.items():
            began = time.perf_counter()
            rows = db.execute_one(sql).rows()
            print(f"{name}: {len(rows)} rows in {time.perf_counter() - began:.3f} s")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="logstrata")
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("exec", help="run SQL")
    run.add_argument("database")
    run.add_argument("sql")
    run.set_defaults(run=_exec)
    bench = commands.add_parser("bench", help="fill a table of logs and time six queries")
    bench.add_argument("database")
    bench.add_argument("rows", type=int, nargs="?", default=1_000_000)
    bench.set_defaults(run=_bench)
    for command in (run, bench):
        command.add_argument("--query-threads", type=int)
    args = parser.parse_args(argv)
    try:
        args.run(args)
    except EngineError as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    return 0
