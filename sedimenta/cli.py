"""Command line over the workspace: ``python -m sedimenta.cli --root DIR COMMAND ...``."""

from __future__ import annotations

import argparse
import importlib
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from .plans.workspace import Workspace
from .sources.records import keyed_json_lines


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sedimenta")
    p.add_argument("--root", required=True, help="workspace folder")
    commands = p.add_subparsers(dest="command", required=True)

    def command(name: str, *args: str, **options):
        c = commands.add_parser(name)
        for a in args:
            c.add_argument(a)
        for o, d in options.items():
            c.add_argument(f"--{o.replace('_', '-')}", **d)

    command("create", "rows", "batch", dataset={})
    command("upsert", "dataset", "rows", "batch")
    command("rows", "state", limit={"type": int, "default": 20})
    command("compare", "older", "newer", sample={"type": int, "default": 20})
    command("inspect", "state")
    command("checkpoint", "state")
    command("select", "dataset", "state", expected={})
    command("export", "state", "destination")
    command("remove", "keep")
    command("execute", "function", "state", "batch")
    return p


def _show(rows: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in rows.collect()]


def run(args: argparse.Namespace, spark: SparkSession):
    w = Workspace(spark, args.root)
    if args.command == "create":
        state = w.create(keyed_json_lines(spark, args.rows), args.batch)
        if args.dataset:
            w.select_current(args.dataset, state, w.current(args.dataset))
        return {"state": state.id}
    if args.command == "upsert":
        return {"state": w.upsert(w.current(args.dataset), keyed_json_lines(spark, args.rows), args.batch, dataset=args.dataset).id}
    if args.command == "rows":
        return _show(w.rows(w.open(args.state)).orderBy("member_key").limit(args.limit))
    if args.command == "compare":
        counts, sample = w.compare(w.open(args.older), w.open(args.newer), sample=args.sample)
        return {"counts": _show(counts), "sample": _show(sample)}
    if args.command == "inspect":
        return w.inspect(w.open(args.state))
    if args.command == "checkpoint":
        return {"state": w.checkpoint(w.open(args.state)).id}
    if args.command == "select":
        w.select_current(args.dataset, w.open(args.state), w.open(args.expected) if args.expected else None)
        return {"dataset": args.dataset, "state": args.state}
    if args.command == "export":
        return {"pin": w.export(w.open(args.state), args.destination)}
    if args.command == "remove":
        return {"removed": w.remove_unreferenced([w.open(s) for s in args.keep.split(",")])}
    module, _, name = args.function.partition(":")
    produce = getattr(importlib.import_module(module), name)
    state = w.open(args.state)
    return {"state": w.create(produce(w.rows(state)), args.batch).id}


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("sedimenta").getOrCreate()
    print(json.dumps(run(args, spark), default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
