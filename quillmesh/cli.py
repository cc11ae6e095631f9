"""Command line: python -m quillmesh.cli COMMAND; results as JSON on one line."""

from __future__ import annotations

import argparse
import json
import os
import sys

from quillmesh.catalog import Catalog
from quillmesh.errors import EngineError


def parse_param(text: str):
    """``key=value`` at the first ``=``; the value is JSON, else text."""
    key, sep, value = text.partition("=")
    if not sep or not key:
        raise argparse.ArgumentTypeError(f"{text!r} is not key=value")
    try:
        return key, json.loads(value)
    except ValueError:
        return key, value


def _positive(text: str) -> int:
    value = int(text)
    if value < 1:
        raise argparse.ArgumentTypeError("must be positive")
    return value


def build_parser() -> argparse.ArgumentParser:
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("--config", default=argparse.SUPPRESS, help="configuration folder")
    shared.add_argument("--vault", default=argparse.SUPPRESS, help="vault to use")
    top = argparse.ArgumentParser(prog="quillmesh", parents=[shared])
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *options) -> None:
        p = sub.add_parser(name, parents=[shared])
        for args, kwargs in options:
            p.add_argument(*args, **kwargs)

    full = (["--full"], {"action": "store_true"})
    type_ = (["--type"], {"dest": "type_"})
    limit = (["--limit"], {"type": _positive, "default": 10})
    model = (["--embedder"], {})
    command("index", full, (["--re-resolve"], {"action": "store_true"}), (["--postings"], {"action": "store_true"}))
    command("embed", full, model)
    command("search", (["text"], {}), type_, limit, (["--hybrid"], {"action": "store_true"}), model)
    command("similar", (["text"], {}), type_, limit, model)
    command("get", (["id"], {}), (["--body"], {"action": "store_true"}))
    command("links", (["id"], {}), type_)
    command("backlinks", (["id"], {}), type_)
    command("query", (["cypher"], {}), (["--param"], {"action": "append", "type": parse_param, "default": []}))
    command("types")
    command("edges")
    vault = sub.add_parser("vault", parents=[shared]).add_subparsers(dest="action", required=True)
    add = vault.add_parser("add", parents=[shared])
    add.add_argument("name")
    add.add_argument("path")
    vault.add_parser("list", parents=[shared])
    vault.add_parser("remove", parents=[shared]).add_argument("name")
    return top


def rows_of(df) -> list[dict]:
    """A small result as JSON objects with explicit nulls."""
    return [r.asDict(recursive=True) for r in df.collect()]


def execute(args: argparse.Namespace, spark):
    """The JSON value of a command."""
    from quillmesh.functions.embedders import select_embedder
    from quillmesh.plans.embed_run import run_embed
    from quillmesh.plans.index_run import run_index

    catalog = Catalog(spark, getattr(args, "config", None) or os.environ.get("QUILLMESH_HOME", "~/.quillmesh"))
    if args.command == "vault":
        if args.action == "add":
            made = catalog.add(args.name, args.path)
            return {"name": made.name, "path": made.source}
        if args.action == "remove":
            catalog.remove(args.name)
            return {"removed": args.name}
        return catalog.list()
    v = catalog.vault(getattr(args, "vault", None))
    chosen = getattr(args, "embedder", None)
    embedder = select_embedder(chosen) if chosen else None
    if args.command == "index":
        return run_index(v, args.full, args.re_resolve, args.postings).as_dict()
    if args.command == "embed":
        return run_embed(v, embedder, args.full).as_dict()
    if args.command == "search":
        return rows_of(v.hybrid(args.text, args.type_, args.limit, embedder) if args.hybrid else v.search(args.text, args.type_, args.limit))
    if args.command == "similar":
        return rows_of(v.similar(args.text, args.type_, args.limit, embedder))
    if args.command == "get":
        return v.get(args.id, args.body)
    if args.command in ("links", "backlinks"):
        return rows_of(getattr(v, args.command)(args.id, args.type_))
    if args.command == "query":
        df = v.query(args.cypher, dict(args.param))
        return {"columns": df.columns, "rows": rows_of(df)}
    kind = {"types": "types", "edges": "edge_types"}[args.command]
    name = {"types": "type", "edges": "edge_type"}[args.command]
    return [{name: k, "count": n} for k, n in sorted(v.ontology()[kind].items())]


def main(argv: list[str] | None = None, spark=None) -> int:
    args = build_parser().parse_args(argv)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("quillmesh").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        value = execute(args, spark)
    except EngineError as e:
        print(json.dumps({"error": {"code": e.code, "message": str(e)}}), file=sys.stderr)
        return e.exit_status
    except Exception as e:
        print(json.dumps({"error": {"code": "internal", "message": str(e)[:2000]}}), file=sys.stderr)
        return 1
    print(json.dumps(value, ensure_ascii=False, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
