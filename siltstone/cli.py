"""Command line: ``index workspace | file | lists | status``, ``retrieve search | read | eval``, ``workspace export``, ``parse`` (the default)."""

from __future__ import annotations

import argparse
import json
import os
import subprocess
import sys

from siltstone.java.chunker import parse
from siltstone.observe import configure
from siltstone.sources.workspace import export_command

SAMPLE = b"package sample;\n\n/** Says hello. */\npublic class Hello {\n    private final String name = \"you\";\n\n    public String greet() {\n        return \"Hello \" + name;\n    }\n}\n"


def _arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="siltstone")
    top.add_argument("-v", "--verbose", action="count", default=0)
    commands = top.add_subparsers(dest="command")
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--repo-root", default=".")
    common.add_argument("--index", default=".siltstone", help="folder of the index, in any store that Spark reads")
    common.add_argument("--master")
    build = argparse.ArgumentParser(add_help=False)
    build.add_argument("--workspace-json")
    build.add_argument("--resolve-binaries", action="store_true")
    build.add_argument("--jdk-home")
    build.add_argument("--batch-size", type=int, default=32)
    build.add_argument("--model", help="a trained encoder; by default hashed tokens")
    build.add_argument("--device", help="where a trained encoder runs")

    index = commands.add_parser("index").add_subparsers(dest="action", required=True)
    index.add_parser("workspace", parents=[common, build])
    one = index.add_parser("file", parents=[common, build])
    one.add_argument("file")
    lists = index.add_parser("lists", parents=[common], help="make the inverted file that searches with --probes read")
    lists.add_argument("--lists", type=int)
    index.add_parser("status", parents=[common])

    retrieve = commands.add_parser("retrieve").add_subparsers(dest="action", required=True)
    search = retrieve.add_parser("search", parents=[common])
    search.add_argument("query")
    search.add_argument("--top-k", type=int, default=5)
    for name in ("--kind", "--source-set", "--file-path"):
        search.add_argument(name)
    read = retrieve.add_parser("read", parents=[common])
    read.add_argument("chunk_id")
    read.add_argument("--no-surrounding", action="store_true")
    evaluate = retrieve.add_parser("eval", parents=[common])
    evaluate.add_argument("fixture")
    evaluate.add_argument("--top-k", type=int)
    evaluate.add_argument("--output")
    for p in (search, evaluate):
        p.add_argument("--device")
        p.add_argument("--probes", type=int, help="search by the inverted file, so many lists for each query vector, 0 for as many as were measured; by default exactly")
    for p in (search, read, evaluate):
        p.add_argument("--json", action="store_true")

    export = commands.add_parser("workspace").add_subparsers(dest="action", required=True).add_parser("export", help="have a Gradle build write its description")
    export.add_argument("gradle_root")
    export.add_argument("output")
    export.add_argument("--print", action="store_true", help="only show the command")

    show = commands.add_parser("parse")
    show.add_argument("file", nargs="?")
    show.add_argument("--workspace-json")
    show.add_argument("--resolve-jars", action="store_true")
    show.add_argument("--jdk-home")
    show.add_argument("--master")
    return top


def _parse(args: argparse.Namespace) -> None:
    if args.workspace_json and not args.file:
        raise SystemExit("--workspace-json needs a file")
    code = open(args.file, "rb").read() if args.file else SAMPLE
    for c in parse(code, args.file):
        print(f"{c['kind']:<20} {c['start_line']:>5}-{c['end_line']:<5} {'.'.join([*c['owner_chain'], c.get('name') or ''])}")
    if args.workspace_json or args.jdk_home:
        from siltstone.plans.indexing import resolution_of
        from siltstone.session import session
        from siltstone.sources.workspace import Workspace

        spark = session(master=args.master or os.environ.get("SPARK_MASTER"))
        workspace = Workspace.load(spark, args.workspace_json) if args.workspace_json else None
        for r in resolution_of(spark, os.path.abspath(args.file), workspace=workspace, binaries=args.resolve_jars, jdk_home=args.jdk_home).orderBy("type_name").collect() if args.file else ():
            print(f"{r['type_name']} -> {r['best_name']} ({r['strategy']}){' ' + ', '.join(r['candidates']) if r['candidates'] else ''}")


def _show(rows: list, as_json: bool) -> None:
    for r in rows:
        print(json.dumps(r.asDict(recursive=True)) if as_json else f"{r['rank']:>2}. {r['score']:.3f} {r['confidence']:<6} {r['symbol'] or r['chunk_id']} {r['file_path']}:{r['start_line']}-{r['end_line']}\n    {r['summary']}\n    {', '.join(r['why_matched'])}")


def main(argv: list[str] | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    if not [a for a in argv if not a.startswith("-")] and "-h" not in argv and "--help" not in argv:
        argv.append("parse")
    args = _arguments().parse_args(argv)
    configure(args.verbose)
    if args.command == "parse":
        _parse(args)
        return 0
    if args.command == "workspace":
        command = export_command(args.gradle_root, os.path.abspath(args.output))
        if args.print:
            print(" ".join(command))
            return 0
        return subprocess.run(command, cwd=args.gradle_root).returncode
    from siltstone.functions.encoder import encoder_of
    from siltstone.plans import indexing, retrieval
    from siltstone.session import session
    from siltstone.sources.store import Store
    from siltstone.sources.workspace import Workspace

    spark = session(master=args.master or os.environ.get("SPARK_MASTER"))
    root, store = os.path.abspath(args.repo_root), Store(spark, args.index)
    if args.command == "index" and args.action == "status":
        print(json.dumps(store.status() or {"status": "no index"}))
    elif args.command == "index" and args.action == "lists":
        print(json.dumps({"version": store.index_lists(args.lists)}))
    elif args.command == "index":
        workspace = Workspace.load(spark, args.workspace_json) if args.workspace_json else None
        options = {"binaries": args.resolve_binaries, "jdk_home": args.jdk_home, "encoder": encoder_of(args.model, args.device)}
        if args.action == "workspace":
            if workspace is None:
                raise SystemExit("--workspace-json is needed")
            print(json.dumps(indexing.index_workspace(spark, store, repo_root=root, workspace=workspace, batch=args.batch_size, **options)))
        else:
            print(json.dumps({"version": indexing.index_file(spark, store, os.path.abspath(args.file), repo_root=root, workspace=workspace, batch=args.batch_size, **options)}))
    elif args.action == "search":
        _show(retrieval.search_code(spark, store, args.query, top_k=args.top_k, encoder=encoder_of(store.model(), args.device), probes=args.probes, kind=args.kind, source_set=args.source_set, file_path=args.file_path).collect(), args.json)
    elif args.action == "read":
        row = retrieval.read_code(store, args.chunk_id, surrounding=not args.no_surrounding)
        if row is None:
            raise SystemExit(f"Chunk not found: {args.chunk_id}")
        print(json.dumps(row.asDict(recursive=True)) if args.json else f"{row['symbol']} {row['file_path']}:{row['start_line']}\n{row['source_text']}")
    else:
        result = retrieval.run_suite(spark, store, args.fixture, repo_root=root, top_k=args.top_k, encoder=encoder_of(store.model(), args.device), probes=args.probes)
        if args.output:
            retrieval.write_artifact(spark, result, args.output)
        print(json.dumps(result, default=str) if args.json else "\n".join(f"{k}: {v}" for k, v in result.items() if k != "results"))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
