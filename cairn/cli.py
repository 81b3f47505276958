"""Command line: python -m cairn.cli COMMAND ..."""

from __future__ import annotations

import argparse
import json
import shlex
import sys

from cairn.kb import KnowledgeBase
from cairn.plans.build import build
from cairn.plans.config import BuildError, Config
from cairn.search.index import expand_kinds
from cairn.session import get_session


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cairn")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *args: tuple, kb: bool = True) -> None:
        p = sub.add_parser(name)
        if kb:
            p.add_argument("-k", "--kb", required=True)
        for names, options in args:
            p.add_argument(*names, **options)

    number = lambda name, default: ([name], {"type": int, "default": default})
    command("build", (["repo"], {}), (["-o", "--output"], {"required": True}), (["--graph"], {}), (["-w", "--workspace"], {}), (["--graph-command"], {"help": "program that writes the graph; {repo} stands for the repository"}), (["--no-build-graph"], {"action": "store_true"}), (["--rebuild"], {"action": "store_true"}), (["--agents-doc"], {"action": "store_true"}), (["--no-agents-doc"], {"action": "store_true"}), (["--strict"], {"action": "store_true"}), (["-v", "--verbose"], {"action": "store_true"}), kb=False)
    for name in ("validate", "inspect", "stats"):
        command(name)
    command("symbols", (["name"], {"nargs": "?"}), (["--kind"], {}), number("--limit", 25), (["--coverage"], {"action": "store_true"}))
    command("query", (["text"], {}), number("--limit", 10), (["--kind"], {}))
    command("context", (["text"], {}), number("--limit", 8), (["--kind"], {}), (["--show"], {"action": "store_true"}))
    command("ask", (["text"], {}), (["--repo"], {"default": "."}), number("--limit", 8), number("--hops", 1), number("--max-symbols", 40), number("--max-lines", 60), number("--code-budget", 2000), (["--show"], {"action": "store_true"}))
    command("api", (["--controllers"], {"action": "store_true"}))
    command("db", (["table"], {"nargs": "?"}))
    return top


#: Up to so many symbols of a name are shown in full.
FEW = 5


def detail(row) -> str:
    """All that is known of a symbol, a line each."""
    return "\n".join(f"{k}: {', '.join(v) if isinstance(v, list) else v}" for k, v in row.asDict().items() if v not in (None, "", []))


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = get_session()
    if a.command == "build":
        try:
            command = None if a.no_build_graph or not a.graph_command else tuple(shlex.split(a.graph_command))
            config = Config(a.repo, a.graph, a.output, a.strict, workspace=a.workspace, graph_command=command, rebuild=a.rebuild, agents_doc=a.agents_doc and not a.no_agents_doc)
            out, said = build(spark, config, print if a.verbose else None)
        except BuildError as e:
            print(e, file=sys.stderr)
            return 1
        for row in said.issues.orderBy("level", "code", "message").toLocalIterator():
            print(*row)
        print(json.dumps(KnowledgeBase(spark, catalog=out).stats(), default=str))
        return 0
    kb = KnowledgeBase(spark, a.kb)
    match a.command:
        case "validate":
            rows = kb.validate().collect()
            for r in rows:
                print(*r)
            return int(any(r["level"] == "error" for r in rows))
        case "inspect":
            kb.inspect().show(200, False)
        case "stats":
            print(json.dumps(kb.stats(), default=str))
        case "symbols":
            few = kb.symbols(a.name, a.kind, FEW + 1).collect() if a.name and not a.coverage else []
            if 0 < len(few) <= FEW:
                for row in few:
                    print(detail(row), end="\n\n")
            else:
                (kb.coverage() if a.coverage else kb.symbols(a.name, a.kind, a.limit)).show(a.limit, False)
        case "query":
            kb.query(a.text, a.limit, expand_kinds(a.kind)).show(a.limit, False)
        case "context":
            got = kb.context(a.text, a.limit, expand_kinds(a.kind))
            print(got["text"] if a.show else got["tokens"])
        case "ask":
            got = kb.hybrid(a.text, a.repo, a.limit, a.hops, a.max_symbols, a.max_lines, a.code_budget)
            print(got["text"] if a.show else {k: v for k, v in got.items() if k != "text"})
        case "api":
            kb.apis(a.controllers).show(200, False)
        case "db":
            if a.table:
                print(kb.table(a.table))
            else:
                kb.technologies().show(100, False)
                kb.tables().select("name", "technology", "source_file").show(200, False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
