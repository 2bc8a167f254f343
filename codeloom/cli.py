"""The command line: ``python -m codeloom COMMAND [PATH] [ARGUMENT]``.

Without a path, commands take the project that was scanned last; a path that doesn't exist is then the argument.
"""

from __future__ import annotations

import argparse
import importlib
import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import reports
from .plans.engine import Engine
from .sources import store
from .sources.listing import Config

POINTER = os.path.join(os.path.expanduser("~"), ".codeloom", "last_project")

Print = Callable[[str], None]


def table(df: DataFrame, titles: tuple[str, ...], out: Print) -> int:
    """Prints the rows of a report in columns; returns how many there are."""
    rows = [[("" if x is None else "yes" if x is True else "" if x is False else str(x)) for x in r] for r in df.collect()]
    widths = [max(len(t), *(len(r[i]) for r in rows)) if rows else len(t) for i, t in enumerate(titles)]
    for r in [list(titles), *rows]:
        out("  ".join(x.ljust(w) for x, w in zip(r, widths)).rstrip())
    return len(rows)


def init(e: Engine, a: argparse.Namespace, out: Print) -> None:
    parts = e.init()
    table(parts["modules"].drop("file_path"), ("Module", "Functions", "Classes", "Imports"), out)
    t = parts["totals"].first()
    out(f"{t['modules']} modules, {t['functions']} functions; {t['edges']} resolved calls, {t['unresolved']} unresolved")
    out(f"Entry points: {table(parts['entry_points'], ('Type', 'Trigger', 'Description'), out)}")


def scan(e: Engine, a: argparse.Namespace, out: Print) -> None:
    t = e.totals().first()
    out(f"{t['modules']} modules, {t['functions']} functions, {t['entry_points']} entry points, {t['edges']} resolved calls")
    rows = e.scan().limit(a.limit + 1).collect()
    for i, g in enumerate(rows[: a.limit], 1):
        for line in reports.flow_lines(i, g):
            out(line)
    if len(rows) > a.limit:
        out("... and more groups")


def summary(e: Engine, a: argparse.Namespace, out: Print) -> None:
    parts = e.summary()
    table(parts["totals"], ("Modules", "Functions", "Entry points", "Edges", "Unresolved"), out)
    table(parts["unresolved"], ("Unresolved because", "Calls"), out)
    table(parts["top_callers"], ("Caller", "Calls"), out)


def entries(e: Engine, a: argparse.Namespace, out: Print) -> None:
    out(f"{table(e.entries(a.type).drop('node_id'), ('Type', 'Trigger', 'Function', 'Description'), out)} entry points")


def search(e: Engine, a: argparse.Namespace, out: Print) -> None:
    hits = e.search(a.argument or "", a.limit)
    n = table(hits.selectExpr("qualified_name", "type", "concat(file, ':', line_start)"), ("Function", "Type", "File"), out)
    out(f"{n} results for {a.argument!r}")


def callers(e: Engine, a: argparse.Namespace, out: Print) -> None:
    out(f"Callers of {e.find(a.argument)}")
    if not table(e.callers(a.argument), ("Caller", "Line", "Cross-file", "Condition"), out):
        out("none: this may be an entry point")


def trace(e: Engine, a: argparse.Namespace, out: Print) -> None:
    for line in reports.trace_text(e, e.find(a.argument), a.depth):
        out(line)
    if a.output:
        e.write_trace(a.argument, a.output, a.depth)
        out(f"written to {a.output}")


def context(e: Engine, a: argparse.Namespace, out: Print) -> None:
    out(e.context() if a.argument is None else e.flow_context(a.argument, a.depth))


def explain(e: Engine, a: argparse.Namespace, out: Print) -> None:
    for module in a.plugin:
        importlib.import_module(module)
    said = e.explain(reports.provider(a.provider), a.argument, a.depth)
    out(said["content"])
    if said.get("model"):
        out(f"Model: {said['model']}")


COMMANDS = {"init": init, "scan": scan, "summary": summary, "entries": entries, "search": search, "callers": callers, "trace": trace, "context": context, "explain": explain}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="codeloom", description=__doc__.splitlines()[0])
    commands = out.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        p = commands.add_parser(name)
        p.add_argument("path", nargs="?")
        if name in ("search", "callers", "trace", "context", "explain"):
            p.add_argument("argument", nargs="?")
        p.add_argument("--include-tests", action="store_true")
        if name in ("search", "scan"):
            p.add_argument("--limit", "-l", type=int, default=20 if name == "search" else 15)
        if name in ("trace", "context", "explain"):
            p.add_argument("--depth", "-d", type=int, default=10 if name == "trace" else 5)
        if name == "trace":
            p.add_argument("--output", "-o")
        if name == "entries":
            p.add_argument("--type", "-t")
        if name == "explain":
            p.add_argument("--provider", default="default", help="name of a registered provider")
            p.add_argument("--plugin", action="append", default=[], help="module that registers providers when it is imported")
    return out


def run(args: list[str], spark: SparkSession | None = None, pointer: str = POINTER, out: Print = print) -> int:
    """One command; 1 if what it asks for isn't there."""
    a = parser().parse_args(args)
    wants = hasattr(a, "argument")
    try:
        if a.command == "scan" and a.path:
            store.remember(a.path, pointer)
        path, argument = store.project_and_argument(a.path, a.argument if wants else None, pointer)
        if wants:
            a.argument = argument
        if wants and a.command in ("search", "callers", "trace") and not a.argument:
            raise ValueError(f"{a.command} needs a name")
        session = spark or SparkSession.builder.appName("codeloom").config("spark.ui.showConsoleProgress", "false").getOrCreate()
        e = Engine.open(session, Config(path, include_tests=a.include_tests), fresh=a.command == "scan")
        COMMANDS[a.command](e, a, out)
    except (LookupError, ValueError) as error:
        out(f"error: {error.args[0] if error.args else error}")
        return 1
    return 0


def main() -> None:
    sys.exit(run(sys.argv[1:]))
