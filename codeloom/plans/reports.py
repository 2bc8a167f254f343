"""Payloads and texts for people and language models. They are small: only what is shown is collected."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING, Protocol

from pyspark.sql import functions as F

from ..functions.names import snippet
from ..operators import graph, group
from ..sources import files

if TYPE_CHECKING:
    from .engine import Engine


class Provider(Protocol):
    """Something that turns a prompt into text; none comes with the engine. ``complete`` returns a dict with
    ``content`` and, if it likes, ``model`` and ``usage``."""

    def complete(self, prompt: str, instructions: str = "") -> dict: ...


_PROVIDERS: dict[str, Callable[[], Provider]] = {}


def register_provider(name: str, make: Callable[[], Provider]) -> None:
    _PROVIDERS[name] = make


def provider(name: str) -> Provider:
    """The registered provider of a name; LookupError names those that there are."""
    if name not in _PROVIDERS:
        raise LookupError(f"no provider {name!r}; registered: {', '.join(sorted(_PROVIDERS)) or 'none'}")
    return _PROVIDERS[name]()


def _plain(row) -> dict:
    return row.asDict(recursive=True)


def trace_payload(e: Engine, root: str, depth: int, conditions: bool = True) -> dict:
    """entry_point, nodes, edges and metadata of a depth-first trace.

    Without ``conditions``, edges have no condition and nodes no branches and flags, and only nodes that the walk
    entered with some depth left are there."""
    nodes, edges = graph.trace(e.nodes, e.edges, root, depth)
    edge_rows = edges.orderBy("seq").collect()
    notes = {r["qualified_name"]: {k: v for k, v in _plain(r).items() if k != "qualified_name" and v is not None} for r in e.tables["annotations"].join(nodes.select("qualified_name"), "qualified_name", "left_semi").collect()}
    branches: dict[str, list[dict]] = {}
    if conditions:
        last = nodes.select("qualified_name", "file_path")
        for r in e.tables["branches"].join(last, ["qualified_name", "file_path"], "left_semi").orderBy("file_path", "func_ord", "branch_ord").collect():
            branches.setdefault(r["qualified_name"], []).append({"condition": r["condition"], "line": r["line"], "calls": [c["name"] for c in r["calls"]], "is_else": r["is_else"]})
    level = {root: 0} if depth > 0 else {}
    for r in edge_rows:  # in the walk's order a caller comes after the edge that it was entered by
        if level[r["caller"]] + 1 < depth:
            level.setdefault(r["callee"], level[r["caller"]] + 1)
    out: dict[str, dict] = {}
    for r in nodes.orderBy("reg_ord").collect():
        name = r["qualified_name"]
        if not conditions and name not in level:
            continue
        out[name] = {"name": r["name"], "qualified_name": name, "file": r["file_path"], "line_start": r["line_start"], "line_end": r["line_end"], "type": r["type"], "decorators": r["decorators"], "docstring": r["docstring"], "annotations": notes.get(name, {})}
        if conditions:
            out[name] |= {"has_callees": r["has_callees"], "branches": branches.get(name, []), "expandable": r["expandable"]}
    listed = []
    for r in edge_rows:
        row = {"source": r["caller"], "target": r["callee"], "type": "async_dispatch" if r["is_async_dispatch"] else "calls", "async_type": r["async_type"], "is_cross_file": r["is_cross_file"], "line": r["line"]}
        listed.append(row | ({"condition": r["condition"]} if conditions else {}))
    files = sorted({n["file"] for n in out.values()})
    counts = {"total_nodes": len(out), "total_edges": len(listed), "files_touched": files, "total_files": len(files), "async_boundaries": sum(x["type"] == "async_dispatch" for x in listed)}
    return {"entry_point": root, "nodes": out, "edges": listed, "metadata": counts}


def _short(name: str) -> str:
    return name.rpartition(".")[2]


def call_tree(e: Engine, root: str, depth: int, most: int = 10_000) -> str:
    """All simple paths from a root as an indented tree, and each function's branches below its calls.

    The tables of what lies within depth are gathered once; the tree is written node by node and ends after ``most``
    lines, with a last one that says so, since the number of paths can grow exponentially with depth.
    """
    near = graph.reach(e.edges, e.spark.createDataFrame([(root,)], "root string"), depth).where(F.col("distance") <= most)
    # breadth first, as many as a tree of that many lines can show
    names = near.orderBy("distance", "node").limit(most + 1).select(F.col("node").alias("qualified_name"))
    nodes = {r["qualified_name"]: r for r in e.nodes.join(names, "qualified_name", "left_semi").select("qualified_name", "name", "file_path").collect()}
    out: dict[str, list] = {}
    for r in graph.callees(e.edges, names).orderBy("edge_ord").limit(20 * most).collect():
        out.setdefault(r["caller"], []).append(r)
    branches: dict[str, list] = {}
    # of functions that share a name, the last one's branches, as in the registry
    last = e.nodes.join(names, "qualified_name", "left_semi").select("qualified_name", "file_path")
    for r in e.tables["branches"].join(last, ["qualified_name", "file_path"], "left_semi").orderBy("file_path", "func_ord", "branch_ord").limit(20 * most).collect():
        branches.setdefault(r["qualified_name"], []).append(r)

    def grow(name: str, left: int, path: tuple[str, ...], pad: str) -> Iterator[str]:
        if left <= 0:
            yield f"{pad}... (max depth)"
            return
        if name in path:
            yield f"{pad}↻ cycle → {_short(name)}"
            return
        path = (*path, name)
        firsts: dict[str, object] = {}
        for x in out.get(name, ()):
            firsts.setdefault(x["name"], x)
            if x["callee"] in nodes:
                dispatch = f" ({x['async_type']})" if x["is_async_dispatch"] and x["async_type"] else ""
                where = f" [{'/'.join(nodes[x['callee']]['file_path'].split('/')[-3:])}]" if x["is_cross_file"] else ""
                yield f"{pad}{'⚡' if x['is_async_dispatch'] else '→'} {nodes[x['callee']]['name']}{dispatch}{where}"
                yield from grow(x["callee"], left - 1, path, pad + "  ")
        for b in branches.get(name, ()):
            text = b["condition"] or ""
            yield f"{pad}├─ " + ("else" if b["is_else"] else "if " + (text[:60] + "..." if len(text) > 60 else text or "..."))
            for call in b["calls"]:
                hit = firsts.get(call["name"])
                if hit is not None and hit["callee"] in nodes:
                    yield f"{pad}  {'⚡' if call['is_async'] else '→'} {nodes[hit['callee']]['name']}"
                    yield from grow(hit["callee"], left - 1, path, pad + "    ")
                else:
                    owner = f"{call['receiver']}." if call["receiver"] else ""
                    yield f"{pad}  → {owner}{call['name']}() (unresolved)"

    lines = [nodes[root]["name"] if root in nodes else root]
    for line in grow(root, depth, (), "  "):
        if len(lines) >= most:
            lines.append(f"... (more than {most} lines)")
            break
        lines.append(line)
    return "\n".join(lines)


def _counts(e: Engine) -> list[str]:
    t = e.totals().first()
    return [f"Modules: {t['modules']}", f"Functions: {t['functions']}", f"Entry points: {t['entry_points']}", f"Resolved call edges: {t['edges']}"]


def _by_type(e: Engine, samples: int, indent: str = "  - ") -> list[str]:
    shown: dict[str, list[str]] = {}
    for r in group.type_samples(e.entry_points, samples).orderBy("type", "rn").collect():
        shown.setdefault(r["type"], []).append(r["sample"])
    out = []
    for r in group.type_counts(e.entry_points).collect():
        out += [f"**{r['type']}** ({r['n']}):", *(indent + s for s in shown.get(r["type"], [])), ""]
    return out


def _ranked(rows) -> list[str]:
    return [f"  {r['n']:>3}  {r[0]}" for r in rows.collect()]


def skeleton(e: Engine) -> str:
    """What a language model needs to explain the whole project."""
    parts = ["## Project skeleton", "", *_counts(e), "", "### Entry points, by type", "", *_by_type(e, 5), "### Functions that call most", "", *_ranked(group.top_functions(e.nodes, e.edges)), "", "### Largest packages", "", *_ranked(group.package_histogram(e.modules))]
    return "\n".join(parts)


def flow_lines(i: int, g) -> list[str]:
    """A flow of ``Engine.scan`` for people."""
    kinds = ", ".join(f"{n} {k}" for k, n in sorted(g["types"].items(), key=lambda kn: (-kn[1], kn[0])))
    rest = f", +{g['count'] - 3} more" if g["count"] > 3 else ""
    out = [f"{i:>2}. {g['group']} ({g['count']} entry points: {kinds})", f"    {', '.join(g['triggers'])}{rest}"]
    return [*out, f"    Deepest: {g['deepest_name']} → {g['deepest_reachable']} functions"] if g["deepest_reachable"] > 1 else out


def trace_text(e: Engine, root: str, depth: int) -> list[str]:
    """What is known of a function, its call tree, and how much is reachable from it."""
    payload = trace_payload(e, root, depth, conditions=False)
    own = e.edges.where(F.col("caller") == root).agg(F.count("*").alias("n"), F.count_if("is_cross_file").alias("cross"), F.count_if("is_async_dispatch").alias("dispatched")).first()
    node = e.nodes.where(F.col("qualified_name") == root).first()
    m = payload["metadata"]
    return [
        f"Found: {root}", f"File: {node['file_path']}:{node['line_start']}", f"Decorators: {', '.join(node['decorators']) or 'none'}",
        f"Outgoing calls: {own['n']} ({own['cross']} cross-file, {own['dispatched']} async)", "", *call_tree(e, root, depth).splitlines(), "",
        f"Reachable: {m['total_nodes']} functions across {m['total_files']} files",
    ]


def codebase_context(e: Engine, flows: int = 20) -> str:
    lines = [f"# {e.name}: codebase analysis", "", *_counts(e), "", "## Flows", ""]
    for i, g in enumerate(e.scan().limit(flows).collect(), 1):
        kinds = ", ".join(f"{n} {k}" for k, n in sorted(g["types"].items(), key=lambda kn: (-kn[1], kn[0])))
        rest = f", +{g['count'] - 3} more" if g["count"] > 3 else ""
        lines += [f"### {i}. {g['group']} ({g['count']} entry points: {kinds})", f"  Endpoints: {', '.join(g['triggers'])}{rest}"]
        reached = g["deepest_reachable"]
        lines += [f"  Deepest: {g['deepest_name']} → {reached} functions", ""] if reached > 1 else [""]
    lines += ["## Entry points by type", "", *_by_type(e, 8), "## Top functions by outgoing calls", "", *_ranked(group.top_functions(e.nodes, e.edges)), "", "## Package structure", "", *_ranked(group.package_histogram(e.modules))]
    return "\n".join(lines)


def read_texts(paths: list[str]) -> dict[str, str]:
    """The files that can be read."""
    out = {}
    for p in paths:
        try:
            out[p] = files.read(p).decode()
        except (OSError, UnicodeDecodeError):
            continue
    return out


def snippets(e: Engine, payload: dict, most: int, texts: dict[str, str] | None = None) -> dict[str, str]:
    """The source of the trace's best connected nodes, the root first, 60 lines each at most."""
    nodes, root = payload["nodes"], payload["entry_point"]
    degree: dict[str, int] = {}
    for x in payload["edges"]:
        for end in (x["source"], x["target"]):
            degree[end] = degree.get(end, 0) + 1
    order = [root, *sorted((n for n in nodes if n != root), key=lambda n: -degree.get(n, 0))][:most]
    rows = [(n, nodes[n]["file"], nodes[n]["line_start"], nodes[n]["line_end"]) for n in order if n in nodes]
    if texts is None:
        texts = read_texts(sorted({r[1] for r in rows}))
    rows = [(n, texts[f], a, b) for n, f, a, b in rows if f in texts and a]
    if not rows:
        return {}
    cut = e.spark.createDataFrame(rows, "name string, text string, a int, b int").select("name", snippet(F.col("text"), F.col("a"), F.col("b")).alias("s"))
    found = {r["name"]: r["s"] for r in cut.collect() if r["s"]}
    return {n: found[n] for n in order if n in found}


def _meta(payload: dict) -> str:
    m = payload["metadata"]
    return f"Nodes: {m['total_nodes']} | Edges: {m['total_edges']} | Files: {m['total_files']} | Async boundaries: {m['async_boundaries']}"


def flow_context(e: Engine, root: str, depth: int = 5, texts: dict[str, str] | None = None) -> str:
    payload = trace_payload(e, root, depth)
    node = payload["nodes"].get(root, {})
    lines = [f"# {root}: flow analysis", ""]
    if node:
        lines.append(f"File: {node['file']}:{node['line_start']}")
        if node["decorators"]:
            lines.append(f"Decorators: {', '.join(node['decorators'])}")
    lines += [_meta(payload), "", "## Call graph", ""]
    for x in payload["edges"]:
        target = payload["nodes"].get(x["target"], {})
        cross = " (cross-file)" if x["is_cross_file"] else ""
        condition = f" [condition: {x['condition']}]" if x["condition"] else ""
        lines.append(f"  {_short(x['source'])} → {_short(x['target'])}{cross}{condition}  # {target.get('file', '').rpartition('/')[2]}")
    if node.get("branches"):
        lines += ["", "## Conditional branches", ""]
        lines += [f"  {'else' if b['is_else'] else 'if ' + (b['condition'] or '?')} → {', '.join(b['calls']) or '(no calls)'}" for b in node["branches"]]
    source = snippets(e, payload, 8, texts)
    if source:
        lines += ["", "## Source code", ""]
        lines += [f"### {_short(n)} (`{n}`)\n```python\n{s}\n```\n" for n, s in source.items()]
    return "\n".join(lines)


def narration_prompt(e: Engine, root: str, depth: int = 5, texts: dict[str, str] | None = None) -> str:
    payload = trace_payload(e, root, depth)
    parts = [f"## Flow: `{root}`", "", _meta(payload), "", "## Graph", "", f"```json\n{json.dumps(payload, indent=2, default=str)}\n```"]
    source = snippets(e, payload, 5, texts)
    if source:
        parts += ["", "## Source of the key functions", "", *(f"### `{n}`\n```python\n{s}\n```\n" for n, s in source.items())]
    return "\n".join(parts)


EXPLAIN_PROJECT = "You are given the skeleton of a Python project: entry points, call graph figures, packages. Explain to a new developer what the application does, how it is organised and which its main flows are. Name packages and entry points. At most 500 words."
EXPLAIN_FLOW = "You are given one flow of a Python project: its call graph and the source of its key functions. Tell a developer step by step what happens, with its conditions and asynchronous parts."


def explain(e: Engine, by: Provider, root: str | None = None, depth: int = 5, texts: dict[str, str] | None = None) -> dict:
    """What a provider says about the whole project, or about the flow of one function."""
    if root is None:
        return by.complete(skeleton(e), EXPLAIN_PROJECT)
    return by.complete(narration_prompt(e, root, depth, texts), EXPLAIN_FLOW)
