"""Small source trees written for the tests; one engine parses and resolves them all."""

from __future__ import annotations

from codeloom.plans.engine import Engine

ALL: dict[str, dict[str, str]] = {}


def project(modules: dict[str, str]) -> str:
    """Adds a tree and returns the package it lies in; PKG in its texts stands for that package."""
    name = f"k{len(ALL)}"
    ALL[name] = {f"{name}.{m}": text.replace("PKG", name) for m, text in modules.items()}
    return name


class Found:
    """The rows of all projects."""

    def __init__(self, spark):
        rows = [(m.replace(".", "/") + ".py", m, text) for modules in ALL.values() for m, text in modules.items()]
        e = self.engine = Engine.from_texts(spark.createDataFrame(rows, "path string, module_path string, text string"))
        self._edges, self._unresolved = e.edges.orderBy("edge_ord").collect(), e.unresolved.orderBy("edge_ord").collect()
        self._entries, self._annotations, self._nodes = e.entry_points.orderBy("ep_ord").collect(), e.tables["annotations"].collect(), e.nodes.collect()

    def edges(self, name: str) -> list[dict]:
        return [r.asDict() | {"caller": r["caller"].removeprefix(name + "."), "callee": r["callee"].removeprefix(name + ".")} for r in self._edges if r["caller"].startswith(name + ".")]

    def of(self, name: str, caller: str) -> set[tuple[str, str]]:
        """(callee, strategy) of a caller's edges."""
        return {(r["callee"], r["strategy"]) for r in self.edges(name) if r["caller"] == caller}

    def unresolved(self, name: str) -> set[tuple[str, str]]:
        return {(r["name"], r["reason"]) for r in self._unresolved if r["caller"].startswith(name + ".")}

    def entries(self, name: str) -> list[tuple[str, str, str]]:
        return [(r["node_id"].removeprefix(name + ".m."), r["type"], r["trigger"]) for r in self._entries if r["node_id"].startswith(name + ".")]

    def annotations(self, name: str) -> list[dict]:
        return [r.asDict() | {"qualified_name": r["qualified_name"].removeprefix(name + ".")} for r in self._annotations if r["qualified_name"].startswith(name + ".")]

    def nodes(self, name: str) -> dict:
        return {r["qualified_name"].removeprefix(name + "."): r for r in self._nodes if r["qualified_name"].startswith(name + ".")}
