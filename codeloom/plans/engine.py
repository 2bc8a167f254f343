"""A project from its files to its graph, and the questions that it answers."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import last_part, parent, short_path
from ..operators import graph, group
from ..operators.detectors import annotations, entry_points
from ..operators.index import Index
from ..operators.resolve import Resolved
from ..sources import files, listing, store
from ..sources.parse import Tables, parse_listing, parse_texts
from ..storage import written
from . import reports


class Engine:
    """A parsed and resolved project; every method returns a DataFrame, a dict or text."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], name: str = "project"):
        self.spark, self.tables, self.name = spark, tables, name
        self.modules, self.functions, self.nodes = tables["modules"], tables["functions"], tables["registry"]
        self.edges, self.unresolved, self.entry_points = tables["edges"], tables["unresolved"], tables["entry_points"]

    @classmethod
    def from_tables(cls, spark: SparkSession, t: Tables, name: str = "project") -> Engine:
        index = Index(t)
        resolved = Resolved(t.calls, index)
        found = entry_points(t.functions, t.imports)
        more = graph.discover(index.registry, resolved.edges, found)
        late = more.select(F.struct(F.lit(1).alias("found"), F.col("reg_ord.file_path").alias("file_path"), F.lit(0).alias("detector"), F.col("reg_ord.func_ord").alias("func_ord")).alias("ep_ord"), F.col("qualified_name").alias("node_id"), F.lit("discovered").alias("type"), "trigger", F.col("docstring").alias("description"))
        return cls(spark, {
            "modules": t.modules, "functions": t.functions, "registry": index.registry, "branches": t.branches, "calls": t.calls, "imports": t.imports, "edges": resolved.edges, "unresolved": resolved.unresolved,
            "entry_points": found.unionByName(late), "annotations": annotations(t.calls),
        }, name)

    @classmethod
    def from_texts(cls, files: DataFrame, name: str = "project") -> Engine:
        """files: (path, module_path, text)"""
        return cls.from_tables(files.sparkSession, Tables(parse_texts(files)), name)

    @classmethod
    def open(cls, spark: SparkSession, config: listing.Config, use_store: bool = True, fresh: bool = False) -> Engine:
        """The stored graph if it is fresh, else (or with ``fresh``) a new one, which is stored unless use_store is false."""
        found = written(listing.listing(spark, config), "listing")
        name = os.path.basename(files.absolute(config.root))
        if use_store and not fresh and store.fresh(spark, config, found) and (tables := store.load(spark, config)):
            return cls(spark, tables, name)
        engine = cls.from_tables(spark, Tables(parse_listing(found)), name)
        if use_store:
            store.save(config, engine.tables)
            engine = cls(spark, store.load(spark, config), name)
        return engine

    def find(self, name: str) -> str:
        found = graph.find(self.nodes, name)
        if found is None:
            raise LookupError(f"no function is named {name!r}")
        return found

    # ---- tables

    def modules_report(self) -> DataFrame:
        """A row for each module, by its dotted path; classes count among functions."""
        return self.modules.select("module_path", F.col("n_functions").alias("functions"), F.col("n_classes").alias("classes"), F.col("n_imports").alias("imports"), "file_path").orderBy("module_path")

    def init(self) -> dict[str, DataFrame]:
        """Modules, totals and entry points: the report on a project that was just read."""
        return {"modules": self.modules_report(), "totals": self.totals(), "entry_points": self.entry_points.orderBy("ep_ord").select("type", "trigger", F.coalesce("description", F.lit("")).alias("description"))}

    def totals(self) -> DataFrame:
        """One row of counts; functions that share a name all count."""
        count = lambda df, name: df.agg(F.count("*").alias(name))
        out = count(self.modules, "modules")
        for df, name in ((self.functions, "functions"), (self.entry_points, "entry_points"), (self.edges, "edges"), (self.unresolved, "unresolved")):
            out = out.crossJoin(count(df, name))
        return out

    def summary(self) -> dict[str, DataFrame]:
        return {"totals": self.totals(), "unresolved": group.reason_counts(self.unresolved), "top_callers": group.top_callers(self.edges)}

    def entries(self, kind: str | None = None) -> DataFrame:
        rows = self.entry_points if kind is None else self.entry_points.where(F.col("type") == kind)
        return rows.select("type", "trigger", last_part(F.col("node_id")).alias("function"), F.substring(F.coalesce("description", F.lit("")), 1, 40).alias("description"), "node_id").orderBy("type", "trigger", "node_id")

    def search(self, query: str, limit: int = 20) -> DataFrame:
        """Hits with the last parts of their file's path and line, and whether they are entry points."""
        hits = graph.search(self.nodes, query, limit)
        known = self.entry_points.select(F.col("node_id").alias("qualified_name")).distinct().withColumn("is_entry_point", F.lit(True))
        return hits.join(known, "qualified_name", "left").fillna(False, ["is_entry_point"]).orderBy("reg_ord").select("qualified_name", "name", short_path(F.col("file_path")).alias("file"), "line_start", "type", "is_entry_point")

    def callers(self, name: str) -> DataFrame:
        return self.edges.where(F.col("callee") == self.find(name)).orderBy("edge_ord").select("caller", "line", "is_cross_file", "condition")

    def callers_payload(self, qualified_name: str) -> dict:
        rows = graph.callers_payload(self.edges, self.nodes, qualified_name).orderBy("edge_ord").drop("edge_ord")
        return {"target": qualified_name, "callers": [r.asDict() for r in rows.collect()]}

    def search_payload(self, query: str, limit: int = 20) -> dict:
        """At most 100 hits; nothing is asked for by an empty query, and nothing found."""
        if not query:
            return {"query": "", "results": []}
        return {"query": query, "results": [r.asDict() for r in self.search(query, min(limit, 100)).collect()]}

    def graph_route(self, name: str, depth: int = 5) -> dict:
        """What a server answers for a qualified name: its trace, its callers if ``/callers`` follows, or an error."""
        if not 1 <= depth <= 10:
            raise ValueError("depth must be 1 to 10")
        if name.endswith("/callers"):
            return self.callers_payload(name.rsplit("/callers", 1)[0])
        if not self.nodes.where(F.col("qualified_name") == name).limit(1).count():
            return {"error": f"Function '{name}' not found", "nodes": {}, "edges": []}
        return self.graph_trace(name, depth)

    # ---- flows

    def _ids(self) -> DataFrame:
        return self.entry_points.select(F.col("node_id").alias("id"), F.col("ep_ord").alias("ord"), "type", "trigger")

    def scan(self) -> DataFrame:
        """Flows: entry points grouped by domain, the largest first."""
        return group.group_stats(group.domain_groups(self._ids()), self.edges).orderBy(F.desc("count"), "first")

    def trace(self, name: str, depth: int = 10) -> dict:
        """The trace for files: without conditions, branches and flags."""
        return reports.trace_payload(self, self.find(name), depth, conditions=False)

    def graph_trace(self, qualified_name: str, depth: int = 5) -> dict:
        """The payload of a depth-first trace: nodes, edges, metadata."""
        return reports.trace_payload(self, qualified_name, depth)

    def call_tree(self, name: str, depth: int = 10) -> str:
        return reports.call_tree(self, self.find(name), depth)

    def overview(self) -> dict:
        totals = self.totals().first()
        rows = self.entry_points.withColumn("module", parent(F.col("node_id"))).orderBy("ep_ord").drop("ep_ord").collect()
        by_type: dict[str, list[dict]] = {}
        for r in rows:
            by_type.setdefault(r["type"], []).append(r.asDict())
        stats = {f"total_{k}": totals[k] for k in ("modules", "functions", "edges", "unresolved", "entry_points")}
        return {"project_name": self.name, "stats": stats, "entry_points_by_type": by_type}

    def context(self) -> str:
        return reports.codebase_context(self)

    def flow_context(self, name: str, depth: int = 5) -> str:
        return reports.flow_context(self, self.find(name), depth)

    def prompt(self, name: str, depth: int = 5) -> str:
        return reports.narration_prompt(self, self.find(name), depth)

    def explain(self, by: reports.Provider, name: str | None = None, depth: int = 5) -> dict:
        return reports.explain(self, by, None if name is None else self.find(name), depth)

    def skeleton(self) -> str:
        return reports.skeleton(self)

    def write_trace(self, name: str, path: str, depth: int = 10) -> None:
        files.write(path, json.dumps(self.trace(name, depth), indent=2, default=str).encode())
