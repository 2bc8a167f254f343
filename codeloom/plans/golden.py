"""Registered queries over a small source tree that is written to the shared folder, read back as files, parsed,
resolved and stored; the rows that must come out are written beside each. What SQL can't derive from source text
is thus still held against SQL, as a list of values.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import last_part, short_path, truncate
from ..operators import graph
from ..sources import files, listing, store
from ..sources.parse import Tables, parse_listing
from ..storage import shared_dir
from . import reports
from .engine import Engine
from .golden_rows import ROWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Path -> content of the tree.
TREE: dict[str, bytes] = {
    "flow/__init__.py": b"",
    "flow/api.py": b'''from flask import Flask

from .jobs import refresh
from .models import Plot, find_plot

app = Flask(__name__)


@app.route("/plots", methods=["GET"])
def list_plots():
    """All plots."""
    return Plot.objects.all()


@app.get("/plots/<key>")
def show_plot(key: str):
    plot = find_plot(key)
    if plot.is_dry():
        refresh.delay(key)
    elif key:
        plot.water()
    else:
        app.logger.warning("no key")
    return plot


@app.errorhandler(404)
def missing(error):
    return render(error)


def render(error):
    return str(error)
''',
    "flow/hooks.py": b'''from .models import log


@receiver(post_save, sender="Plot")
def saved(sender):
    log("saved")


@receiver("moved", sender="Bed")
def moved(sender):
    log("moved")


@receiver(deleted)
def gone(sender):
    pass
''',
    "flow/jobs.py": b'''from typing import Optional

from .models import Plot, find_plot, log


@shared_task(queue="")
def refresh(key):
    plot = find_plot(key)
    plot.water()
    post.send(plot)


@register
def nightly(first: Optional[Plot], second: "Plot" | None, third: Plot | None, rest: list[Plot]) -> Optional[Plot]:
    """Waters whatever is dry, every night, and tells what was done in the log."""
    first.water()
    second.water()
    third.water()
    rest.water()
    walk(3)


def walk(n):
    if n:
        if n > 1:
            walk(n - 1)
        log(n)
    else:
        turn(n)


def turn(n):
    walk(n)
''',
    "flow/models.py": b'''class Plot(Model):
    def is_dry(self):
        return self.wet().get("x")

    def wet(self):
        return self.table.rows().first()

    def water(self):
        log("water")


def find_plot(key) -> Plot:
    return Plot.objects.get(key)


def log(text):
    print(text)
''',
    "flow/old.py": b"def a():\r\n    return b()\r\n\r\n\r\ndef b():\r    pass\r",
    "flow/broken.py": b"def (",
    "flow/latin.py": b"# caf\xe9\n",
    "flow/readme.txt": b"not code",
    "venv/hidden.py": b"def hidden(): pass\n",
    "tests/test_plots.py": b"def test_plots(): pass\n",
}


def values(rows: Iterable[tuple], columns: str) -> str:
    """SQL for rows."""

    def text(x) -> str:
        return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS t({columns})"


def query(columns: str, rows: Iterable[tuple] | None = None):
    """Registers a function of the stored project under its name, with the rows that it must give: these, or those in
    golden_rows."""

    def add(f: Callable[[Project], DataFrame]) -> Callable[[Project], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: _as_ints(f(project(spark)))
        ORACLES[f.__name__] = values(ROWS[f.__name__] if rows is None else rows, columns)
        return f

    return add


def _as_ints(df: DataFrame) -> DataFrame:
    """Counts as SQL's plain integers, which the lists of values have."""
    return df.withColumns({c: df[c].cast("int") for c, kind in df.dtypes if kind == "bigint"})


class Project:
    """The written tree and its engine, opened from the store."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = write_tree(spark)
        self.config = listing.Config(self.root)
        Engine.open(spark, self.config)
        self.engine = Engine.open(spark, self.config)

    def rows(self, rows: Iterable[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(list(rows), schema)

    def lines(self, text: str) -> DataFrame:
        return self.rows(enumerate(text.replace(self.root, "ROOT").splitlines()), "no int, line string")


_open: dict[str, Project] = {}


def project(spark: SparkSession) -> Project:
    """One tree for each application."""
    key = spark.sparkContext.applicationId
    if key not in _open:
        _open.clear()
        _open[key] = Project(spark)
    return _open[key]


def write_tree(spark: SparkSession) -> str:
    root = shared_dir(spark, "tree") + "/garden"
    for path, content in TREE.items():
        system, name = files.opened(f"{root}/{path}")
        system.create_dir(name.rpartition("/")[0], recursive=True)
        files.write(f"{root}/{path}", content)
    return root


# ---- files, bytes, the store

_OWN = [p for p in TREE if p.startswith("flow/") and p.endswith(".py")]


@query("config, rel_path, module_path, language, size", [(c, p, p[:-3].replace("/", "."), "python", len(TREE[p])) for c, own in (("default", _OWN), ("tests", [*_OWN, "tests/test_plots.py"]), ("all", [p for p in TREE if p.endswith(".py")])) for p in own])
def tree_listing(p: Project) -> DataFrame:
    """Which files belong to a project, by configuration: excluded folders, test folders, extensions."""
    out = None
    for name, config in (("default", p.config), ("tests", listing.Config(p.root, include_tests=True)), ("all", listing.Config(p.root, exclude=(), include_tests=True, store_dir=p.root))):
        one = listing.listing(p.spark, config).select(F.lit(name).alias("config"), "rel_path", listing.module_path(F.col("rel_path")).alias("module_path"), listing.language(F.col("path")).alias("language"), "size")
        out = one if out is None else out.unionByName(one)
    return out


@query("module_path, problem, functions, imports", [("flow.__init__", None, 0, 0), ("flow.api", None, 4, 4), ("flow.broken", "SyntaxError", 0, 0), ("flow.hooks", None, 3, 1), ("flow.jobs", None, 4, 4), ("flow.latin", "not UTF-8", 0, 0), ("flow.models", None, 6, 0), ("flow.old", None, 2, 0)])
def tree_parsed(p: Project) -> DataFrame:
    """Bytes of files as modules: line ends of three kinds, a syntax error, bytes that aren't UTF-8."""
    parsed = parse_listing(listing.listing(p.spark, p.config))
    return parsed.select("module_path", F.substring_index("parse_error", ":", 1).alias("problem"), F.size("functions").alias("functions"), F.size("imports").alias("imports"))


@query('"table", n', [("modules", 6), ("functions", 19), ("registry", 19), ("entry_points", 8), ("edges", 22), ("unresolved", 8), ("imports", 9)])
def tree_stored(p: Project) -> DataFrame:
    """Rows of the stored tables, read again."""
    tables = store.load(p.spark, p.config)
    out = None
    for t in ("modules", "functions", "registry", "entry_points", "edges", "unresolved", "imports"):
        one = tables[t].agg(F.count("*").alias("n")).select(F.lit(t).alias("table"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("step, fresh", [("stored", True), ("other configuration", False), ("newer file", False), ("no store", False), ("deleted file", True), ("broken meta file", False)])
def tree_freshness(p: Project) -> DataFrame:
    """When a stored graph is used: by times of files, configuration, and the meta file."""
    other = Project(p.spark)
    fresh = lambda c: store.fresh(p.spark, c, listing.listing(p.spark, c))
    said = [("stored", fresh(other.config)), ("other configuration", fresh(listing.Config(other.root, include_tests=True)))]
    system, name = files.opened(f"{other.root}/flow/old.py")
    system.delete_file(name)
    said.append(("deleted file", fresh(other.config)))
    said.append(("no store", fresh(listing.Config(other.root, store_dir=f"{other.root}/nowhere"))))
    files.write(f"{other.root}/flow/old.py", b"")
    said.append(("newer file", fresh(other.config)))
    files.write(f"{other.config.store}/meta.json", b"{")
    said.append(("broken meta file", fresh(other.config)))
    return p.rows(said, "step string, fresh boolean")


@query("path, argument, project, found", [("P", "refresh", "P", "refresh"), ("refresh", None, "P", "refresh"), (None, None, "P", None)])
def tree_last_project(p: Project) -> DataFrame:
    """A command's path and argument, with the last project remembered."""
    local = files.opened(shared_dir(p.spark, "pointer"))[1]
    store.remember("/", f"{local}/last")
    out = []
    for path, argument in (("/", "refresh"), ("refresh", None), (None, None)):
        got = store.project_and_argument(path, argument, f"{local}/last")
        out.append(tuple("P" if x == "/" else x for x in (path, argument, *got)))
    return p.rows(out, "path string, argument string, project string, found string")


@query("rel_path, name, target", [("flow/api.py", "Flask", None), ("flow/api.py", "Plot", "flow/models.py"), ("flow/api.py", "find_plot", "flow/models.py"), ("flow/api.py", "refresh", "flow/jobs.py"), ("flow/hooks.py", "log", "flow/models.py"), ("flow/jobs.py", "Optional", None), ("flow/jobs.py", "Plot", "flow/models.py"), ("flow/jobs.py", "find_plot", "flow/models.py"), ("flow/jobs.py", "log", "flow/models.py")])
def tree_import_files(p: Project) -> DataFrame:
    """The file that each import names."""
    found = listing.listing(p.spark, p.config)
    imports = p.engine.tables["imports"].join(found.select(F.col("path").alias("file_path"), "rel_path"), "file_path")
    below = F.expr(f"substring(target, {len(p.root) + 2})")
    return listing.import_files(imports, found).select("rel_path", "name", below.alias("target"))


# ---- what the parser knows, rules of resolution, detectors

_BY_FIRST = [("flow.api", "key", "str"), ("flow.jobs", "first", "Plot"), ("flow.jobs", "second", "Plot"), ("flow.jobs", "third", "Plot")]


@query("module_path, var, type_name", _BY_FIRST)
def tree_annotations(p: Project) -> DataFrame:
    """The types that parameters' annotations name: Optional[X], X | None and "X", but no other generics."""
    t = Tables(parse_listing(listing.listing(p.spark, p.config)), keep=False)
    return t.type_facts.where("kind = 'param'").select(F.regexp_extract("qualified_name", r"^\w+\.\w+", 0).alias("module_path"), "var", "type_name")


@query("caller, name, receiver", [("flow.models.Plot.is_dry", "get", "self.wet"), ("flow.models.Plot.is_dry", "wet", "self"), ("flow.models.Plot.wet", "first", "self.table.rows"), ("flow.models.Plot.wet", "rows", "self.table")])
def tree_receivers(p: Project) -> DataFrame:
    """What methods are called on, looking through calls in between."""
    return p.engine.tables["calls"].where("caller LIKE 'flow.models.Plot.%' AND receiver IS NOT NULL").select("caller", "name", "receiver")


_ENTRIES = [
    ("signal_handler", "Signal handler: gone", "gone", ""), ("signal_handler", "Signal: moved, sender=Bed", "moved", ""), ("signal_handler", "Signal: sender=Plot", "saved", ""),
    ("api_route", "GET /plots/<key>", "show_plot", ""), ("api_route", "ROUTE /plots", "list_plots", "All plots."), ("api_route", "ERROR 404", "missing", ""),
    ("celery_task", "Celery task: refresh", "refresh", ""), ("discovered", "@register", "nightly", "Waters whatever is dry, every night, and"),
]


@query("type, trigger, function, description", _ENTRIES)
def tree_entries(p: Project) -> DataFrame:
    """Signals with and without senders, Flask routes and error handlers, tasks and what only decorators register."""
    return p.engine.entries().drop("node_id")


@query("type, trigger", [r[:2] for r in _ENTRIES if r[0] == "api_route"])
def tree_entries_of_a_type(p: Project) -> DataFrame:
    return p.engine.entries("api_route").select("type", "trigger")


@query("caller, callee, strategy, condition", [
    ("flow.api.list_plots", "flow.models.Plot", "orm", None), ("flow.api.missing", "flow.api.render", "name", None), ("flow.api.show_plot", "flow.models.find_plot", "name", None),
    ("flow.api.show_plot", "flow.models.Plot.is_dry", "return", None), ("flow.api.show_plot", "flow.jobs.refresh", "async", "plot.is_dry()"), ("flow.api.show_plot", "flow.models.Plot.water", "return", "key"),
    ("flow.hooks.saved", "flow.models.log", "name", None), ("flow.hooks.moved", "flow.models.log", "name", None), ("flow.jobs.refresh", "flow.models.find_plot", "name", None),
    ("flow.jobs.refresh", "flow.models.Plot.water", "return", None), ("flow.jobs.nightly", "flow.models.Plot.water", "parameter", None), ("flow.jobs.nightly", "flow.models.Plot.water", "parameter", None),
    ("flow.jobs.nightly", "flow.models.Plot.water", "parameter", None), ("flow.jobs.nightly", "flow.jobs.walk", "name", None), ("flow.jobs.walk", "flow.jobs.walk", "name", "n > 1"),
    ("flow.jobs.walk", "flow.models.log", "name", None), ("flow.jobs.walk", "flow.jobs.turn", "name", "else"), ("flow.jobs.turn", "flow.jobs.walk", "name", None),
    ("flow.models.Plot.is_dry", "flow.models.Plot.wet", "self", None), ("flow.models.Plot.water", "flow.models.log", "name", None), ("flow.models.find_plot", "flow.models.Plot", "orm", None), ("flow.old.a", "flow.old.b", "name", None),
])
def tree_edges(p: Project) -> DataFrame:
    return p.engine.edges.select("caller", "callee", "strategy", "condition")


# ---- reports and payloads


@query("modules, functions, entry_points, edges, unresolved", [(6, 19, 8, 22, 8)])
def tree_totals(p: Project) -> DataFrame:
    return p.engine.totals()


@query("part, a, n")
def tree_init(p: Project) -> DataFrame:
    """The report on a project that was just read: modules by dotted path, totals, entry points."""
    parts = p.engine.init()
    modules = parts["modules"].select(F.lit("module").alias("part"), F.col("module_path").alias("a"), F.expr("functions * 10000 + classes * 100 + imports").alias("n"))
    totals = parts["totals"].select(F.lit("edges").alias("part"), F.lit("").alias("a"), F.col("edges").alias("n"))
    entries = parts["entry_points"].select(F.lit("entry").alias("part"), F.concat("trigger", F.lit(": "), "description").alias("a"), F.lit(1).alias("n"))
    return modules.unionByName(totals).unionByName(entries).withColumn("n", F.col("n").cast("int"))


@query("part, a, n")
def tree_summary(p: Project) -> DataFrame:
    parts = p.engine.summary()
    reasons, callers = parts["unresolved"].select(F.lit("reason").alias("part"), F.col("reason").alias("a"), "n"), parts["top_callers"].select(F.lit("caller").alias("part"), F.col("caller").alias("a"), "n")
    return reasons.unionByName(callers).withColumn("n", F.col("n").cast("int"))


@query('place, "group", "count", triggers, deepest_name, deepest_reachable')
def tree_scan(p: Project) -> DataFrame:
    """Flows, the largest first."""
    found = p.engine.scan().collect()
    return p.rows(((i, g["group"], g["count"], ", ".join(g["triggers"]), g["deepest_name"], g["deepest_reachable"]) for i, g in enumerate(found, 1)), "place int, `group` string, `count` int, triggers string, deepest_name string, deepest_reachable int")


@query("query, place, qualified_name, file, type, is_entry_point")
def tree_search(p: Project) -> DataFrame:
    """Hits in registry order, with short paths; an empty query finds nothing, a limit is kept."""
    out = []
    for text, limit in (("PLOT", 100), ("", 20), ("flow", 2)):
        for i, r in enumerate(p.engine.search_payload(text, limit)["results"]):
            out.append((text, i, r["qualified_name"], r["file"], r["type"], r["is_entry_point"]))
    return p.rows(out, "query string, place int, qualified_name string, file string, type string, is_entry_point boolean")


@query("caller, line, is_cross_file, condition")
def tree_callers(p: Project) -> DataFrame:
    return p.engine.callers("water")


@query("place, qualified_name, name, line_start, type, is_cross_file")
def tree_callers_payload(p: Project) -> DataFrame:
    rows = p.engine.callers_payload("flow.jobs.walk")["callers"]
    return p.rows(((i, r["qualified_name"], r["name"], r["line_start"], r["type"], r["is_cross_file"]) for i, r in enumerate(rows)), "place int, qualified_name string, name string, line_start int, type string, is_cross_file boolean")


@query("asked, what, n")
def tree_graph_route(p: Project) -> DataFrame:
    """A server's answers: traces of a depth, callers, an error for a name that isn't there, depths out of bounds."""
    out = []
    for name, depth in (("flow.jobs.nightly", 1), ("flow.jobs.nightly", 5), ("flow.jobs.walk/callers", 5), ("flow.nothing", 5), ("flow.jobs.walk", 11), ("flow.jobs.walk", 0)):
        try:
            got = p.engine.graph_route(name, depth)
            what = got.get("error") or ("callers" if "callers" in got else "trace")
            n = len(got["callers"] if "callers" in got else got["edges"])
        except ValueError as e:
            what, n = str(e), 0
        out.append((f"{name} {depth}", what, n))
    return p.rows(out, "asked string, what string, n int")


@query("kind, a, b, c")
def tree_cli_trace(p: Project) -> DataFrame:
    """The trace for files, written as JSON and read again: nodes that the walk entered, edges in its order."""
    path = shared_dir(p.spark, "trace")
    system, name = files.opened(path)
    system.create_dir(name, recursive=True)
    p.engine.write_trace("show_plot", f"{path}/t.json", 2)
    got = json.loads(files.read(f"{path}/t.json"))
    out = [("node", n, x["type"], str(x["line_start"])) for n, x in got["nodes"].items()] + [("edge", x["source"], x["target"], f"{i} {x['type']}") for i, x in enumerate(got["edges"])]
    m = got["metadata"]
    out.append(("metadata", str(m["total_nodes"]), str(m["total_edges"]), f"{m['total_files']} {m['async_boundaries']}"))
    return p.rows(out, "kind string, a string, b string, c string")


@query("kind, a, b, c")
def tree_web_trace(p: Project) -> DataFrame:
    """The trace for pages: flags, branches and conditions."""
    got = p.engine.graph_trace("flow.api.show_plot", 2)
    out = [("node", n, f"{x['has_callees']} {x['expandable']}", json.dumps(x["annotations"], sort_keys=True)) for n, x in got["nodes"].items()]
    out += [("branch", n, b["condition"], ",".join(b["calls"])) for n, x in got["nodes"].items() for b in x["branches"]]
    out += [("edge", x["source"], x["target"], x["condition"]) for x in got["edges"]]
    return p.rows(out, "kind string, a string, b string, c string")


@query("no, line")
def tree_call_tree(p: Project) -> DataFrame:
    return p.lines("\n".join(reports.trace_text(p.engine, "flow.api.show_plot", 3)))


@query("no, line")
def tree_call_tree_cycle(p: Project) -> DataFrame:
    """Cycles, the greatest depth, and a bound on lines."""
    return p.lines(p.engine.call_tree("walk", 3) + "\n--\n" + reports.call_tree(p.engine, "flow.jobs.walk", 5, most=4))


@query("no, line")
def tree_context(p: Project) -> DataFrame:
    return p.lines(p.engine.context())


@query("no, line")
def tree_flow_context(p: Project) -> DataFrame:
    return p.lines(p.engine.flow_context("refresh", 2))


@query("no, line")
def tree_skeleton(p: Project) -> DataFrame:
    return p.lines(p.engine.skeleton())


@query("kind, a, b")
def tree_overview(p: Project) -> DataFrame:
    got = p.engine.overview()
    out = [("stat", k, str(v)) for k, v in got["stats"].items()] + [("entry", kind, f"{r['trigger']} {r['module']}") for kind, rows in got["entry_points_by_type"].items() for r in rows]
    return p.rows([*out, ("name", got["project_name"], "")], "kind string, a string, b string")


class _Echo:
    """A provider for checks: it says what it was asked."""

    def complete(self, prompt: str, instructions: str = "") -> dict:
        return {"content": f"{len(instructions) > 0} {prompt.splitlines()[0]}", "model": "echo"}


@query("asked, content, model", [("all", "true ## Project skeleton", "echo"), ("flow", "true ## Flow: `flow.jobs.refresh`", "echo"), ("nobody", "no provider 'nobody'; registered: echo", None)])
def tree_explain(p: Project) -> DataFrame:
    """What a registered provider is asked about the project and about a flow."""
    reports.register_provider("echo", _Echo)
    out = []
    for asked, name in (("all", None), ("flow", "refresh")):
        said = p.engine.explain(reports.provider("echo"), name, 2)
        out.append((asked, said["content"].replace("True", "true"), said["model"]))
    try:
        reports.provider("nobody")
    except LookupError as e:
        out.append(("nobody", e.args[0], None))
    return p.rows(out, "asked string, content string, model string")


@query("no, line")
def tree_prompt(p: Project) -> DataFrame:
    """The prompt about a flow: figures, the trace as JSON (counted here), the source of its key functions."""
    text = p.engine.prompt("refresh", 2)
    head, _, rest = text.partition("```json\n")
    payload, _, rest = rest.partition("\n```")
    return p.lines(f"{head}{len(json.loads(payload)['edges'])} edges{rest}")


@query("path, short, text, cut", [("/a/b/c/d.py", "b/c/d.py", "x" * 70, "x" * 60 + "..."), ("c/d.py", "c/d.py", "short", "short"), ("d.py", "d.py", "", "..."), ("/d.py", "/d.py", None, "...")])
def short_texts(p: Project) -> DataFrame:
    rows = p.rows([("/a/b/c/d.py", "x" * 70), ("c/d.py", "short"), ("d.py", ""), ("/d.py", None)], "path string, text string")
    return rows.select("path", short_path(F.col("path")).alias("short"), "text", truncate(F.col("text")).alias("cut"))


@query("function, degree")
def tree_degree(p: Project) -> DataFrame:
    """The best connected nodes, the root first."""
    found = graph.node_degree(p.engine.edges, "flow.jobs.turn", 4).collect()
    return p.rows(((f"{i} {r['node']}", r["degree"]) for i, r in enumerate(found)), "function string, degree int").select(last_part(F.col("function")).alias("function"), "degree")
