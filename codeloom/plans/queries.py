"""The registered queries: every operator over the driver's whole tables, with the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names as fn
from ..operators import detectors, graph, group
from ..operators import index as ix
from ..operators import resolve
from ..operators.resolve import best_candidate
from ..schemas import FUNCTION
from ..sources import store
from ..sources.parse import Tables
from . import golden, roundtrip
from .tabular import CUSTOMER, CUSTOMERS, EDGES, NODES, PLACES, SUPPLIER, View, _pad

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_WITH = f"WITH nodes AS MATERIALIZED ({NODES}), edges AS MATERIALIZED ({EDGES}), customers AS MATERIALIZED ({CUSTOMERS}) "


def query(sql: str | None):
    """Registers a function of a View under its name, with the SQL of its result."""

    def add(f: Callable[[View], DataFrame]) -> Callable[[View], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(View(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- neighbours, reach and paths


@query(_WITH + "SELECT callee, caller, condition, edge_ord FROM edges WHERE callee LIKE 'p.%'")
def callers_of_part(v: View) -> DataFrame:
    return graph.callers(v.edges(), v.sql("SELECT 'p.' || CAST(p_partkey AS STRING) AS qn FROM part")).select("callee", "caller", "condition", "edge_ord")


@query(_WITH + "SELECT caller, callee, name, edge_ord FROM edges WHERE caller IN (SELECT qn FROM customers)")
def callees_of_customer(v: View) -> DataFrame:
    return graph.callees(v.edges(), v.sql(CUSTOMERS)).select("caller", "callee", "name", "edge_ord")


@query(_WITH + "SELECT n.qualified_name, '@' || n.label AS trigger FROM nodes n WHERE n.type <> 'class' AND n.label <> 'MACHINERY' AND NOT EXISTS (SELECT 1 FROM customers WHERE qn = n.qualified_name AND c_mktsegment = 'BUILDING') AND EXISTS (SELECT 1 FROM edges WHERE caller = n.qualified_name) AND NOT EXISTS (SELECT 1 FROM edges WHERE callee = n.qualified_name)")
def topology_entries(v: View) -> DataFrame:
    known = v.sql(f"SELECT qn AS node_id FROM ({CUSTOMERS}) WHERE c_mktsegment = 'BUILDING'")
    return graph.discover(v.nodes(), v.edges(), known, ("MACHINERY",)).select("qualified_name", "trigger")


_LEVELS = """, l1 AS (SELECT DISTINCT c.qn AS root, e.callee AS node FROM customers c JOIN edges e ON e.caller = c.qn),
l2 AS (SELECT DISTINCT root, e.callee AS node FROM l1 JOIN edges e ON e.caller = node), l3 AS (SELECT DISTINCT root, e.callee AS node FROM l2 JOIN edges e ON e.caller = node),
l4 AS (SELECT DISTINCT root, e.callee AS node FROM l3 JOIN edges e ON e.caller = node), l5 AS (SELECT DISTINCT root, e.callee AS node FROM l4 JOIN edges e ON e.caller = node) """


@query(_WITH.rstrip() + _LEVELS + "SELECT root, count(*) AS reachable FROM (SELECT qn AS root, qn AS node FROM customers UNION SELECT * FROM l1 UNION SELECT * FROM l2 UNION SELECT * FROM l3 UNION SELECT * FROM l4 UNION SELECT * FROM l5) GROUP BY root")
def reach_depth5(v: View) -> DataFrame:
    return graph.reach_counts(v.edges(), v.sql(CUSTOMERS), 5)


_USERS = "SELECT CAST(user_id AS STRING) AS caller, CAST(lead(user_id) OVER (ORDER BY event_id) AS STRING) AS callee, event_id AS edge_ord FROM events"


@query(f"WITH e AS (SELECT DISTINCT caller, callee FROM ({_USERS}) WHERE callee IS NOT NULL), r AS (SELECT DISTINCT caller AS root FROM ({_USERS})), a AS (SELECT root, callee AS node FROM r JOIN e ON caller = root), b AS (SELECT DISTINCT root, e.callee AS node FROM a JOIN e ON e.caller = a.node) SELECT root, node, CAST(min(d) AS INTEGER) AS distance FROM (SELECT root, root AS node, 0 AS d FROM r UNION ALL SELECT root, node, 1 FROM a UNION ALL SELECT root, node, 2 FROM b) GROUP BY root, node")
def reach_cyclic(v: View) -> DataFrame:
    rows = v.sql(_USERS)
    return graph.reach(rows.where("callee IS NOT NULL"), rows.select("caller"), 2)


@query(_WITH + "SELECT root, path, CAST(NULL AS VARCHAR) AS ends, 1 AS level FROM (SELECT caller AS root, caller || '>' || callee AS path FROM edges JOIN customers ON caller = qn) UNION ALL SELECT a.caller, a.caller || '>' || b.caller || '>' || b.callee, NULL, 2 FROM edges a JOIN customers ON a.caller = qn JOIN edges b ON b.caller = a.callee UNION ALL SELECT a.caller, a.caller || '>' || b.caller || '>' || c.caller || '>' || c.callee, 'depth', 3 FROM edges a JOIN customers ON a.caller = qn JOIN edges b ON b.caller = a.callee JOIN edges c ON c.caller = b.callee")
def simple_paths_depth3(v: View) -> DataFrame:
    return graph.paths(v.edges(), v.sql(CUSTOMERS), 3).select("root", F.array_join("path", ">").alias("path"), "ends", "level")


@query(_WITH.rstrip() + _LEVELS + ", inside AS (SELECT qn AS root, qn AS node FROM customers UNION SELECT * FROM l1 UNION SELECT * FROM l2), h AS MATERIALIZED (SELECT caller, callee, edge_ord, CAST('0x' || substr(md5(edge_ord), 1, 8) AS BIGINT) AS h FROM edges) SELECT root, count(*) AS n_edges, count(DISTINCT callee) AS n_callees, min(edge_ord) AS first_edge, max(edge_ord) AS last_edge, CAST(sum(h) AS BIGINT) AS hash FROM inside JOIN h ON caller = node GROUP BY root")
def dfs_edges(v: View) -> DataFrame:
    """A row for each root with what tells its edges. In these tables a node has one distance from a root, so depth-first
    and breadth-first see the same ones."""
    edges = v.edges()
    nodes, roots = graph.dfs_expanded(edges, v.sql(CUSTOMERS), 3)
    h = F.conv(F.substring(F.md5("edge_ord"), 1, 8), 16, 10).cast("long")
    each = graph.graph_of(edges).known.groupBy(F.col("caller_id").alias("caller")).agg(F.count("*").alias("n"), F.min("edge_ord").alias("first"), F.max("edge_ord").alias("last"), F.sum(h).alias("h"))
    out = nodes.join(each, "caller").groupBy(F.col("root").alias("id")).agg(F.sum("n").alias("n_edges"), F.max("n_callees").alias("n_callees"), F.min("first").alias("first_edge"), F.max("last").alias("last_edge"), F.sum("h").alias("hash"))
    return out.join(roots, "id").select("root", "n_edges", "n_callees", "first_edge", "last_edge", "hash")


@query(f"SELECT 's.' || CAST(s_suppkey AS STRING) AS class, m.c_mktsegment AS method, CASE WHEN bool_or(m.n_name = p.n_name) THEN 'n.' || p.n_name ELSE 'r.' || p.r_name END AS owner FROM (SELECT * FROM supplier JOIN {PLACES} ON s_nationkey = n_nationkey) p JOIN (SELECT DISTINCT c_mktsegment, n_name, r_name FROM ({CUSTOMERS}) WHERE c_acctbal > 5000) m ON m.r_name = p.r_name GROUP BY s_suppkey, m.c_mktsegment, p.n_name, p.r_name")
def mro_first_match(v: View) -> DataFrame:
    """Suppliers inherit from their nation, then their region; a segment is a method of where its rich customers live."""
    places = f"SELECT * FROM supplier JOIN {PLACES} ON s_nationkey = n_nationkey"
    bases = v.sql(f"SELECT 's.' || CAST(s_suppkey AS STRING) AS class, 0 AS base_ord, 'n.' || n_name AS base FROM ({places}) UNION ALL SELECT 'n.' || n_name, 0, 'r.' || r_name FROM {PLACES}")
    rich = f"({CUSTOMERS}) WHERE c_acctbal > 5000"
    methods = v.sql(f"SELECT DISTINCT 'n.' || n_name AS owner, c_mktsegment AS method FROM {rich} UNION SELECT DISTINCT 'r.' || r_name, c_mktsegment FROM {rich}")
    return ix.first_inherited(ix.mro(bases), methods).where("class LIKE 's.%'")


# ---- lookup tables and resolution


@query("SELECT o_custkey AS qualified_name, min(o_orderkey) AS first_ord, arg_max(o_totalprice, o_orderkey) AS price FROM orders GROUP BY o_custkey")
def registry_last_wins(v: View) -> DataFrame:
    rows = v.sql("SELECT o_custkey AS qualified_name, 'f' AS file_path, o_orderkey AS func_ord, o_totalprice AS price FROM orders")
    return ix.registry(rows).select("qualified_name", F.col("reg_ord.func_ord").alias("first_ord"), "price")


@query("SELECT CAST(o_custkey AS STRING) AS module_path, o_orderstatus AS local_name, 'o.' || CAST(arg_max(o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 1000000000000 ELSE 0 END + o_orderkey) AS STRING) AS qn FROM orders GROUP BY 1, 2")
def import_index_last_wins(v: View) -> DataFrame:
    """Urgent orders stand for a module's own functions, the others for its imports."""
    rows = v.sql("SELECT CAST(o_custkey AS STRING) AS module_path, o_orderstatus AS n, o_orderkey AS at, 'o.' || CAST(o_orderkey AS STRING) AS q, o_orderpriority LIKE '1%' AS own FROM orders")
    return ix.import_index(rows.where("NOT own").selectExpr("module_path", "n AS local_name", "q AS target", "at AS import_ord"), rows.where("own").selectExpr("module_path", "n AS name", "q AS qualified_name", "at AS func_ord"))


@query(f"WITH f AS ({CUSTOMERS}), i AS (SELECT r_name || '.' || n_name AS base, 'cust' || CAST(s_suppkey AS STRING) AS name, CAST(s_suppkey AS INTEGER) AS import_ord FROM supplier JOIN {PLACES} ON s_nationkey = n_nationkey UNION ALL SELECT r_name, n_name, CAST(1000000 + n_nationkey AS INTEGER) FROM {PLACES}) SELECT import_ord, CASE WHEN base || '.' || name IN (SELECT qn FROM f) OR base || '.' || name IN (SELECT r_name || '.' || n_name FROM f) THEN base || '.' || name END AS target FROM i")
def import_candidates_priority(v: View) -> DataFrame:
    functions = v.sql(f"SELECT qn AS qualified_name, r_name || '.' || n_name AS module_path, 'cust' || CAST(c_custkey AS STRING) AS name, CAST(c_custkey AS INT) AS func_ord FROM ({CUSTOMERS})")
    rows = v.sql(f"SELECT r_name || '.' || n_name AS module, 'cust' || CAST(s_suppkey AS STRING) AS name, CAST(s_suppkey AS INT) AS import_ord FROM supplier JOIN {PLACES} ON s_nationkey = n_nationkey UNION ALL SELECT r_name, n_name, CAST(1000000 + n_nationkey AS INT) FROM {PLACES}")
    rows = rows.selectExpr("'app.py' AS file_path", "'app' AS module_path", "import_ord", "module", "name", "CAST(NULL AS STRING) AS alias", "false AS is_relative", "0 AS level")
    types = v.spark.createDataFrame([], "module_path string, var string, type_name string")
    return ix.resolve_imports(rows, functions, types).select("import_ord", "target")


@query(_WITH + "SELECT o_orderkey AS key_id, CASE WHEN a.qualified_name IS NOT NULL THEN 10 WHEN b.qualified_name IS NOT NULL THEN 20 ELSE 30 END AS priority, coalesce(a.qualified_name, b.qualified_name, 'free.' || o_orderstatus) AS qn FROM orders LEFT JOIN nodes a ON a.qualified_name = 'p.' || CAST(o_orderkey AS STRING) LEFT JOIN nodes b ON b.qualified_name = 's.' || CAST(o_custkey AS STRING)")
def resolve_priority(v: View) -> DataFrame:
    each = v.sql("SELECT o_orderkey AS key_id, 10 AS priority, 'name' AS kind, 'p.' || CAST(o_orderkey AS STRING) AS key FROM orders UNION ALL SELECT o_orderkey, 20, 'name', 's.' || CAST(o_custkey AS STRING) FROM orders UNION ALL SELECT o_orderkey, 30, 'free', 'free.' || o_orderstatus FROM orders")
    targets = v.nodes().select(F.lit("name").alias("kind"), F.col("qualified_name").alias("key"), F.col("qualified_name").alias("qn"))
    return best_candidate(each, targets, ["key_id"])


@query(_WITH + "SELECT n_name || '.cust' || CAST(c_custkey AS STRING) AS suffix, qn FROM customers")
def suffix_lookup(v: View) -> DataFrame:
    return ix.suffix_index(v.sql(f"SELECT qn AS qualified_name, c_custkey AS reg_ord FROM ({CUSTOMERS})"))


@query(_WITH + "SELECT prefix, count(*) AS n FROM (SELECT r_name AS prefix FROM customers UNION ALL SELECT r_name || '.' || n_name FROM customers) GROUP BY prefix")
def prefix_lookup(v: View) -> DataFrame:
    return v.sql(CUSTOMERS).select(F.explode(fn.ancestors(F.col("qn"))).alias("prefix")).groupBy("prefix").agg(F.count("*").alias("n"))


@query(_WITH + "SELECT qualified_name, CASE WHEN qualified_name = 'cust11' THEN 0 WHEN qualified_name LIKE '%.cust11' THEN 1 ELSE 2 END AS rank FROM nodes WHERE contains(qualified_name, 'cust11')")
def name_rank_lookup(v: View) -> DataFrame:
    return graph.name_rank(v.nodes(), "cust11").select("qualified_name", "rank")


@query(f"SELECT c.n_name AS nation, count(*) FILTER (s.n_name <> c.n_name) AS cross_file, count(*) FILTER (s.n_name = c.n_name) AS same_file FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN ({CUSTOMERS}) c ON o_custkey = c.c_custkey JOIN (SELECT s_suppkey, n_name FROM supplier JOIN {PLACES} ON s_nationkey = n_nationkey) s ON l_suppkey = s.s_suppkey GROUP BY c.n_name")
def edge_cross_group(v: View) -> DataFrame:
    rows = v.sql(f"SELECT c.n_name AS nation, c.r_name || '.' || c.n_name AS module_path, s.q AS callee FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN ({CUSTOMERS}) c ON o_custkey = c.c_custkey JOIN (SELECT s_suppkey, {SUPPLIER} AS q FROM supplier JOIN {PLACES} ON s_nationkey = n_nationkey) s ON l_suppkey = s.s_suppkey")
    calls = rows.selectExpr("*", "'f' AS file_path", "0 AS func_ord", "-1 AS branch", "0 AS call_ord", "nation AS caller", "CAST(NULL AS STRING) AS condition", "'x' AS name", "CAST(NULL AS STRING) AS receiver", "1 AS line", "0 AS args_count", "false AS is_method_call", "false AS is_async_dispatch", "CAST(NULL AS STRING) AS async_type", "70 AS priority")
    return resolve.edges(calls).groupBy(F.col("caller").alias("nation")).agg(F.count_if("is_cross_file").alias("cross_file"), F.count_if(~F.col("is_cross_file")).alias("same_file"))


@query("SELECT CASE WHEN l_linestatus = 'F' THEN 'else' ELSE 'flag == ' || l_returnflag END AS condition, count(*) AS n FROM lineitem GROUP BY 1")
def edge_condition(v: View) -> DataFrame:
    """Every order is a function, every line a branch of it with one call."""
    branch = "named_struct('condition', 'flag == ' || l_returnflag, 'line', 1, 'is_else', l_linestatus = 'F', 'calls', array(named_struct('name', 'f', 'receiver', CAST(NULL AS STRING), 'is_method_call', false, 'args_count', 0, 'line', 1)))"
    orders = v.sql(f"SELECT CAST(l_orderkey AS STRING) AS file_path, collect_list({branch}) AS branches FROM lineitem GROUP BY l_orderkey")
    empty = {"qualified_name": "file_path", "branches": "branches"}
    kind = T._parse_datatype_string(FUNCTION)
    body = ", ".join(f"'{x.name}', {empty.get(x.name) or f'CAST(NULL AS {x.dataType.simpleString()})'}" if x.name != "calls" else f"'calls', CAST(array() AS {x.dataType.simpleString()})" for x in kind.fields)
    parsed = orders.selectExpr("file_path", "'m' AS module_path", "CAST(NULL AS STRING) AS parse_error", f"array(named_struct({body})) AS functions")
    return Tables(parsed, keep=False).calls.groupBy("condition").agg(F.count("*").alias("n"))


_NAMES = ("print", "get", "error", "format", "append", "checkout", "delay", "chain", "apply_async", "si")
_NAMED = "SELECT event_id, user_id, event_type, CASE CAST(event_id % 10 AS INT) " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_NAMES)) + " END AS name, value > 50 AS is_method_call FROM events"
_REASON = "CASE WHEN name IN ('print', 'format') THEN 'builtin' WHEN name IN ('get', 'append') THEN 'builtin_method' WHEN name = 'error' THEN 'logging' ELSE 'not_in_project' END"


@query(f"SELECT event_id, name, {_REASON} AS reason FROM ({_NAMED})")
def reason_chain(v: View) -> DataFrame:
    return v.sql(_NAMED).select("event_id", "name", fn.unresolved_reason(F.col("name")).alias("reason"))


@query(f"SELECT {_REASON} AS reason, count(*) AS n FROM ({_NAMED}) GROUP BY 1")
def reason_counts(v: View) -> DataFrame:
    return group.reason_counts(v.sql(_NAMED).select(fn.unresolved_reason(F.col("name")).alias("reason")))


@query(f"SELECT event_id, CASE WHEN is_method_call THEN CASE name WHEN 'delay' THEN 'celery_delay' WHEN 'si' THEN 'celery_delay' WHEN 'apply_async' THEN 'celery_apply_async' END ELSE CASE name WHEN 'chain' THEN 'celery_chain' END END AS async_type FROM ({_NAMED})")
def async_marks(v: View) -> DataFrame:
    return v.sql(_NAMED).select("event_id", fn.async_type(F.col("name"), F.col("is_method_call")).alias("async_type"))


_ORM = "SELECT CAST(user_id AS STRING) AS caller, event_id AS call_ord, CASE event_type WHEN 'view' THEN 'get' WHEN 'purchase' THEN 'create' WHEN 'click' THEN 'send' WHEN 'error' THEN 'delete' ELSE 'connect' END AS name, 'M' || event_type || '.objects' AS receiver FROM events"


@query(f"SELECT caller AS qualified_name, arg_max(CASE name WHEN 'get' THEN 'read' WHEN 'create' THEN 'write' ELSE 'delete' END, call_ord) FILTER (name IN ('get', 'create', 'delete')) AS orm_operation, arg_max(replace(receiver, '.objects', ''), call_ord) FILTER (name IN ('get', 'create', 'delete')) AS model, arg_max(receiver, call_ord) FILTER (name IN ('send', 'connect')) AS signal, CASE WHEN bool_or(name = 'connect') THEN true END AS signal_connection, CASE WHEN bool_or(name = 'send') THEN true END AS signal_emit FROM ({_ORM}) GROUP BY caller")
def annotation_last_wins(v: View) -> DataFrame:
    calls = v.sql(_ORM).selectExpr("*", "'f' AS file_path", "0 AS func_ord", "CAST(NULL AS INT) AS branch_ord", "true AS is_method_call")
    return detectors.annotations(calls)


# ---- detectors


def _functions(rows: DataFrame, decorator: str = "NULL", arg: str = "NULL", kwargs: str = "map()") -> DataFrame:
    """Rows (file_path, func_ord, name) as functions with one decorator, one string argument and keyword arguments."""
    const = "struct<type:string,value:string>"
    return rows.selectExpr(
        "file_path", "file_path AS module_path", "func_ord", "name AS qualified_name", "name", "'function' AS type", "CAST(NULL AS STRING) AS docstring", f"array({decorator}) AS decorators",
        f"array(named_struct('name', {decorator}, 'args', CASE WHEN {arg} IS NULL THEN CAST(array() AS array<{const}>) ELSE array(named_struct('type', 'str', 'value', {arg})) END, 'kwargs', CAST({kwargs} AS map<string,{const}>))) AS decorator_details",
    )


@query("SELECT CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS node_id, CASE WHEN role = 'user' THEN 'Controller: /' || md5(text) ELSE 'GET ' || coalesce('/' || last_value(CASE WHEN role = 'user' THEN md5(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn), '') || '/' || CAST(length(text) AS STRING) END AS trigger FROM conversations")
def forward_fill_prefix(v: View) -> DataFrame:
    """User turns set the URL that goes before the routes of the turns after them."""
    rows = v.sql("SELECT CAST(conv_id AS STRING) AS file_path, turn AS func_ord, CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS name, role, text FROM conversations")
    made = _functions(rows, "CASE WHEN role = 'user' THEN 'api_controller' ELSE 'route.get' END", "CASE WHEN role = 'user' THEN '/' || md5(text) ELSE '/' || CAST(length(text) AS STRING) END")
    return detectors.ninja(made, made).select("node_id", "trigger")


@query(f"SELECT qn FROM ({CUSTOMERS}) WHERE n_name IN (SELECT n_name FROM supplier JOIN {PLACES} ON s_nationkey = n_nationkey WHERE contains(s_name, '7'))")
def import_gate_semi(v: View) -> DataFrame:
    functions = v.sql(f"SELECT qn, n_name AS file_path FROM ({CUSTOMERS})")
    imports = v.sql(f"SELECT n_name AS file_path, s_name AS module, 'x' AS name FROM supplier JOIN {PLACES} ON s_nationkey = n_nationkey")
    return detectors.gate(functions, imports, "7", ("Nothing",)).select("qn")


_PATH = "regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)"


@query(f"SELECT page_id, 'GET ' || CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END AS trigger FROM pages")
def route_trigger(v: View) -> DataFrame:
    rows = v.sql(f"SELECT 'f' AS file_path, page_id AS func_ord, CAST(page_id AS STRING) AS name, {_PATH} AS path FROM pages")
    imports = v.sql("SELECT 'f' AS file_path, 'fastapi' AS module, 'FastAPI' AS name")
    return detectors.fastapi(_functions(rows, "'app.get'", "path"), imports).select(F.col("node_id").cast("long").alias("page_id"), "trigger")


@query(f"SELECT page_id, '/' || trim({_PATH}, '/') AS path FROM pages")
def url_normalise(v: View) -> DataFrame:
    return v.sql(f"SELECT page_id, {_PATH} AS p FROM pages").select("page_id", fn.normal_url(F.col("p")).alias("path"))


@query("SELECT page_id, CAST(pos - 1 AS INTEGER) AS pos, links[pos] AS target FROM (SELECT page_id, links, unnest(range(1, len(links) + 1)) AS pos FROM (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS links FROM pages))")
def link_edges(v: View) -> DataFrame:
    return v.sql("SELECT page_id, html FROM pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("pos", "target"))


@query("SELECT event_id, 'Celery task: ' || event_type || CASE WHEN k IS NULL OR k = '0' THEN '' ELSE ' (queue=' || k || ')' END AS trigger FROM (SELECT event_id, event_type, props ->> '$.k' AS k FROM events)")
def decorator_kwargs(v: View) -> DataFrame:
    rows = v.sql("SELECT 'f' AS file_path, event_id AS func_ord, event_type AS name, get_json_object(props, '$.k') AS k FROM events")
    made = _functions(rows, "'shared_task'", "CAST(NULL AS STRING)", "map_filter(map('queue', named_struct('type', 'int', 'value', k)), (a, b) -> b.value IS NOT NULL)")
    return detectors.celery(made, made).select(F.col("func_ord").alias("event_id"), "trigger")


# ---- text and files


@query(r"SELECT doc_id, md5(regexp_replace(text, '\r\n?', chr(10), 'g')) AS file_hash FROM documents")
def file_hash(v: View) -> DataFrame:
    return v.sql("SELECT doc_id, text FROM documents").select("doc_id", fn.content_hash(F.col("text")).alias("file_hash"))


@query(r"SELECT doc_id, CASE WHEN len(l) >= 2 THEN array_to_string(l[2:4], chr(10)) END AS snippet FROM (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n$', ''), chr(10)) AS l FROM documents)")
def line_snippet(v: View) -> DataFrame:
    return v.sql("SELECT doc_id, text FROM documents").select("doc_id", fn.snippet(F.col("text"), F.lit(2), F.lit(4)).alias("snippet"))


@query("SELECT event_type, max(ts) <= (SELECT max(ts) FROM events WHERE event_type = 'view') AS fresh FROM events GROUP BY event_type")
def freshness_by_source(v: View) -> DataFrame:
    """Events of a type are the files of a source; the graph was written when the last view happened."""
    files = v.sql("SELECT event_type, CAST(unix_micros(CAST(ts AS TIMESTAMP)) AS DOUBLE) / 1e6 AS mtime FROM events")
    written_at = files.where("event_type = 'view'").agg(F.max("mtime")).first()[0]
    kinds = [r[0] for r in files.select("event_type").distinct().collect()]  # a handful
    return v.spark.createDataFrame([(k, store.is_fresh(files.where(F.col("event_type") == k), written_at)) for k in kinds], "event_type string, fresh boolean")


# ---- aggregates and reports


@query(_WITH + "SELECT (SELECT count(*) FROM nation) AS modules, (SELECT count(*) FROM nodes) AS functions, (SELECT count(*) FROM customers) AS entry_points, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS unresolved")
def totals(v: View) -> DataFrame:
    return v.engine().totals()


@query(f"SELECT r_name || '.' || n_name AS module_path, CAST(n_nationkey AS INTEGER) AS functions, 0 AS classes, CAST(r_regionkey AS INTEGER) AS imports, n_name AS file_path FROM {PLACES}")
def module_table(v: View) -> DataFrame:
    return v.engine().modules_report()


@query(_WITH + "SELECT caller, count(*) AS n FROM edges GROUP BY caller ORDER BY n DESC, min(edge_ord) LIMIT 10")
def top_callers(v: View) -> DataFrame:
    return group.top_callers(v.edges(), 10)


@query(_WITH + "SELECT qualified_name, count(caller) AS n FROM nodes LEFT JOIN edges ON caller = qualified_name GROUP BY qualified_name, reg_ord ORDER BY n DESC, reg_ord LIMIT 15")
def top_with_zero(v: View) -> DataFrame:
    return group.top_functions(v.nodes(), v.edges(), 15)


_ENTRIES = f"SELECT qn AS node_id, c_mktsegment AS type, 'GET /' || n_name AS trigger, {_pad('c_custkey')} AS ep_ord FROM ({CUSTOMERS})"


@query(f"SELECT type, count(*) AS n FROM ({_ENTRIES}) GROUP BY type")
def type_counts(v: View) -> DataFrame:
    return group.type_counts(v.sql(_ENTRIES))


@query(f"SELECT type, CAST(rn AS INTEGER) AS rn, trigger || ' → ' || split_part(node_id, '.', 3) AS sample FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY ep_ord) AS rn FROM ({_ENTRIES})) WHERE rn <= 8")
def samples_per_type(v: View) -> DataFrame:
    return group.type_samples(v.sql(_ENTRIES), 8)


@query(f"SELECT r_name || '.' || n_name AS package, count(*) AS n FROM ({CUSTOMERS}) GROUP BY 1 ORDER BY n DESC, min({_pad('c_custkey')}) LIMIT 15")
def package_hist(v: View) -> DataFrame:
    return group.package_histogram(v.sql(f"SELECT qn AS module_path, {_pad('c_custkey')} AS file_path FROM ({CUSTOMERS})"), 15)


#: Names under one root, most of them in one place, with structural parts on the way.
_IDS = f"SELECT 'src.' || CASE WHEN c_acctbal > -500 THEN 'shop.' ELSE 'tools.' END || CASE WHEN c_mktsegment = 'BUILDING' THEN 'api.views.' WHEN c_mktsegment = 'MACHINERY' THEN 'tasks' ELSE '' END || CASE WHEN c_mktsegment = 'MACHINERY' THEN '' ELSE n_name || '.cust' || CAST(c_custkey AS STRING) END AS id, {_pad('c_custkey')} AS ord, c_mktsegment AS type, 'GET /' || n_name AS trigger, {_pad('c_custkey')} AS k FROM ({CUSTOMERS})"
_MODAL = f"i AS ({_IDS}), p AS (SELECT string_split(id, '.') AS a FROM i), n AS (SELECT count(*) AS n, min(len(a)) AS shortest FROM p), c AS (SELECT pos, part, count(*) AS c FROM (SELECT unnest(range(1, len(a) + 1)) AS pos, unnest(a) AS part FROM p) GROUP BY ALL), m AS (SELECT pos, arg_max(part, c) AS part, max(c) AS c FROM c GROUP BY pos), s AS (SELECT CAST(pos - 1 AS INTEGER) AS pos, part, c / n.n AS share FROM m, n WHERE pos <= shortest), ok AS (SELECT *, min(CAST(share >= 0.7 AS INT)) OVER (ORDER BY pos) AS led FROM s), pre AS (SELECT pos, part, share FROM ok WHERE led = 1), k AS (SELECT count(*) AS k FROM pre), nx AS (SELECT a[k.k + 1] AS part, count(*) AS c FROM p, k WHERE len(a) > k.k GROUP BY 1), len_ AS (SELECT CAST(k.k + CASE WHEN (SELECT max(c) / sum(c) FROM nx) >= 0.6 THEN 1 ELSE 0 END AS INTEGER) AS prefix_len FROM k)"
_STRUCTURAL = "('" + "', '".join(group.STRUCTURAL) + "')"
_GROUPED = f"{_MODAL}, g AS (SELECT i.*, string_split(id, '.') AS a, string_split(id, '.')[prefix_len + 1:] AS rest FROM i, len_), gg AS (SELECT *, coalesce(list_filter(rest, lambda x, j: len(list_filter(rest[1:j], lambda y: y NOT IN {_STRUCTURAL})) > 0)[1], a[len(a) - 1]) AS \"group\" FROM g)"


@query(f"WITH {_MODAL} SELECT pos, part, round(share, 9) AS share FROM pre")
def common_prefix(v: View) -> DataFrame:
    return group.common_prefix(v.sql(_IDS)).withColumn("share", F.round("share", 9))


@query(f"WITH {_MODAL} SELECT prefix_len FROM len_")
def second_strip(v: View) -> DataFrame:
    return group.prefix_length(v.sql(_IDS))


@query(f"WITH {_GROUPED} SELECT id, k, \"group\" FROM gg")
def domain_groups(v: View) -> DataFrame:
    return group.domain_groups(v.sql(_IDS)).select("id", "k", "group")


@query(_WITH + ", g AS (SELECT qn AS id, n_name AS grp, c_mktsegment AS type, c_custkey AS o, 1 + count(DISTINCT e.callee) + count(DISTINCT f.callee) AS r FROM customers LEFT JOIN edges e ON e.caller = qn LEFT JOIN edges f ON f.caller = e.callee GROUP BY ALL), t AS (SELECT grp, string_agg(type || '=' || CAST(c AS STRING), ',' ORDER BY type) AS types FROM (SELECT grp, type, count(*) AS c FROM g GROUP BY ALL) GROUP BY grp) SELECT g.grp AS \"group\", count(*) AS \"count\", any_value(t.types) AS types, arg_min('cust' || CAST(o AS STRING), (-r, o)) AS deepest_name, max(r) AS deepest_reachable, string_agg('GET /' || g.grp || CAST(o AS STRING), ',' ORDER BY o) FILTER (o IN (SELECT o FROM (SELECT o, row_number() OVER (PARTITION BY grp ORDER BY o) AS rn FROM g) WHERE rn <= 3)) AS triggers FROM g JOIN t ON t.grp = g.grp GROUP BY g.grp".replace(") ,", "),"))
def group_stats(v: View) -> DataFrame:
    rows = v.sql(f"SELECT qn AS id, c_custkey AS ord, c_mktsegment AS type, 'GET /' || n_name || CAST(c_custkey AS STRING) AS trigger, n_name AS group FROM ({CUSTOMERS})")
    stats = group.group_stats(rows, v.edges(), 2)
    types = F.array_join(F.transform(F.map_entries("types"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",")
    return stats.select("group", "count", types.alias("types"), "deepest_name", "deepest_reachable", F.array_join("triggers", ",").alias("triggers"))


_CITY = "SELECT qn FROM customers ORDER BY c_custkey LIMIT 1"
_TRACE = _WITH + f", root AS ({_CITY}), t1 AS (SELECT e.* FROM edges e JOIN root ON caller = qn), t2 AS (SELECT e.* FROM edges e WHERE caller IN (SELECT callee FROM t1)), t3 AS (SELECT e.* FROM edges e WHERE caller IN (SELECT callee FROM t2)), t AS (SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3), tn AS (SELECT * FROM nodes WHERE qualified_name IN (SELECT caller FROM t UNION SELECT callee FROM t UNION SELECT qn FROM root)) "


def _first_trace(v: View) -> tuple[str, DataFrame, DataFrame]:
    """The trace of the first customer, three levels deep."""
    root = v.sql(f"SELECT qn FROM ({CUSTOMERS}) ORDER BY c_custkey LIMIT 1").first()[0]
    return root, *graph.trace(v.nodes(), v.edges(), root, 3)


@query(_TRACE + "SELECT (SELECT count(*) FROM tn) AS total_nodes, (SELECT count(DISTINCT file_path) FROM tn) AS total_files, (SELECT count(*) FROM t) AS total_edges, (SELECT count(*) FROM t WHERE is_async_dispatch) AS async_boundaries")
def trace_meta(v: View) -> DataFrame:
    _, nodes, edges = _first_trace(v)
    return graph.trace_metadata(nodes, edges)


@query(_WITH + "SELECT node, count(*) AS degree FROM (SELECT caller AS node FROM edges UNION ALL SELECT callee FROM edges) GROUP BY node")
def node_degree(v: View) -> DataFrame:
    return graph.node_degree(v.edges())


@query(_TRACE + "SELECT qualified_name, EXISTS (SELECT 1 FROM edges e WHERE e.caller = qualified_name) AS has_callees, EXISTS (SELECT 1 FROM edges e WHERE e.caller = qualified_name AND e.callee IN (SELECT qualified_name FROM nodes) AND NOT EXISTS (SELECT 1 FROM t WHERE t.caller = e.caller AND t.callee = e.callee)) AS expandable FROM tn")
def expandable(v: View) -> DataFrame:
    _, nodes, _ = _first_trace(v)
    return nodes.select("qualified_name", "has_callees", "expandable")


@query(_WITH + "SELECT caller, name, arg_min(callee, edge_ord) AS callee FROM edges GROUP BY caller, name")
def branch_call_lookup(v: View) -> DataFrame:
    return graph.branch_callee(v.edges())


@query(_WITH + "SELECT qualified_name, type FROM nodes WHERE contains(lower(qualified_name), 'nation_1.cust') ORDER BY reg_ord LIMIT 20")
def search_limit(v: View) -> DataFrame:
    return graph.search(v.nodes(), "NATION_1.Cust", 20).select("qualified_name", "type")


@query(f"SELECT type, trigger, split_part(node_id, '.', 3) AS function, type AS description, node_id FROM ({_ENTRIES})")
def entries_sorted(v: View) -> DataFrame:
    return v.engine().entries()


@query(f"SELECT type, node_id, trigger, split_part(node_id, '.', 1) || '.' || split_part(node_id, '.', 2) AS module FROM ({_ENTRIES})")
def overview(v: View) -> DataFrame:
    """The payload's entry points; it holds all of them by design."""
    got = v.engine().overview()["entry_points_by_type"]
    return v.spark.createDataFrame([(r["type"], r["node_id"], r["trigger"], r["module"]) for rows in got.values() for r in rows], "type string, node_id string, trigger string, module string")


# ---- source code, rendered from the tables and parsed again


@query(roundtrip.EDGES_SQL)
def roundtrip_edges(v: View) -> DataFrame:
    return roundtrip.edges(v)


@query(roundtrip.GOLDEN_SQL)
def golden_edges(v: View) -> DataFrame:
    return roundtrip.golden(v.spark)


@query(roundtrip.DETECTED_SQL)
def golden_entry_points(v: View) -> DataFrame:
    return roundtrip.detected(v.spark)


QUERIES |= golden.QUERIES
ORACLES |= golden.ORACLES
