"""The driver's tables as nodes and edges, so that the graph operators run over them unchanged.

The view texts are valid in Spark SQL and DuckDB alike.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine

CUSTOMER = "r_name || '.' || n_name || '.cust' || CAST(c_custkey AS STRING)"
SUPPLIER = "r_name || '.' || n_name || '.supp' || CAST(s_suppkey AS STRING)"
PLACES = "(SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey) AS places"


def _pad(column: str) -> str:
    return f"lpad(CAST({column} AS STRING), 12, '0')"


LINE = f"{_pad('l_orderkey')} || '-' || {_pad('l_linenumber')} || '-' || {_pad('l_partkey')} || '-' || {_pad('l_suppkey')}"

NODES = f"""
SELECT {CUSTOMER} AS qualified_name, 'cust' || CAST(c_custkey AS STRING) AS name, 'function' AS type, n_name AS file_path, 'c' || {_pad('c_custkey')} AS reg_ord, c_mktsegment AS label FROM customer JOIN {PLACES} ON c_nationkey = n_nationkey
UNION ALL SELECT 'o.' || CAST(o_orderkey AS STRING), CAST(o_orderkey AS STRING), 'method', o_orderpriority, 'o' || {_pad('o_orderkey')}, o_orderstatus FROM orders
UNION ALL SELECT 'p.' || CAST(p_partkey AS STRING), CAST(p_partkey AS STRING), 'method', p_brand, 'p' || {_pad('p_partkey')}, p_type FROM part
UNION ALL SELECT 's.' || CAST(s_suppkey AS STRING), CAST(s_suppkey AS STRING), 'class', n_name, 's' || {_pad('s_suppkey')}, n_name FROM supplier JOIN {PLACES} ON s_nationkey = n_nationkey
UNION ALL SELECT 'n.' || n_name, n_name, 'class', r_name, 't' || {_pad('n_nationkey')}, r_name FROM {PLACES}
UNION ALL SELECT 'r.' || r_name, r_name, 'class', 'world', 'u' || {_pad('r_regionkey')}, r_name FROM region"""

EDGES = f"""
SELECT 'c' || {_pad('o_orderkey')} AS edge_ord, {CUSTOMER} AS caller, 'o.' || CAST(o_orderkey AS STRING) AS callee, CAST(NULL AS STRING) AS condition, false AS is_async_dispatch, o_orderstatus AS name FROM orders JOIN customer ON o_custkey = c_custkey JOIN {PLACES} ON c_nationkey = n_nationkey
UNION ALL SELECT 'l' || {LINE}, 'o.' || CAST(l_orderkey AS STRING), 'p.' || CAST(l_partkey AS STRING), l_returnflag, l_linestatus = 'O', l_returnflag FROM lineitem
UNION ALL SELECT 'p' || {_pad('l_partkey')} || '-' || {_pad('l_suppkey')}, 'p.' || CAST(l_partkey AS STRING), 's.' || CAST(l_suppkey AS STRING), CAST(NULL AS STRING), false, 'supply' FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) AS d
UNION ALL SELECT 's' || {_pad('s_suppkey')}, 's.' || CAST(s_suppkey AS STRING), 'n.' || n_name, CAST(NULL AS STRING), false, 'place' FROM supplier JOIN {PLACES} ON s_nationkey = n_nationkey
UNION ALL SELECT 't' || {_pad('n_nationkey')}, 'n.' || n_name, 'r.' || r_name, CAST(NULL AS STRING), false, 'place' FROM {PLACES}"""

CUSTOMERS = f"SELECT {CUSTOMER} AS qn, c_custkey, c_mktsegment, c_acctbal, n_name, r_name FROM customer JOIN {PLACES} ON c_nationkey = n_nationkey"

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")


class View:
    """Tables of one folder; ``sql`` sees them under their own names, the session under names of this view alone."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self._names = {}
        for t in TABLES:
            self._names[t] = f"codeloom_{t}_{zlib.crc32(sf_dir.encode()):08x}"
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(self._names[t])

    def sql(self, text: str) -> DataFrame:
        # a table is named after FROM, JOIN or a comma only
        return self.spark.sql(re.sub(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b", lambda m: f"{m[1]} {self._names[m[2]]}", text))

    def nodes(self) -> DataFrame:
        return self.sql(NODES).withColumn("decorators", F.array("label"))

    def edges(self) -> DataFrame:
        return self.sql(EDGES)

    def engine(self) -> Engine:
        """An engine over the views: nations are modules, customers entry points, late lines unresolved calls."""
        entries = self.sql(f"SELECT qn AS node_id, c_mktsegment AS type, 'GET /' || n_name AS trigger, {_pad('c_custkey')} AS ep_ord, c_mktsegment AS description FROM ({CUSTOMERS})")
        modules = self.sql(f"SELECT r_name || '.' || n_name AS module_path, n_name AS file_path, CAST(n_nationkey AS INT) AS n_functions, 0 AS n_classes, CAST(r_regionkey AS INT) AS n_imports FROM {PLACES}")
        late = self.sql("SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'")
        return Engine(self.spark, {"modules": modules, "functions": self.nodes(), "registry": self.nodes(), "edges": self.edges(), "unresolved": late, "entry_points": entries}, "tables")
