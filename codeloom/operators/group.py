"""Grouping entry points by domain, and the summary aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import last_part
from ..storage import written
from .graph import reach_counts

STRUCTURAL = (
    "admin", "api", "base", "commands", "core", "endpoints", "handlers", "helpers", "management", "middleware", "mixins", "models", "receivers",
    "routers", "routes", "schemas", "serializers", "service", "services", "signals", "tasks", "utils", "views",
)


def _parts(name: Column) -> Column:
    return F.split(name, r"\.")


def common_prefix(ids: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(pos, part, share): the modal part at each place, from the first on, as long as it has the share of all ids.

    Places beyond the shortest id don't count; of equally frequent parts the one that occurs first (by ``ord``)
    is taken. ids: (id, ord).
    """
    rows = ids.select("ord", _parts(F.col("id")).alias("p"))
    totals = rows.agg(F.count("*").alias("n"), F.min(F.size("p")).alias("shortest"))
    counted = rows.select("ord", F.posexplode("p").alias("pos", "part")).groupBy("pos", "part").agg(F.count("*").alias("c"), F.min("ord").alias("first"))
    modal = counted.groupBy("pos").agg(F.min_by("part", F.struct((-F.col("c")).alias("c"), "first")).alias("part"), F.max("c").alias("c"))
    shared = modal.crossJoin(totals).where("pos < shortest").withColumn("share", F.col("c") / F.col("n"))
    # places of one id: a handful of rows
    led = shared.withColumn("ok", F.min((F.col("share") >= threshold).cast("int")).over(Window.partitionBy(F.lit(0)).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    return led.where("ok = 1").select("pos", "part", "share")


def prefix_length(ids: DataFrame, threshold: float = 0.7, second: float = 0.6) -> DataFrame:
    """One row (prefix_len): the common prefix, and one part more where that is dominated by one name among the ids
    that are long enough."""
    base = common_prefix(ids, threshold).agg(F.count("*").alias("k"))
    rows = ids.select("ord", _parts(F.col("id")).alias("p")).crossJoin(base)
    after = rows.where(F.size("p") > F.col("k")).select(F.expr("element_at(p, CAST(k AS INT) + 1)").alias("part"))
    counts = after.groupBy("part").agg(F.count("*").alias("c"))
    top = counts.agg(F.max("c").alias("top"), F.sum("c").alias("n"))
    return base.crossJoin(top).select((F.col("k") + F.when(F.col("top") / F.col("n") >= second, 1).otherwise(0)).cast("int").alias("prefix_len"))


def domain(name: Column, prefix_len: Column) -> Column:
    """The first part after the prefix that isn't structural; else the last part but one; else the first."""
    p = _parts(name)
    rest = F.slice(p, prefix_len + 1, F.greatest(F.size(p) - prefix_len, F.lit(0)))
    # drop structural names from the front
    kept = F.filter(rest, lambda x, i: F.exists(F.slice(rest, F.lit(1), i + 1), lambda y: ~y.isin(*STRUCTURAL)))
    return F.coalesce(F.get(kept, F.lit(0)), F.when(F.size(p) >= 2, F.get(p, F.size(p) - 2)), F.get(p, F.lit(0)))


def domain_groups(ids: DataFrame, threshold: float = 0.7, second: float = 0.6) -> DataFrame:
    """ids (id, ord, ...) with their ``group``."""
    return ids.crossJoin(prefix_length(ids.select("id", "ord"), threshold, second)).withColumn("group", domain(F.col("id"), F.col("prefix_len"))).drop("prefix_len")


def group_stats(grouped: DataFrame, edges: DataFrame, depth: int = 5) -> DataFrame:
    """(group, count, first, types, triggers, deepest_name, deepest_reachable), one row for each group.

    grouped: (id, ord, type, trigger, group). types counts by type; triggers are the first three; the deepest is the
    first entry of the largest reach.
    """
    reached = written(reach_counts(edges, grouped.select("id"), depth), "reached")  # read three times below
    rows = grouped.join(reached, grouped.id == reached.root)
    types = rows.groupBy("group", "type").agg(F.count("*").alias("n")).groupBy("group").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "n")))).alias("types"))
    place = Window.partitionBy("group").orderBy("ord")
    first = rows.withColumn("rn", F.row_number().over(place)).where("rn <= 3").groupBy("group").agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", "trigger"))), lambda x: x["trigger"]).alias("triggers"))
    stats = rows.groupBy("group").agg(
        F.count("*").alias("count"), F.min("ord").alias("first"), F.min_by(last_part(F.col("id")), F.struct((-F.col("reachable")).alias("r"), "ord")).alias("deepest_name"), F.max("reachable").alias("deepest_reachable"),
    )
    return stats.join(types, "group").join(first, "group")


def reason_counts(unresolved: DataFrame) -> DataFrame:
    return unresolved.groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def top_callers(edges: DataFrame, most: int = 10) -> DataFrame:
    """Callers by number of edges; of equal ones the first."""
    return edges.groupBy("caller").agg(F.count("*").alias("n"), F.min("edge_ord").alias("first")).orderBy(F.desc("n"), "first").limit(most).select("caller", "n")


def top_functions(nodes: DataFrame, edges: DataFrame, most: int = 15) -> DataFrame:
    """All nodes by number of edges, none included; of equal ones the first in the registry."""
    out = edges.groupBy(F.col("caller").alias("qualified_name")).agg(F.count("*").alias("n"))
    return nodes.select("qualified_name", "reg_ord").join(out, "qualified_name", "left").fillna(0, ["n"]).orderBy(F.desc("n"), "reg_ord").limit(most).select("qualified_name", "n")


def type_counts(entries: DataFrame) -> DataFrame:
    """Types by frequency; of equal ones the first met."""
    return entries.groupBy("type").agg(F.count("*").alias("n"), F.min("ep_ord").alias("first")).orderBy(F.desc("n"), "first").select("type", "n")


def type_samples(entries: DataFrame, most: int) -> DataFrame:
    """(type, rn, sample): the first entries of each type as ``trigger → name``."""
    rn = F.row_number().over(Window.partitionBy("type").orderBy("ep_ord", "node_id", "trigger"))
    return entries.withColumn("rn", rn).where(F.col("rn") <= most).select("type", "rn", F.concat("trigger", F.lit(" → "), last_part(F.col("node_id"))).alias("sample"))


def package_histogram(modules: DataFrame, most: int = 15) -> DataFrame:
    """Modules of two parts or more by their first two; of equal packages the first by path."""
    two = modules.where(F.col("module_path").contains("."))
    return two.groupBy(F.substring_index("module_path", ".", 2).alias("package")).agg(F.count("*").alias("n"), F.min("file_path").alias("first")).orderBy(F.desc("n"), "first").limit(most).select("package", "n")
