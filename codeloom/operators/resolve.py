"""Call resolution as one plan: candidates with priorities, one join to what exists, the least priority wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import unresolved_reason
from ..storage import written
from .index import Index

KEY = ("file_path", "func_ord", "branch", "call_ord")

#: Priority -> rule. Method calls with a receiver never use the plain rules.
STRATEGIES = {
    0: "async", 10: "self", 11: "self-inherited", 20: "import", 21: "import-chain", 30: "parameter", 31: "parameter-inherited", 32: "parameter-suffix",
    40: "local", 41: "local-inherited", 42: "local-suffix", 50: "return", 51: "return-inherited", 52: "return-suffix", 60: "orm", 70: "name", 71: "module", 72: "class",
}


def _dot(*parts: Column) -> Column:
    """Parts joined by dots; null if one is."""
    out = parts[0]
    for p in parts[1:]:
        out = F.concat(out, F.lit("."), p)
    return out


def _candidate(priority: int, kind: str, key: Column) -> Column:
    return F.struct(F.lit(priority).alias("priority"), F.lit(kind).alias("kind"), key.alias("key"))


def _of_type(priority: int, type_name: Column, type_qn: Column, method: Column) -> list[Column]:
    """A method of a named type: its own, an inherited one, or anything that ends in Type.method."""
    return [_candidate(priority, "name", _dot(type_qn, method)), _candidate(priority + 1, "inherited", _dot(type_qn, method)), _candidate(priority + 2, "suffix", _dot(type_name, method))]


def best_candidate(candidates: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """keys, qn, priority: for each key the candidate of least priority that exists; kind ``free`` needs no target.

    candidates: keys, priority, kind, key; targets: kind, key, qn.
    """
    hit = candidates.where("kind <> 'free'").join(targets, ["kind", "key"]).select(*keys, "priority", "qn")
    free = candidates.where("kind = 'free'").select(*keys, "priority", F.col("key").alias("qn"))
    return hit.unionByName(free).groupBy(*keys).agg(F.min_by("qn", "priority").alias("qn"), F.min("priority").alias("priority"))


def resolve(calls: DataFrame, index: Index) -> DataFrame:
    """calls with ``callee`` and ``priority``, both null where a call doesn't resolve."""
    base = F.substring_index("receiver", ".", 1)
    is_method = F.col("is_method_call") & F.col("receiver").isNotNull()
    c = calls.withColumn("branch", F.coalesce("branch_ord", F.lit(-1))).withColumn("bound", is_method)
    c = c.withColumn("head", F.when(is_method, base).otherwise(F.col("name")))

    def first(column: str) -> Column:
        return F.substring_index(column, ".", 1)

    # all that a call asks the import index for is asked in one join, and comes back as a small map
    asked = F.array_distinct(F.array_compact(F.array(F.col("head"), *[F.when(is_method, x) for x in (first("param_type"), first("local_type"), F.col("assigned"))])))
    answers = (
        c.select(*KEY, "module_path", F.explode(asked).alias("local_name")).join(index.names, ["module_path", "local_name"])
        .groupBy(*KEY).agg(F.map_from_entries(F.collect_set(F.struct("local_name", "qn"))).alias("known"))
    )
    c = c.join(answers, list(KEY), "left")

    def look(column: Column) -> Column:
        """The import index's answer for a name of the call's module."""
        return F.try_element_at("known", column)

    def type_qn(type_name: str, looked: Column) -> Column:
        rest = F.expr(f"substring({type_name}, length(substring_index({type_name}, '.', 1)) + 1)")
        return F.coalesce(F.concat(looked, rest), _dot(F.col("module_path"), F.col(type_name)))

    c = c.withColumn("head_qn", look(F.col("head")))
    # only calls on something that a call made: others would meet as nulls in one task
    made = c.where(is_method & F.col("assigned").isNotNull()).select(*KEY, "module_path", F.coalesce(look(F.col("assigned")), _dot(F.col("module_path"), F.col("assigned"))).alias("qualified_name"))
    made = made.join(index.returns, "qualified_name").withColumnRenamed("return_type", "made_type").withColumn("local_name", first("made_type"))
    made = made.join(index.names, ["module_path", "local_name"], "left").select(*KEY, "made_type", F.col("qn").alias("made_type_qn"))
    c = c.join(made, list(KEY), "left")
    name, module = F.col("name"), F.col("module_path")
    own_class = _dot(module, F.col("class_name"))
    through_self = F.when(base == "self", own_class)
    chain = F.expr("substring(receiver, length(head) + 1)")
    orm = F.when(F.get(F.split("receiver", r"\."), F.lit(1)) == "objects", F.coalesce("head_qn", _dot(module, F.col("head"))))
    method = F.array(
        _candidate(0, "free", F.when(F.col("is_async_dispatch"), F.col("head_qn"))),
        _candidate(10, "name", _dot(through_self, name)),
        _candidate(11, "inherited", _dot(through_self, name)),
        _candidate(20, "name", _dot(F.col("head_qn"), name)),
        _candidate(21, "name", F.when(chain != "", _dot(F.concat(F.col("head_qn"), chain), name))),
        *_of_type(30, F.col("param_type"), type_qn("param_type", look(first("param_type"))), name),
        *_of_type(40, F.col("local_type"), type_qn("local_type", look(first("local_type"))), name),
        *_of_type(50, F.col("made_type"), type_qn("made_type", F.col("made_type_qn")), name),
        _candidate(60, "name", orm),
    )
    plain = F.array(_candidate(70, "free", F.col("head_qn")), _candidate(71, "name", _dot(module, name)), _candidate(72, "name", _dot(own_class, name)))
    exploded = c.select(*KEY, F.explode(F.filter(F.when(F.col("bound"), method).otherwise(plain), lambda x: x["key"].isNotNull())).alias("x")).select(*KEY, "x.*")
    targets = (
        index.registry.select(F.lit("name").alias("kind"), F.col("qualified_name").alias("key"), F.col("qualified_name").alias("qn"))
        .unionByName(index.inherited.select(F.lit("inherited").alias("kind"), _dot(F.col("class"), F.col("method")).alias("key"), "qn"))
        .unionByName(index.suffixes.select(F.lit("suffix").alias("kind"), F.col("suffix").alias("key"), "qn"))
    )
    best = best_candidate(exploded, targets, list(KEY)).withColumnRenamed("qn", "callee")
    return calls.withColumn("branch", F.coalesce("branch_ord", F.lit(-1))).join(best, list(KEY), "left")


def _strategy(priority: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in STRATEGIES.items() for x in kv]), priority)


def edges(resolved: DataFrame) -> DataFrame:
    """The calls that resolved; a callee outside the caller's module makes an edge cross files."""
    order = F.struct("file_path", "func_ord", "branch", "call_ord").alias("edge_ord")
    module = F.concat("module_path", F.lit("."))
    return resolved.where("callee IS NOT NULL").select(order, "caller", "callee", "condition", (~F.col("callee").startswith(module)).alias("is_cross_file"), "name", "receiver", "line", "args_count", "is_method_call", "is_async_dispatch", "async_type", _strategy(F.col("priority")).alias("strategy"))


class Resolved:
    """Edges and unresolved calls. ``edge_ord`` is the calls' place: file, function, branch (none first), call."""

    def __init__(self, calls: DataFrame, index: Index):
        self.all = written(resolve(calls, index), "resolved")
        self.edges = edges(self.all)
        order = F.struct("file_path", "func_ord", "branch", "call_ord").alias("edge_ord")
        self.unresolved = self.all.where("callee IS NULL").select(order, "caller", "name", "receiver", "line", unresolved_reason(F.col("name")).alias("reason"))
