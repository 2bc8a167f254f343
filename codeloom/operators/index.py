"""Lookup tables for call resolution: registry, imports, class hierarchy, inherited methods, suffixes.

Order everywhere is (file_path, ordinal): the first or last of several is taken by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import ancestors, last_part, parent, suffixes
from ..sources.parse import Tables
from ..storage import Levels, discard, written


def last_value(rows: DataFrame, keys: list[str], value: str | Column, order: Column) -> DataFrame:
    """One row for each key: the value of its last row."""
    return rows.groupBy(*keys).agg(F.max_by(value, order).alias("value"))


def registry(functions: DataFrame) -> DataFrame:
    """(qualified_name, reg_ord, and the columns of its last definition): place of the first, value of the last."""
    rest = [c for c in functions.columns if c != "qualified_name"]
    ord_ = F.struct("file_path", "func_ord")
    return functions.groupBy("qualified_name").agg(F.min(ord_).alias("reg_ord"), F.max_by(F.struct(*rest), ord_).alias("v")).select("qualified_name", "reg_ord", "v.*")


def return_types(functions: DataFrame) -> DataFrame:
    """(qualified_name, return_type) of the last definition that has one."""
    return functions.where(F.coalesce("return_type", F.lit("")) != "").groupBy("qualified_name").agg(F.max_by("return_type", F.struct("file_path", "func_ord")).alias("return_type"))


def import_base(imports: DataFrame) -> DataFrame:
    """imports with ``base``: the module that is named, relative levels taken off the importer's own; null if there
    are more levels than parts. An empty rest leaves a leading dot, which never resolves."""
    parts = F.split("module_path", r"\.")
    up = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - F.col("level"), F.lit(0))), ".")
    relative = F.when(F.col("level") <= F.size(parts), F.when(F.col("module") != "", F.concat(up, F.lit("."), F.col("module"))).otherwise(up))
    return imports.withColumn("base", F.when(F.col("is_relative"), relative).otherwise(F.col("module")))


def resolve_imports(imports: DataFrame, functions: DataFrame, module_types: DataFrame) -> DataFrame:
    """(file_path, module_path, import_ord, local_name, target): target is null where nothing fits.

    In order: a function, method or class of that name; the name as a module or class with functions below it;
    the module's first function whose last part is that name; an instance at the module's top level, by its type
    there or by the import that brings the type. Instances of instances are followed until a round finds nothing
    new: a chain may be of any length, and a cycle stays unresolved.
    """
    names = functions.select("qualified_name").distinct()
    known = names.select(F.explode(F.concat(F.array("qualified_name"), ancestors(F.col("qualified_name")))).alias("candidate")).distinct().withColumn("is_known", F.lit(True))
    inside = functions.select(F.col("module_path").alias("base"), last_part(F.col("name")).alias("name"), "qualified_name", "func_ord").groupBy("base", "name").agg(F.min_by("qualified_name", "func_ord").alias("inside"))
    rows = import_base(imports).select("file_path", "module_path", "import_ord", "name", F.coalesce("alias", "name").alias("local_name"), "base").withColumn("candidate", F.concat("base", F.lit("."), "name"))
    instances = module_types.select(F.col("module_path").alias("base"), F.col("var").alias("name"), "type_name").groupBy("base", "name").agg(F.max("type_name").alias("type_name"))
    rows = rows.join(known, "candidate", "left").join(inside, ["base", "name"], "left").join(instances, ["base", "name"], "left")
    rows = rows.withColumn("target", F.when(F.col("is_known"), F.col("candidate")).otherwise(F.col("inside"))).drop("is_known", "inside", "candidate")
    own = names.select(F.col("qualified_name").alias("typed"), F.lit(True).alias("is_typed"))
    rows = rows.withColumn("typed", F.when(F.col("target").isNull(), F.concat("base", F.lit("."), "type_name"))).join(own, "typed", "left")
    rows = rows.withColumn("target", F.coalesce("target", F.when(F.col("is_typed"), F.col("typed")))).drop("typed", "is_typed")
    rows = written(rows, "imports")
    while True:
        waiting = rows.where("target IS NULL AND type_name IS NOT NULL")
        if not waiting.limit(1).count():
            break
        through = rows.where("target IS NOT NULL").select(F.col("module_path").alias("base"), F.col("local_name").alias("head"), F.col("import_ord").alias("via"), F.col("target").alias("via_target"))
        rest = F.expr("substring(type_name, length(head) + 1)")
        found = (
            waiting.withColumn("head", F.substring_index("type_name", ".", 1)).join(through, ["base", "head"]).withColumn("qualified_name", F.concat("via_target", rest))
            .join(names, "qualified_name").groupBy("file_path", "import_ord").agg(F.min_by("qualified_name", "via").alias("new"))
        )
        found = written(found, "instances")
        if not found.limit(1).count():
            break
        old, rows = rows, written(rows.join(found, ["file_path", "import_ord"], "left").withColumn("target", F.coalesce("target", "new")).drop("new"), "imports")
        discard(old, found)
    return rows.select("file_path", "module_path", "import_ord", "local_name", "target")


def import_index(resolved: DataFrame, functions: DataFrame) -> DataFrame:
    """(module_path, local_name, qn): what a bare name means in a module. Its own functions come after imports, by
    their last part, and the last of a name wins."""
    named = resolved.where("target IS NOT NULL").select("module_path", "local_name", F.col("target").alias("qn"), F.struct(F.lit(0).alias("own"), F.col("import_ord").alias("at")).alias("o"))
    own = functions.select("module_path", last_part(F.col("name")).alias("local_name"), F.col("qualified_name").alias("qn"), F.struct(F.lit(1).alias("own"), F.col("func_ord").alias("at")).alias("o"))
    return last_value(named.unionByName(own), ["module_path", "local_name"], "qn", F.col("o")).withColumnRenamed("value", "qn")


def hierarchy(classes: DataFrame, class_bases: DataFrame, resolved: DataFrame) -> DataFrame:
    """(class, base_ord, base): a base is a class of the same module, else what the first resolved import of its
    first part names."""
    local = classes.select("module_path", F.col("name").alias("base_name"), F.col("qualified_name").alias("local"))
    first = resolved.where("target IS NOT NULL").groupBy("module_path", F.col("local_name").alias("head")).agg(F.min_by("target", "import_ord").alias("imported"))
    rows = class_bases.withColumn("head", F.substring_index("base_name", ".", 1)).join(local, ["module_path", "base_name"], "left").join(first, ["module_path", "head"], "left")
    return rows.select(F.col("qualified_name").alias("class"), "base_ord", F.coalesce("local", "imported").alias("base")).where("base IS NOT NULL")


def mro(bases: DataFrame) -> DataFrame:
    """(class, ancestor, level, path): every ancestor where breadth-first search meets it first, however far up.

    path holds the ordinals of the bases on the way; (level, path) is the search's order. Cycles end because an
    ancestor that was met isn't followed again.
    """
    step = bases.select(F.col("class").alias("ancestor"), F.col("base").alias("up"), F.col("base_ord"))
    levels = Levels("mro")
    last = levels.add(bases.groupBy("class", F.col("base").alias("ancestor")).agg(F.min(F.array("base_ord")).alias("path")).withColumn("level", F.lit(1)))
    level = 1
    while last.limit(1).count():
        level += 1
        new = last.join(step, "ancestor").select("class", F.col("up").alias("ancestor"), F.concat("path", F.array("base_ord")).alias("path"))
        new = new.groupBy("class", "ancestor").agg(F.min("path").alias("path")).withColumn("level", F.lit(level)).join(levels.table().select("class", "ancestor"), ["class", "ancestor"], "left_anti")
        last = levels.add(new.select("class", "ancestor", "path", "level"))
    return levels.closed()


def first_inherited(ancestry: DataFrame, methods: DataFrame) -> DataFrame:
    """(class, method, owner): the first ancestor that has the method. methods: (owner, method)."""
    return ancestry.join(methods.withColumnRenamed("owner", "ancestor"), "ancestor").groupBy("class", "method").agg(F.min_by("ancestor", F.struct("level", "path")).alias("owner"))


def inherited(ancestry: DataFrame, names: DataFrame) -> DataFrame:
    """(class, method, qn) over the registry."""
    methods = names.select(parent(F.col("qualified_name")).alias("owner"), last_part(F.col("qualified_name")).alias("method")).distinct()
    return first_inherited(ancestry, methods).select("class", "method", F.concat("owner", F.lit("."), "method").alias("qn"))


def suffix_index(reg: DataFrame) -> DataFrame:
    """(suffix, qn): the first registered name that ends in ``.suffix``, for suffixes of two parts or more."""
    return reg.select("qualified_name", "reg_ord", F.explode(suffixes(F.col("qualified_name"))).alias("suffix")).groupBy("suffix").agg(F.min_by("qualified_name", "reg_ord").alias("qn"))


class Index:
    """All lookup tables of a parsed project."""

    def __init__(self, t: Tables):
        self.registry = written(registry(t.functions), "registry")
        self.imports = resolve_imports(t.imports, t.functions, t.module_types)
        self.names = written(import_index(self.imports, t.functions), "import-index")
        self.returns = return_types(t.functions)
        self.bases = written(hierarchy(t.classes, t.class_bases, self.imports), "hierarchy")
        self.mro = mro(self.bases)
        self.inherited = inherited(self.mro, self.registry)
        self.suffixes = suffix_index(self.registry)
