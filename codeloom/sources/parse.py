"""Parsing as one Spark step, and the parsed tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import async_type
from ..schemas import PARSED
from ..storage import written
from .adapters import ADAPTERS, Adapters
from .files import opened
from .listing import module_path
from .pyparse import parse_rows

_COLUMNS = ["file_path", "module_path", "parse_error", "file_hash", "n_classes", "functions", "classes", "imports", "module_types"]


#: Signs of text that are parsed before their rows are handed on; syntax trees and rows take many times as much memory.
SLICE = 1_000_000


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_COLUMNS)


def _frames(contents: Iterator[tuple[str, str, bytes | str]], adapters: Adapters) -> Iterator[pd.DataFrame]:
    """The parsed rows of (path, module_path, content) in frames of SLICE signs of text, or one file that is larger."""
    read = 0

    def counted() -> Iterator[tuple[str, str, bytes | str]]:
        nonlocal read
        for path, module, content in contents:
            read += len(content)
            yield path, module, content

    rows: list[dict] = []
    for row in parse_rows(counted(), adapters):
        rows.append(row)
        if read >= SLICE:
            yield _frame(rows)
            rows, read = [], 0
    if rows:
        yield _frame(rows)


def parse_texts(files: DataFrame, adapters: Adapters = ADAPTERS) -> DataFrame:
    """files (path, module_path, text) -> a PARSED row each; null texts are empty modules. The text may be of bytes,
    which must be UTF-8. Files of an unknown extension give no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield from _frames(zip(pdf["path"], pdf["module_path"], (x if isinstance(x, (str, bytes)) else bytes(x) if isinstance(x, bytearray) else "" for x in pdf["text"])), adapters)

    return files.select("path", "module_path", "text").mapInPandas(run, PARSED)


def parse_listing(files: DataFrame, partitions: int | None = None, adapters: Adapters = ADAPTERS) -> DataFrame:
    """A listing -> PARSED rows; the bytes are read where they are parsed, from a file system that all see.

    Files are dealt out by path, so that large neighbours part.
    """

    def contents(pdf: pd.DataFrame) -> Iterator[tuple[str, str, bytes]]:
        for path, module in zip(pdf["path"], pdf["module_path"]):
            system, name = opened(path)
            with system.open_input_stream(name, compression=None) as f:
                yield path, module, f.read()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield from _frames(contents(pdf), adapters)

    spread = files.withColumn("module_path", module_path(F.col("rel_path"))).repartition(partitions or files.sparkSession.sparkContext.defaultParallelism * 4, "path")
    return spread.mapInPandas(run, PARSED)


class Tables:
    """The relational form of parsed modules. Order is (file_path, func_ord, branch_ord nulls first, call_ord)."""

    def __init__(self, parsed: DataFrame, keep: bool = True):
        self.parsed = written(parsed, "parsed") if keep else parsed
        self._good = self.parsed.where("parse_error IS NULL")

    @cached_property
    def modules(self) -> DataFrame:
        return self._good.select("module_path", "file_path", "file_hash", "n_classes", F.size("functions").alias("n_functions"), F.size("imports").alias("n_imports"))

    @cached_property
    def failures(self) -> DataFrame:
        return self.parsed.where("parse_error IS NOT NULL").select("file_path", "module_path", "parse_error")

    @cached_property
    def _bodies(self) -> DataFrame:
        return self._good.select("file_path", "module_path", F.posexplode("functions").alias("func_ord", "f"))

    @cached_property
    def functions(self) -> DataFrame:
        f = ("qualified_name", "name", "type", "class_name", "line_start", "line_end", "docstring", "decorators", "decorator_details", "return_type")
        return self._bodies.select("file_path", "module_path", "func_ord", *[F.col(f"f.{c}").alias(c) for c in f])

    @cached_property
    def branches(self) -> DataFrame:
        return self._bodies.select("file_path", "module_path", "func_ord", F.col("f.qualified_name").alias("qualified_name"), F.posexplode("f.branches").alias("branch_ord", "b")).select("file_path", "module_path", "func_ord", "qualified_name", "branch_ord", "b.condition", "b.line", "b.is_else", F.transform("b.calls", lambda c: F.struct(c["name"].alias("name"), c["receiver"].alias("receiver"), async_type(c["name"], c["is_method_call"]).isNotNull().alias("is_async"))).alias("calls"))

    @cached_property
    def calls(self) -> DataFrame:
        """Every call with what its function knows about the receiver's type."""
        lists = F.concat(
            F.array(F.struct(F.lit(None).cast("int").alias("branch_ord"), F.lit(None).cast("string").alias("condition"), F.col("f.calls").alias("calls"))),
            F.transform("f.branches", lambda b, i: F.struct(i.alias("branch_ord"), F.when(b["is_else"], F.lit("else")).otherwise(b["condition"]).alias("condition"), b["calls"].alias("calls"))),
        )
        each = self._bodies.select("file_path", "module_path", "func_ord", "f", F.explode(lists).alias("g"))
        each = each.select("file_path", "module_path", "func_ord", "f", "g.branch_ord", "g.condition", F.posexplode("g.calls").alias("call_ord", "c"))
        base = F.substring_index("c.receiver", ".", 1)
        kind = async_type(F.col("c.name"), F.col("c.is_method_call"))
        return each.select(
            "file_path", "module_path", "func_ord", "branch_ord", "call_ord", "condition", F.col("f.qualified_name").alias("caller"), F.col("f.class_name").alias("class_name"),
            "c.name", "c.receiver", "c.is_method_call", "c.args_count", "c.line", kind.isNotNull().alias("is_async_dispatch"), kind.alias("async_type"),
            F.element_at("f.parameter_types", base).alias("param_type"), F.element_at("f.local_types", base).alias("local_type"), F.element_at("f.call_assignments", base).alias("assigned"),
        )

    @cached_property
    def imports(self) -> DataFrame:
        return self._good.select("file_path", "module_path", F.posexplode("imports").alias("import_ord", "i")).select("file_path", "module_path", "import_ord", "i.*")

    @cached_property
    def classes(self) -> DataFrame:
        return self._good.select("file_path", "module_path", F.posexplode("classes").alias("class_ord", "c")).select("file_path", "module_path", "class_ord", "c.name", "c.qualified_name", "c.bases")

    @cached_property
    def class_bases(self) -> DataFrame:
        return self.classes.select("module_path", "qualified_name", F.posexplode("bases").alias("base_ord", "base_name"))

    @cached_property
    def type_facts(self) -> DataFrame:
        kinds = {"local": "local_types", "param": "parameter_types", "call_assign": "call_assignments"}
        out = None
        for kind, column in kinds.items():
            one = self._bodies.select(F.col("f.qualified_name").alias("qualified_name"), F.lit(kind).alias("kind"), F.explode(f"f.{column}").alias("var", "type_name"))
            out = one if out is None else out.unionByName(one)
        return out

    @cached_property
    def module_types(self) -> DataFrame:
        return self._good.select("module_path", F.explode("module_types").alias("var", "type_name"))
