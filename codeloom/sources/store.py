"""The stored graph: Parquet tables in a folder of their own for each version, a JSON file that names the version, and
the freshness test. All of it lies on any file system that Spark and pyarrow share."""

from __future__ import annotations

import json
import os
import sys
import time
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files as fs
from .listing import Config

VERSION = 2
TABLES = ("modules", "functions", "registry", "branches", "calls", "imports", "edges", "unresolved", "entry_points", "annotations")


def _meta_path(config: Config) -> str:
    return f"{config.store.rstrip('/')}/meta.json"


def save(config: Config, tables: Mapping[str, DataFrame]) -> None:
    """Writes the tables as a new version, then the file that names it, then removes the old version: a reader finds
    one whole version or the other."""
    started = time.time()
    old = meta(config, any_key=True)
    version = f"v-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(fs.for_spark(f"{config.store.rstrip('/')}/{version}/{name}"))
    said = {"version": VERSION, "root": fs.absolute(config.root), "key": config.key(), "written": started, "tables": version, "python": sys.version.split()[0]}
    fs.write(_meta_path(config), json.dumps(said).encode())
    if old:
        fs.remove(f"{config.store.rstrip('/')}/{old['tables']}")


def meta(config: Config, any_key: bool = False) -> dict | None:
    """The meta file, or None if it is missing, broken, or of another version or configuration."""
    try:
        out = json.loads(fs.read(_meta_path(config)))
    except (OSError, ValueError):
        return None
    good = isinstance(out, dict) and out.get("version") == VERSION and "tables" in out
    return out if good and (any_key or out.get("key") == config.key()) else None


def load(spark: SparkSession, config: Config) -> dict[str, DataFrame] | None:
    said = meta(config)
    paths = {t: f"{config.store.rstrip('/')}/{said['tables']}/{t}" for t in TABLES} if said else {}
    if not said or not all(map(fs.exists, paths.values())):
        return None
    return {t: spark.read.parquet(fs.for_spark(p)) for t, p in paths.items()}


def is_fresh(files: DataFrame, written_at: float | None) -> bool:
    """Whether no file of the listing changed after the graph was written. Deleted files aren't noticed."""
    if written_at is None:
        return False
    newest = files.agg(F.max("mtime")).first()[0]
    return newest is None or newest <= written_at


def fresh(spark: SparkSession, config: Config, files: DataFrame) -> bool:
    m = meta(config)
    return is_fresh(files, m["written"] if m else None)


def changed(files: DataFrame, modules: DataFrame, hashed: DataFrame) -> DataFrame:
    """Files of the listing whose content (path, file_hash in hashed) isn't what modules hold."""
    now = files.join(hashed, "path")
    return now.join(modules.select(F.col("file_path").alias("path"), "file_hash"), ["path", "file_hash"], "left_anti")


def export_json(edges: DataFrame, path: str) -> None:
    """Edges as one JSON file, in order."""
    edges.orderBy("edge_ord").coalesce(1).write.mode("overwrite").json(fs.for_spark(path))


def remember(path: str, pointer: str) -> None:
    """Keeps the last project's path."""
    os.makedirs(os.path.dirname(pointer), exist_ok=True)
    with open(pointer, "w") as f:
        f.write(os.path.abspath(path))


def recall(pointer: str) -> str | None:
    try:
        with open(pointer) as f:
            return f.read().strip() or None
    except OSError:
        return None


def project_and_argument(path: str | None, argument: str | None, pointer: str) -> tuple[str, str | None]:
    """A path that doesn't exist is really the argument of a command for the last project."""
    if path is not None and argument is None and not os.path.exists(path):
        path, argument = None, path
    if path is None:
        path = recall(pointer)
        if path is None:
            raise ValueError("no project was given, and none is remembered")
    return path, argument
