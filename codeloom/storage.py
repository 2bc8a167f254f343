"""Intermediate tables in the folder that all executors share, and their removal.

``written`` tables lie below one folder for each application. A table that another one replaces goes at once
(``discard``), those written in a ``scratch`` block at its end, and all that are left when the driver ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
#: Path -> the session that wrote it, for tables that haven't been removed.
_live: dict[str, SparkSession] = {}
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (``spark.checkpoint.dir``); it is removed when the driver ends.

    Only a local session may run without that setting; it then gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _own.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="codeloom-")
        _own[spark.sparkContext.applicationId] = root
    own = f"{root.rstrip('/')}/codeloom-{spark.sparkContext.applicationId}"
    path = f"{own}/{name}-{uuid.uuid4().hex}"
    _live[own] = _live[path] = spark
    if _scopes:
        _scopes[-1].append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage is cut and survives the loss of executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def stored(table: DataFrame) -> bool:
    """Whether a written table is still there."""
    return _paths.get(table) in _live


def _remove(paths: list[str]) -> None:
    for path in paths:
        spark = _live.pop(path, None)
        if spark is None:
            continue
        context = spark.sparkContext
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        conf = context._jsc.hadoopConfiguration() if context._jsc else context._jvm.org.apache.hadoop.conf.Configuration()
        where.getFileSystem(conf).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Removes written tables that nothing reads any more; other frames are left alone."""
    _remove([_paths.pop(t) for t in tables if t in _paths])


class Levels:
    """Written tables of one schema that a search adds level by level, read as one.

    Every MERGED levels, those before the last become one table, so that neither plans nor files grow with depth.
    """

    MERGED = 8

    def __init__(self, name: str):
        self.name, self.parts = name, []

    def add(self, level: DataFrame) -> DataFrame:
        """The level, written; it is readable until the next one is added. What was read of earlier levels is not: the
        new one may be made from them, so they are merged after it is written."""
        self.parts.append(written(level, self.name))
        if len(self.parts) > self.MERGED:
            old = self.parts[:-1]
            self.parts = [written(self._union(old), self.name), self.parts[-1]]
            discard(*old)
        return self.parts[-1]

    @staticmethod
    def _union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def table(self) -> DataFrame:
        return self._union(self.parts)

    def closed(self) -> DataFrame:
        """All levels as one written table; their own tables go."""
        if len(self.parts) == 1:
            return self.parts[0]
        out = written(self.table(), self.name)
        discard(*self.parts)
        return out


@contextmanager
def scratch(*keep: DataFrame) -> Iterator[list[DataFrame]]:
    """A block whose written tables are removed at its end, less those that it appends to the list it gets.

    What the block returns must be written there and kept, or collected: a frame that still reads a removed table fails.
    """
    kept = list(keep)
    _scopes.append([])
    try:
        yield kept
    finally:
        mine = _scopes.pop()
        spared = {_paths[t] for t in kept if t in _paths}
        if _scopes:
            _scopes[-1].extend(p for p in mine if p in spared)
        _remove([p for p in mine if p not in spared])


@atexit.register
def _at_exit() -> None:
    for path in [p for p in _live if p.rpartition("/")[2].startswith("codeloom-")]:
        try:
            _remove([path])
        except Exception:  # noqa: BLE001  (the session may have ended in any way)
            continue
    for root in _own.values():
        shutil.rmtree(root, ignore_errors=True)
