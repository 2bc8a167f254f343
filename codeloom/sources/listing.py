"""Source listings: which files belong to a project, and what their modules are called."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .adapters import ADAPTERS
from .files import absolute, opened

EXCLUDED = (
    ".claude", ".codeloom", ".eggs", ".git", ".mypy_cache", ".tox", ".venv", "__pycache__", "build", "dist", "migrations", "node_modules", "venv",
)
TEST_DIRS = ("tests", "test")
LISTING = "path string, rel_path string, size long, mtime double"


@dataclass(frozen=True)
class Config:
    """What to read, and where the stored graph lies. ``absolute_exclude`` tests the parts of absolute paths too."""

    root: str
    exclude: tuple[str, ...] = EXCLUDED
    include_tests: bool = False
    store_dir: str | None = None
    absolute_exclude: bool = False
    languages: dict[str, str] = field(default_factory=ADAPTERS.extensions, hash=False)

    @property
    def excluded(self) -> tuple[str, ...]:
        return self.exclude if self.include_tests else (*self.exclude, *(d for d in TEST_DIRS if d not in self.exclude))

    @property
    def store(self) -> str:
        return self.store_dir or f"{absolute(self.root)}/.codeloom"

    def key(self) -> str:
        """What a stored graph depends on besides the files."""
        return "|".join([absolute(self.root), ",".join(sorted(self.excluded)), ",".join(sorted(self.languages)), str(self.absolute_exclude)])


#: Folders that the driver opens before it hands them out; each is then listed by a task with all below it.
FOLDERS = 512


def _entries(system: fs.FileSystem, folder: str, config: Config) -> tuple[list[str], list[fs.FileInfo]]:
    """(folders that aren't excluded, files of a known language) in a folder."""
    excluded, folders, files = set(config.excluded), [], []
    for info in sorted(system.get_file_info(fs.FileSelector(folder)), key=lambda i: i.base_name):
        if info.base_name in excluded:
            continue
        if info.type == fs.FileType.Directory:
            folders.append(info.path)
        elif info.is_file and os.path.splitext(info.base_name)[1] in config.languages:
            files.append(info)
    return folders, files


def listing(spark: SparkSession, config: Config) -> DataFrame:
    """(path, rel_path, size, mtime) of every file of a known language; excluded folders aren't entered.

    Works on any file system that pyarrow reads. The driver opens folders until there are FOLDERS of them, level by
    level; tasks list those and what is below. Spark's own file listing would hide names that begin with an
    underscore, ``__init__.py`` among them.
    """
    root = absolute(config.root)
    system, base = opened(root)
    base = base.rstrip("/")
    if config.absolute_exclude and set(config.excluded) & set(base.split("/")):
        return spark.createDataFrame([], LISTING)
    scheme = root[: len(root) - len(base)] if root.endswith(base) else ""
    level, shallow = [base], []
    while level and len(shallow) + len(level) < FOLDERS:
        below = [f for folder in level for f in _entries(system, folder, config)[0]]
        shallow, level = shallow + level, below
    work = [(f, False) for f in shallow] + [(f, True) for f in level]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _ = opened(root)
        for batch in batches:
            for folder, deep in zip(*(c.to_pylist() for c in batch.columns)):
                todo = [folder]
                while todo:
                    folders, files = _entries(own, todo.pop(), config)
                    if deep:
                        todo += folders
                    rows = [(scheme + f.path, f.path[len(base) + 1 :], f.size, f.mtime_ns / 1e9 if f.mtime_ns else 0.0) for f in files]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, (pa.string(), pa.string(), pa.int64(), pa.float64()))], names=["path", "rel_path", "size", "mtime"])

    folders = spark.createDataFrame(work, "folder string, deep boolean")
    return folders.repartition(max(1, min(len(work), 4 * spark.sparkContext.defaultParallelism)), "folder").mapInArrow(run, LISTING)


def module_path(rel_path: Column) -> Column:
    """``a/b.py`` -> ``a.b``; ``__init__`` stays a part."""
    return F.translate(F.regexp_replace(rel_path, r"\.[^./]+$", ""), "/", ".")


def language(path: Column, languages: dict[str, str] | None = None) -> Column:
    """The language of a path by its extension, or null."""
    out = F.lit(None).cast("string")
    for ext, name in (ADAPTERS.extensions() if languages is None else languages).items():
        out = F.when(path.endswith(ext) & (F.element_at(F.split(path, "/"), -1) != ext), name).otherwise(out)
    return out


def import_files(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports (with file_path, import_ord and the importing file's rel_path) and, as ``target``, the file that each
    names, or null.

    A relative import starts level - 1 folders above the importing file's own; an absolute one at the root. Of
    the candidates, ``module/name.py``, ``module/name/__init__.py``, ``module.py`` and ``module/__init__.py``,
    the first that exists counts.
    """
    folder = F.slice(F.split("rel_path", "/"), F.lit(1), F.greatest(F.size(F.split("rel_path", "/")) - F.greatest("level", F.lit(1)), F.lit(0)))
    base = F.when(F.col("is_relative"), folder).otherwise(F.array().cast("array<string>"))
    parts = F.concat(base, F.filter(F.split("module", r"\."), lambda x: x != ""))
    below = F.concat(parts, F.array("name"))
    tries = F.array(F.concat(F.array_join(below, "/"), F.lit(".py")), F.concat(F.array_join(F.concat(below, F.array(F.lit("__init__"))), "/"), F.lit(".py")), F.concat(F.array_join(parts, "/"), F.lit(".py")), F.concat(F.array_join(F.concat(parts, F.array(F.lit("__init__"))), "/"), F.lit(".py")))
    tried = imports.select("file_path", "import_ord", F.posexplode(tries).alias("rank", "rel"))
    hit = tried.join(files.select(F.col("rel_path").alias("rel"), F.col("path").alias("target")), "rel").groupBy("file_path", "import_ord").agg(F.min_by("target", "rank").alias("target"))
    return imports.join(hit, ["file_path", "import_ord"], "left")
