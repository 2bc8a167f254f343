from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [str(ROOT), os.environ.get("PYTHONPATH", "")]))
os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.codegen.wholeStage", "false")  # tiny queries: compiling takes longer than running
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def same_as_oracle(spark, sf_dir):
    """Compares a query's rows with its SQL's, as multisets, columns by name."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")

    def plain(x):
        if isinstance(x, float):
            return None if x != x else round(x, 6)
        if isinstance(x, (list, tuple)) or type(x).__name__ == "ndarray":
            return tuple(plain(v) for v in x)
        return x

    def compare(query, sql: str) -> None:
        df = query(spark, sf_dir)
        names = sorted(df.columns)
        mine = [tuple(plain(r[n]) for n in names) for r in df.collect()]
        rel = con.sql(sql)
        at = {c: i for i, c in enumerate(rel.columns)}
        assert sorted(at) == names
        theirs = [tuple(plain(r[at[n]]) for n in names) for r in rel.fetchall()]
        assert sorted(mine, key=repr) == sorted(theirs, key=repr)
        assert theirs

    return compare


@pytest.fixture(scope="session")
def found(spark):
    """All the tests' small projects, parsed and resolved once."""
    from . import test_detectors, test_resolve  # noqa: F401  (they register their projects)
    from .projects import Found

    return Found(spark)
