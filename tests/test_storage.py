from __future__ import annotations

import os

from codeloom import storage


def where(df):
    return storage._paths[df]


def test_tables_are_removed(spark):
    rows = spark.range(10)
    a, b = storage.written(rows, "a"), storage.written(rows, "b")
    assert os.path.isdir(where(a)) and a.count() == 10
    path = where(a)
    storage.discard(a, rows)
    assert not os.path.exists(path) and b.count() == 10
    with storage.scratch() as kept:
        c, d = storage.written(rows, "c"), storage.written(rows, "d")
        gone = where(d)
        kept.append(c)
    assert c.count() == 10 and not os.path.exists(gone)


def test_scopes_nest(spark):
    rows = spark.range(3)
    with storage.scratch() as outer:
        with storage.scratch() as inner:
            a = storage.written(rows, "a")
            inner.append(a)
        path = where(a)
        assert a.count() == 3
        outer.clear()
    assert not os.path.exists(path)


def test_levels(spark, monkeypatch):
    monkeypatch.setattr(storage.Levels, "MERGED", 3)
    levels = storage.Levels("levels")
    for i in range(11):
        new = spark.range(i, i + 1)
        if i:  # made from what is there, as a search does
            new = new.join(levels.table(), "id", "left_anti")
        last = levels.add(new)
        assert [r[0] for r in last.collect()] == [i]
    assert len(levels.parts) <= 5
    assert sorted(r[0] for r in levels.closed().collect()) == list(range(11))


def test_everything_is_removed_at_the_end(tmp_path):
    import subprocess
    import sys

    code = f"""
from pyspark.sql import SparkSession
from codeloom import storage
spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.checkpoint.dir', {str(tmp_path)!r}).getOrCreate()
storage.written(spark.range(5), 'left')
import os
assert [x for x in os.listdir({str(tmp_path)!r}) if x.startswith("codeloom-")]
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120, capture_output=True)
    assert not [x for x in os.listdir(tmp_path) if x.startswith("codeloom-")]  # Spark makes an empty folder of its own
