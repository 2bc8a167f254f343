from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from codeloom.plans import roundtrip
from codeloom.plans.engine import Engine
from codeloom.sources import listing, store


@pytest.fixture
def project(tmp_path):
    root = tmp_path / "shop"
    for m, text in roundtrip.GOLDEN.items():
        path = root / (m.replace(".", "/") + ".py")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    (root / "app" / "__init__.py").write_text("")
    (root / "venv").mkdir()
    (root / "venv" / "hidden.py").write_text("def hidden(): pass\n")
    (root / "tests").mkdir()
    (root / "tests" / "test_it.py").write_text("def test(): pass\n")
    (root / "notes.txt").write_text("no")
    old = 1_600_000_000
    for folder, _, files in os.walk(root):
        for f in files:
            os.utime(os.path.join(folder, f), (old, old))
    return root


def test_listing(spark, project):
    names = lambda **x: {r["rel_path"] for r in listing.listing(spark, listing.Config(str(project), **x)).collect()}
    own = {"app/__init__.py", *(m.replace(".", "/") + ".py" for m in roundtrip.GOLDEN)}
    assert names() == own
    assert names(include_tests=True) == own | {"tests/test_it.py"}
    assert names(exclude=("app",)) == {"venv/hidden.py"}
    inside = listing.Config(str(project / "venv"))
    assert listing.listing(spark, inside).count() == 1
    assert listing.listing(spark, listing.Config(str(project / "venv"), absolute_exclude=True)).count() == 0
    rows = listing.listing(spark, listing.Config(str(project))).select(listing.module_path(F.col("rel_path")).alias("m"))
    assert {r["m"] for r in rows.collect()} == {"app.__init__", *roundtrip.GOLDEN}


def test_import_files(spark):
    files = spark.createDataFrame([(f"/r/{p}", p) for p in ("a/b.py", "a/__init__.py", "a/c/__init__.py", "d.py")], "path string, rel_path string")
    rows = [("x", 0, "a/b.py", "", "c", True, 1), ("x", 1, "a/b.py", "a", "b", False, 0), ("x", 2, "a/b.py", "a.c", "f", False, 0), ("x", 3, "a/b.py", "", "d", True, 2), ("x", 4, "a/b.py", "os", "path", False, 0), ("x", 5, "a/b.py", "d", "g", False, 0)]
    imports = spark.createDataFrame(rows, "file_path string, import_ord int, rel_path string, module string, name string, is_relative boolean, level int")
    assert [r["target"] for r in listing.import_files(imports, files).orderBy("import_ord").collect()] == ["/r/a/c/__init__.py", "/r/a/b.py", "/r/a/c/__init__.py", "/r/d.py", None, "/r/d.py"]


def test_freshness(spark, project):
    config = listing.Config(str(project))
    fresh = lambda c=config: store.fresh(spark, c, listing.listing(spark, c))
    assert not fresh()
    first = Engine.open(spark, config)
    assert fresh() and not fresh(listing.Config(str(project), include_tests=True))
    again = Engine.open(spark, config)
    for t in store.TABLES:
        assert again.tables[t].count() == first.tables[t].count()
    (project / "venv" / "hidden.py").write_text("x = 1\n")
    assert fresh()
    (project / "app" / "jobs.py").write_text("def only(): pass\n")
    assert not fresh()
    assert Engine.open(spark, config).nodes.where("qualified_name = 'app.jobs.only'").count() == 1
    meta = os.path.join(config.store, "meta.json")
    broken = json.load(open(meta)) | {"version": -1}
    for text in (json.dumps(broken), "{", "[]"):
        open(meta, "w").write(text)
        assert store.load(spark, config) is None and not fresh()


def test_last_project(tmp_path):
    pointer = str(tmp_path / "deep" / "last")
    with pytest.raises(ValueError):
        store.project_and_argument(None, None, pointer)
    store.remember(str(tmp_path), pointer)
    assert store.project_and_argument("run", None, pointer) == (str(tmp_path), "run")
    assert store.project_and_argument(str(tmp_path), "run", pointer) == (str(tmp_path), "run")
    assert store.project_and_argument(None, "run", pointer) == (str(tmp_path), "run")


@pytest.fixture(scope="module")
def golden(spark):
    return roundtrip.golden_engine(spark)


def test_questions(golden):
    assert golden.find("run") == "app.jobs.run"
    with pytest.raises(LookupError):
        golden.find("nothing_like_it")
    assert [(r["caller"], r["condition"]) for r in golden.callers("raise_alert").collect()] == [("app.jobs.run", "not check(row)")]
    assert {r["qualified_name"]: r["is_entry_point"] for r in golden.search("RUN").collect()} == {"app.jobs.run": True}
    assert [r["trigger"] for r in golden.entries("api_route").collect()] == ["GET /rows/{key}", "WS /ws"]
    assert golden.overview()["stats"]["total_edges"] == 19 and set(golden.overview()["entry_points_by_type"]) == {"api_route", "celery_task", "discovered"}
    assert {r["caller"] for r in golden.summary()["top_callers"].collect()} >= {"app.jobs.run", "app.jobs.store"}
    assert golden.scan().agg(F.sum("count")).first()[0] == 5
    assert [r["module_path"] for r in golden.modules_report().collect()] == sorted(roundtrip.GOLDEN)
    assert golden.search_payload("")["results"] == []
    assert golden.search_payload("app", 500)["results"] and golden.callers_payload("app.jobs.run")["callers"][0]["qualified_name"] == "app.jobs.main"


def test_trace(golden, tmp_path):
    t = golden.trace("main", 10)
    assert t["entry_point"] == "app.jobs.main" and "app.shelf.Base.touch" in t["nodes"]
    assert t["metadata"]["async_boundaries"] == 2 and t["metadata"]["total_files"] == 4
    assert golden.graph_trace("app.jobs.main", 10)["nodes"]["app.jobs.run"]["branches"][0]["condition"] == "not check(row)"
    short = golden.graph_trace("app.jobs.main", 1)
    assert [e["target"] for e in short["edges"]] == ["app.jobs.run"] and short["nodes"]["app.jobs.run"]["expandable"]
    golden.write_trace("main", str(tmp_path / "t.json"))
    assert json.loads((tmp_path / "t.json").read_text())["metadata"] == t["metadata"]


def test_texts(golden):
    tree = golden.call_tree("main", 6)
    assert tree.splitlines()[0] == "main" and "⚡ run (celery_apply_async)" in tree and "if not check(row)" in tree
    sources = {m.replace(".", "/") + ".py": text for m, text in roundtrip.GOLDEN.items()}
    from codeloom.plans import reports

    assert "raise_alert(row)" in reports.flow_context(golden, "app.jobs.run", texts=sources)
    assert "```json" in reports.narration_prompt(golden, "app.jobs.run", texts=sources)
    assert "Celery task: run (queue=slow)" in golden.context() and "**celery_task** (2):" in golden.skeleton()
