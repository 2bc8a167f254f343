from __future__ import annotations

import json

import pytest

from codeloom import cli
from codeloom.plans import golden, reports
from codeloom.sources.adapters import ADAPTERS, Adapter, Adapters
from codeloom.sources.parse import Tables, parse_texts
from codeloom.sources.pyparse import parse_source


@pytest.fixture(scope="module")
def garden(tmp_path_factory):
    root = tmp_path_factory.mktemp("cli") / "garden"
    for path, content in golden.TREE.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(content)
    return root


@pytest.fixture
def run(spark, garden, tmp_path):
    pointer = str(tmp_path / "last")

    def call(*args):
        out = []
        code = cli.run(list(args), spark, pointer, lambda line: out.extend(str(line).splitlines()))
        return code, out

    return call


def test_commands(run, garden, tmp_path):
    code, out = run("scan", str(garden))
    assert code == 0 and out[0] == "6 modules, 19 functions, 8 entry points, 22 resolved calls" and any("hooks (3 entry points" in x for x in out)
    code, out = run("init")
    assert code == 0 and out[-1] == "Entry points: 8" and any(x.split() == ["flow.models", "6", "1", "0"] for x in out)
    assert run("entries", "--type", "api_route")[1][-1] == "3 entry points"
    assert run("search", "PLOT", "--limit", "2")[1][-1] == "2 results for 'PLOT'"
    assert run("search", str(garden), "plot")[1][-1] == "7 results for 'plot'"
    code, out = run("callers", "water")
    assert out[0] == "Callers of flow.models.Plot.water" and len(out) == 7
    code, out = run("trace", "show_plot", "--depth", "3", "--output", str(tmp_path / "t.json"))
    assert out[0] == "Found: flow.api.show_plot" and "Reachable: 7 functions across 3 files" in out
    assert len(json.loads((tmp_path / "t.json").read_text())["nodes"]) == 7
    assert run("context")[1][0] == "# garden: codebase analysis"
    assert run("context", "refresh")[1][0] == "# flow.jobs.refresh: flow analysis"
    assert run("summary")[0] == 0


def test_what_is_not_there(run, garden):
    assert run("callers", "refresh") == (1, ["error: no project was given, and none is remembered"])
    run("scan", str(garden))
    assert run("callers", "no_such_name") == (1, ["error: no function is named 'no_such_name'"])
    assert run("trace") == (1, ["error: trace needs a name"])
    assert run("explain")[0] == 1


def test_explain(run, garden):
    run("scan", str(garden))
    reports.register_provider("default", golden._Echo)
    try:
        assert run("explain") == (0, ["True ## Project skeleton", "Model: echo"])
        assert run("explain", "refresh") == (0, ["True ## Flow: `flow.jobs.refresh`", "Model: echo"])
    finally:
        reports._PROVIDERS.pop("default")


def test_adapters():
    assert ADAPTERS.get_adapter("a/b.py").language == "python" and ADAPTERS.get_adapter("b.java") is None and ADAPTERS.get_adapter("py") is None
    assert ADAPTERS.get_by_language("python") and ADAPTERS.get_by_language("java") is None
    own = Adapters()
    assert own.get_adapter("a.py") is None and own.supported_languages == []
    own.register(Adapter("python", (".py",), parse_source))
    own.register(Adapter("stub", (".pyi", ".py"), parse_source))
    assert own.supported_languages == ["python", "stub"] and own.supported_extensions == (".py", ".pyi") and own.get_adapter("x.py").language == "stub"


def test_a_language_of_ones_own(spark):
    def parse(text, module_path):
        return parse_source("".join(f"def {x}():\n    pass\n" for x in text.split()), module_path)

    adapters = Adapters(Adapter("names", (".names",), parse))
    files = spark.createDataFrame([("a.names", "a", "one two"), ("b.py", "b", "def f(): pass")], "path string, module_path string, text string")
    assert sorted(r["qualified_name"] for r in Tables(parse_texts(files, adapters)).functions.collect()) == ["a.one", "a.two"]
