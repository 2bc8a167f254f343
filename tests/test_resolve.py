from __future__ import annotations

import pytest

from codeloom.plans.engine import Engine

from .projects import project

SELF = project({"a": "class A(B):\n    def run(self):\n        self.own(); self.up(); self.x.own(); cls.own(); super().up()\n    def own(self): pass\nclass B(C): pass\nclass C:\n    def up(self): pass\n"})
DIAMOND = project({"a": "class A(B, C): pass\nclass B(D): pass\nclass C:\n    def m(self): pass\nclass D(A):\n    def m(self): pass\ndef f(x: A):\n    x.m()\n"})
FAR_BASE = project({"b": "class Base:\n    def m(self): pass\n", "a": "from PKG.b import Base as Other\nclass A(Other):\n    def f(self):\n        self.m()\n"})
_T = "class T:\n    def m(self): pass\nclass U:\n    def m(self): pass\n"
RULES = {
    project({"a": _T + body}): (callee, how)
    for body, callee, how in [
        ("def f(x: T):\n    x.m()\n", "a.T.m", "parameter"),
        ("def f():\n    x = T()\n    x.m()\n", "a.T.m", "local"),
        ("def f():\n    x: T = g()\n    x.m()\n", "a.T.m", "local"),
        ("def g() -> T: pass\ndef f():\n    x = g()\n    x.m()\n", "a.T.m", "return"),
        ("def f():\n    T.objects.get(1)\n", "a.T", "orm"),
        ("def f():\n    T.m()\n", "a.T.m", "import"),
        ("def f(x: T):\n    x = U()\n    x.m()\n", "a.T.m", "parameter"),
        ("def f():\n    T()\n", "a.T", "name"),
        ("class V(T): pass\ndef f():\n    x = V()\n    x.m()\n", "a.T.m", "local-inherited"),
    ]
}
SUFFIX = project({"zeta": "class Deep:\n    def m(self): pass\n", "a": "def f(x: zeta.Deep):\n    x.m()\n"})
NO_FALLBACK = project({"a": "def m(): pass\ndef f(x):\n    x.m()\n    ''.m()\n    print(); x.append(1); x.info(); nowhere()\n"})
SHADOW = project({"a": "def get(): pass\nclass S:\n    def get(self): pass\ndef f():\n    get()\n"})
NEVER = project({"p.__init__": "def g(): pass\n", "p.q": "def h(): pass\n", "a": "import PKG.p.q\nfrom PKG.p import g\nfrom PKG.p.q import *\nfrom ....x import y\ndef f():\n    g(); h(); y(); q.h()\n"})
RELATIVE = project({"p.q.r": "from ..s import g\nfrom . import t\ndef f():\n    g(); t.h()\n", "p.s": "def g(): pass\n", "p.q.t": "def h(): pass\n"})
INSTANCE = project({"c": "class T:\n    def m(self): pass\n", "b": "from PKG.c import T\none = T()\n", "a": "from PKG.b import one\ndef f():\n    one.m()\n"})
MUTUAL = project({"x": "from PKG.y import a\nb = a()\ndef f():\n    a.m()\n", "y": "from PKG.x import b\na = b()\n"})
WHERE = project({"a": "from PKG.b import g\nfrom PKG.a.c import k\ndef f():\n    if x:\n        g()\n    else:\n        g.delay()\n    k()\n", "b": "def g(): pass\n", "a.c": "def k(): pass\n"})
TWICE = project({"a": "class A:\n    @property\n    def v(self): one()\n    @v.setter\n    def v(self, x): two()\ndef one(): pass\ndef two(): pass\n"})
BROKEN = project({"a": "def (", "b": ""})


def test_self_and_inherited_methods(found):
    assert found.of(SELF, "a.A.run") == {("a.A.own", "self"), ("a.C.up", "self-inherited")}


def test_breadth_first_order_and_cycles_of_bases(found):
    assert found.of(DIAMOND, "a.f") == {("a.C.m", "parameter-inherited")}


def test_base_through_an_import(found):
    assert found.of(FAR_BASE, "a.A.f") == {("b.Base.m", "self-inherited")}


@pytest.mark.parametrize("name", RULES)
def test_rules(found, name):
    assert RULES[name] in found.of(name, "a.f")


def test_suffix_of_a_type_that_is_not_imported(found):
    assert found.of(SUFFIX, "a.f") == {("zeta.Deep.m", "parameter-suffix")}


def test_nothing_falls_back_from_methods_to_plain_calls(found):
    assert [(r["callee"], r["receiver"]) for r in found.edges(NO_FALLBACK)] == [("a.m", None)]
    assert found.unresolved(NO_FALLBACK) == {("m", "not_in_project"), ("print", "builtin"), ("append", "builtin_method"), ("info", "logging"), ("nowhere", "not_in_project")}


def test_a_method_name_shadows_plain_calls(found):
    assert found.of(SHADOW, "a.f") == {("a.S.get", "name")}


def test_imports_that_never_resolve(found):
    assert found.of(NEVER, "a.f") == set()


def test_relative_imports(found):
    assert found.of(RELATIVE, "p.q.r.f") == {("p.s.g", "name"), ("p.q.t.h", "import")}


def test_instances_of_other_modules(found):
    assert found.of(INSTANCE, "a.f") == {("c.T.m", "import")}
    assert found.edges(MUTUAL) == []


def test_conditions_files_and_dispatch(found):
    rows = {(r["callee"], r["condition"], r["is_cross_file"], r["async_type"]) for r in found.edges(WHERE)}
    assert rows == {("b.g", "x", True, None), ("b.g", "else", True, "celery_delay"), ("a.c.k", None, False, None)}


def test_repeated_names_keep_the_first_place_and_the_last_value(found):
    v = found.nodes(TWICE)["a.A.v"]
    assert v["decorators"] == ["v.setter"] and v["reg_ord"]["func_ord"] == 1
    assert {c for c, _ in found.of(TWICE, "a.A.v")} == {"a.one", "a.two"}


def test_broken_and_empty_modules(spark, found):
    assert found.nodes(BROKEN) == {}
    none = spark.createDataFrame([], "path string, module_path string, text string")
    assert set(Engine.from_texts(none).totals().first().asDict().values()) == {0}


def test_ancestors_of_any_height(spark):
    from codeloom.operators.index import mro

    n = 40
    bases = spark.createDataFrame([(f"C{i}", 0, f"C{i + 1}") for i in range(n)] + [(f"C{n}", 0, "C0")], "class string, base_ord int, base string")
    found = {(r["class"], r["ancestor"]): r["level"] for r in mro(bases).collect()}
    assert found["C0", f"C{n}"] == n and found["C0", "C0"] == n + 1 and len(found) == (n + 1) ** 2


def test_instances_through_any_number_of_imports(spark):
    n = 8
    modules = {"k.m0": "class T:\n    def go(self): pass\nx = T()\n"} | {f"k.m{i}": f"from k.m{i - 1} import x as y\nx = y()\n" for i in range(1, n)}
    modules["k.end"] = f"from k.m{n - 1} import x\ndef f():\n    x.go()\n"
    files = spark.createDataFrame([(m.replace(".", "/") + ".py", m, t) for m, t in modules.items()], "path string, module_path string, text string")
    got = {(r["caller"], r["callee"]) for r in Engine.from_texts(files).edges.collect()}
    assert ("k.end.f", "k.m0.T.go") in got
