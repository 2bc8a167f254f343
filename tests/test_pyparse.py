from __future__ import annotations

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.sources.pyparse import ParseFailure, decoded, parse_rows, parse_source


def functions(text):
    return {f["name"]: f for f in parse_source(text, "m")["functions"]}


def calls(text, name="f"):
    return [(c["receiver"], c["name"]) for c in functions(text)[name]["calls"]]


def body(*lines):
    return "def f():\n" + "\n".join("    " + x for x in lines) + "\n"


def test_functions_classes_and_methods():
    f = functions("async def a():\n    '''Says.'''\n\nclass C(Base, x.Y, z[0]):\n    @d\n    def m(self) -> 'T':\n        def inner(): pass\n    class D:\n        def n(self): pass\n    def late(self): pass\nif True:\n    def guarded(): pass\n")
    assert [(n, x["type"]) for n, x in f.items()] == [("a", "function"), ("C", "class"), ("C.m", "method"), ("D", "class"), ("D.n", "method"), ("late", "function"), ("guarded", "function")]
    assert f["a"]["docstring"] == "Says." and f["C.m"]["return_type"] == "T" and f["C.m"]["class_name"] == "C"
    module = parse_source("class C(Base, x.Y, z[0]): pass", "m")
    assert module["classes"] == [{"name": "C", "qualified_name": "m.C", "bases": ["Base", "x.Y"]}]


def test_imports():
    rows = parse_source("import a.b as c, d\nfrom .. import e\nfrom .g import h as i\ndef f():\n    import hidden\n", "m")["imports"]
    assert [(r["module"], r["name"], r["alias"], r["is_relative"], r["level"]) for r in rows] == [("a.b", "b", "c", False, 0), ("d", "d", None, False, 0), ("", "e", None, True, 2), ("g", "h", "i", True, 1)]


def test_calls_in_order_and_receivers():
    assert calls(body("a(b(), c.d(e()))")) == [(None, "a"), (None, "b"), ("c", "d"), (None, "e")]
    assert calls(body("A.objects.filter(x).first()")) == [("A.objects.filter", "first"), ("A.objects", "filter")]
    assert calls(body("''.join(x)", "a[0].b.c()", "f()()", "a[0]()")) == [(None, "join"), ("b", "c"), (None, "f")]
    assert calls(body("[g(x) for x in h()]", "k = lambda: m()", "def n():", "    o()")) == [(None, "g"), (None, "h"), (None, "m"), (None, "o")]
    assert functions(body("a(1, *b, c=2)"))["f"]["calls"][0]["args_count"] == 2


def branches(*lines):
    f = functions(body(*lines))["f"]
    return [(b["condition"], b["is_else"], [c["name"] for c in b["calls"]]) for b in f["branches"]], [c["name"] for c in f["calls"]]


def test_branches():
    assert branches("if t():", "    a()", "else:", "    b()", "c()") == ([("t()", False, ["a"]), ("not (t())", True, ["b"])], ["t", "c"])
    # what follows a nested if counts as unconditional
    assert branches("if x:", "    a()", "    if y:", "        b()", "    c()") == ([("y", False, ["b"]), ("x", False, ["a"])], ["c"])
    assert branches("if x:", "    a()", "elif y:", "    b()") == ([("x", False, ["a"]), ("y", False, ["b"]), ("not (x)", True, [])], [])
    assert branches("for x in y:", "    a()", "while z:", "    b()", "try:", "    c()", "finally:", "    d() if e() else g()") == ([], ["a", "b", "c", "e", "d", "g"])


def test_types():
    f = functions(body("x = Foo()", "y = Foo.make()", "z = mod.build()", "u: Bar = None", "w = lower()", "v = w = Foo()", "x = Late()"))["f"]
    assert f["local_types"] == {"x": "Late", "y": "Foo", "z": "mod.build", "u": "Bar"} and f["call_assignments"] == {"w": "lower"}
    hints = functions("def f(self, a: A, b: m.B, c: Optional[C], d: D | None, e: None | E, g: 'G', h: list[H], i: J | K, *, k: L): pass")["f"]["parameter_types"]
    assert hints == {"a": "A", "b": "m.B", "c": "C", "d": "D", "e": "E", "g": "G"}
    assert parse_source("a = f()\nb = F.g()\nc = m.g()\nd: D = D()\nclass X:\n    e = E()\n", "m")["module_types"] == {"a": "f", "b": "F", "c": "m.g"}


def test_decorators():
    f = functions("@plain\n@a.b('x', 1, y, k=None, q='z', **w)\n@c[0]\n@d()()\ndef f(): pass\n")["f"]
    assert f["decorators"] == ["plain", "a.b"]
    assert f["decorator_details"][1] == {"name": "a.b", "args": [{"type": "str", "value": "x"}, {"type": "int", "value": "1"}], "kwargs": {"k": {"type": "NoneType", "value": "None"}, "q": {"type": "str", "value": "z"}}}


def test_texts_that_are_no_modules():
    with pytest.raises(ParseFailure):
        decoded(b"\xff\xfe")
    bad = [("a", "a", b"def ("), ("b", "b", b"x = '\0'"), ("c", "c", b"\xef\xbb\xbfx = 1"), ("d", "d", b"\xff"), ("e", "e", ("-" * 100_000 + "1").encode()), ("f", "f", b""), ("g", "g", b"x = 1\r\ny = 2\r")]
    rows = {r["file_path"]: r for r in parse_rows(iter(bad))}
    assert [k for k, r in rows.items() if r["parse_error"]] == ["a", "b", "c", "d", "e"]
    assert rows["g"]["file_hash"] == hashlib.md5(b"x = 1\ny = 2\n").hexdigest() and rows["f"]["functions"] == []


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=200))
def test_any_text_gives_one_row(text):
    assert len(list(parse_rows(iter([("p", "m", text)])))) == 1


def test_rows_are_handed_on_in_slices(monkeypatch):
    """A frame holds the rows of some text, not of all that comes in one batch."""
    from codeloom.sources import parse

    monkeypatch.setattr(parse, "SLICE", 100)
    text = "def f():\n    return g()\n"
    frames = list(parse._frames(((f"{i}.py", f"m{i}", text) for i in range(50)), parse.ADAPTERS))
    assert max(map(len, frames)) <= 100 // len(text) + 1
    assert [r for f in frames for r in f["module_path"]] == [f"m{i}" for i in range(50)]
    assert list(parse._frames(iter([("a.txt", "a", "x")]), parse.ADAPTERS)) == []
