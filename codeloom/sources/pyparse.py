"""Python source text -> plain rows. The only place that touches syntax trees; it knows nothing of Spark."""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Iterator
from typing import Any


class ParseFailure(Exception):
    """The text is not a module that this interpreter can parse."""


def plain_name(node: ast.AST) -> str | None:
    return node.id if isinstance(node, ast.Name) else None


def dotted(node: ast.expr) -> str | None:
    """``a.b.c`` for names and attributes; an attribute of anything else keeps its own trailing names only."""
    names: list[str] = []
    while isinstance(node, ast.Attribute):
        names.insert(0, node.attr)
        node = node.value
    if (own := plain_name(node)) is not None:
        names.insert(0, own)
    return ".".join(names) if names else None


def receiver_of(node: ast.expr) -> str | None:
    """What a method is called on; calls in between are looked through, other bases have no name."""
    names: list[str] = []
    while True:
        if isinstance(node, ast.Attribute):
            names.append(node.attr)
            node = node.value
        elif isinstance(node, ast.Call):
            node = node.func
        else:
            break
    if isinstance(node, ast.Name):
        names.append(node.id)
    return ".".join(names[::-1]) or None


def annotation_name(node: ast.expr | None) -> str | None:
    """The one type an annotation names, or None for unions and generics."""
    if isinstance(node, (ast.Name, ast.Attribute)):
        return dotted(node)
    if isinstance(node, ast.Constant):
        return node.value if isinstance(node.value, str) else None
    if isinstance(node, ast.Subscript):
        return annotation_name(node.slice) if plain_name(node.value) == "Optional" else None
    if isinstance(node, ast.BinOp) and type(node.op) is ast.BitOr:
        for side, other in ((node.right, node.left), (node.left, node.right)):
            if isinstance(side, ast.Constant) and side.value is None:
                return annotation_name(other)
    return None


def made_by(value: ast.expr) -> tuple[str, str] | None:
    """What an assigned call makes: ("name", f) for f(), ("factory", X) for X.f() with a capital, ("dotted", m.f)."""
    if not isinstance(value, ast.Call):
        return None
    f = value.func
    if isinstance(f, ast.Name):
        return "name", f.id
    if isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name):
        owner = f.value.id
        return ("factory", owner) if owner[:1].isupper() else ("dotted", f"{owner}.{f.attr}")
    return None


def single_target(node: ast.Assign) -> str | None:
    first, *others = node.targets
    return None if others else plain_name(first)


def constant(value: Any) -> dict[str, str]:
    """A constant with its type, since URLs must be strings and error codes may be numbers."""
    return {"type": type(value).__name__, "value": value if isinstance(value, str) else str(value)}


def decorators_of(node: ast.AST) -> tuple[list[str], list[dict]]:
    """(names, details) of the decorators; one without a name has details only, if it is a call."""
    names, details = [], []
    for d in node.decorator_list:
        called = isinstance(d, ast.Call)
        target = d.func if called else d
        name = dotted(target) if isinstance(target, (ast.Name, ast.Attribute)) else None
        if name is not None:
            names.append(name)
        if called:
            args = [constant(a.value) for a in d.args if isinstance(a, ast.Constant)]
            kwargs = {k.arg: constant(k.value.value) for k in d.keywords if k.arg and isinstance(k.value, ast.Constant)}
            details.append({"name": name, "args": args, "kwargs": kwargs})
        elif name is not None:
            details.append({"name": name, "args": [], "kwargs": {}})
    return names, details


class Body:
    """Calls, branches and assigned types of a function body, read in source order.

    A branch is open while the statements of an ``if`` or ``else`` are read. A nested ``if`` closes it for good:
    what follows in the outer branch counts as unconditional.
    """

    def __init__(self, statements: list[ast.stmt]):
        self.calls: list[dict] = []
        self.branches: list[dict] = []
        self.types: dict[str, str] = {}
        self.assigned: dict[str, str] = {}
        self._open: list[dict] | None = None
        for s in statements:
            self._read(s)

    def _read(self, node: ast.AST) -> None:
        if isinstance(node, ast.If):
            self._read_if(node)
            return
        if isinstance(node, ast.Call):
            self._read_call(node)
        elif isinstance(node, ast.Assign):
            self._read_assignment(node)
        elif isinstance(node, ast.AnnAssign):
            target, hint = plain_name(node.target), plain_name(node.annotation)
            if target is not None and hint is not None:
                self.types[target] = hint
        for child in ast.iter_child_nodes(node):
            self._read(child)

    def _read_assignment(self, node: ast.Assign) -> None:
        target, made = single_target(node), made_by(node.value)
        if target is None or made is None:
            return
        kind, name = made
        if kind == "name" and not name[:1].isupper():
            self.assigned[target] = name
        else:
            self.types[target] = name

    def _read_call(self, node: ast.Call) -> None:
        f = node.func
        row = {"line": node.lineno, "args_count": len(node.args)}
        if isinstance(f, ast.Name):
            row |= {"name": f.id, "receiver": None, "is_method_call": False}
        elif isinstance(f, ast.Attribute):
            row |= {"name": f.attr, "receiver": receiver_of(f.value), "is_method_call": True}
        else:
            return
        (self.calls if self._open is None else self._open).append(row)

    def _branch(self, statements: list[ast.stmt], condition: str | None, line: int, is_else: bool) -> None:
        calls: list[dict] = []
        self._open = calls
        for s in statements:
            self._read(s)
        self._open = None
        self.branches.append({"condition": condition, "line": line, "is_else": is_else, "calls": calls})

    def _read_if(self, node: ast.If) -> None:
        text = ast.unparse(node.test)
        self._read(node.test)
        self._branch(node.body, text, node.lineno, False)
        if node.orelse:
            self._branch(node.orelse, f"not ({text})", node.lineno, True)


class ModuleReader:
    """Functions, classes, imports and instances of a module; bodies of functions hold none of them."""

    def __init__(self, tree: ast.Module, module_path: str):
        self.module_path = module_path
        self.functions: list[dict] = []
        self.classes: dict[str, dict] = {}
        self.n_classes = 0
        self.imports: list[dict] = []
        self.types: dict[str, str] = {}
        self._class: str | None = None
        self._children(tree)

    def _children(self, node: ast.AST) -> None:
        for child in ast.iter_child_nodes(node):
            self._read(child)

    def _read(self, node: ast.AST) -> None:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            self._function(node)
        elif isinstance(node, ast.ClassDef):
            self._class_row(node)
        elif isinstance(node, ast.Import):
            self.imports += [self._import(a, a.name, a.name.rpartition(".")[2], 0) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            self.imports += [self._import(a, node.module or "", a.name, node.level) for a in node.names]
        elif isinstance(node, ast.Assign):
            target, made = single_target(node), made_by(node.value)
            if self._class is None and target is not None and made is not None:
                self.types[target] = made[1]
        else:
            self._children(node)

    @staticmethod
    def _import(alias: ast.alias, module: str, name: str, level: int) -> dict:
        return {"module": module, "name": name, "alias": alias.asname, "is_relative": level > 0, "level": level}

    def _row(self, node: ast.AST, name: str, kind: str) -> dict:
        names, details = decorators_of(node)
        return {
            "qualified_name": f"{self.module_path}.{name}", "name": name, "type": kind, "class_name": None,
            "line_start": node.lineno, "line_end": node.end_lineno or node.lineno, "docstring": ast.get_docstring(node),
            "decorators": names, "decorator_details": details, "return_type": None, "calls": [], "branches": [],
            "local_types": {}, "parameter_types": {}, "call_assignments": {},
        }

    def _class_row(self, node: ast.ClassDef) -> None:
        self.n_classes += 1
        self._class = node.name
        bases = [dotted(b) for b in node.bases if isinstance(b, (ast.Name, ast.Attribute))]
        self.classes[node.name] = {"name": node.name, "qualified_name": f"{self.module_path}.{node.name}", "bases": bases}
        self.functions.append(self._row(node, node.name, "class"))
        self._children(node)
        self._class = None

    def _function(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        owner = self._class
        row = self._row(node, f"{owner}.{node.name}" if owner else node.name, "method" if owner else "function")
        body = Body(node.body)
        hints = {a.arg: annotation_name(a.annotation) for a in node.args.args if a.arg not in ("self", "cls")}
        self.functions.append(row | {
            "class_name": owner, "return_type": annotation_name(node.returns) or None, "calls": body.calls, "branches": body.branches,
            "local_types": body.types, "parameter_types": {k: v for k, v in hints.items() if v}, "call_assignments": body.assigned,
        })


def decoded(data: bytes) -> str:
    """Strict UTF-8, with every line end as a line feed."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError as e:
        raise ParseFailure(f"not UTF-8: {e.reason}") from e
    return text.replace("\r\n", "\n").replace("\r", "\n")


def parse_source(text: str, module_path: str) -> dict:
    """All that is known about a module; raises ParseFailure for what Python can't parse."""
    try:
        tree = ast.parse(text)
        m = ModuleReader(tree, module_path)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        raise ParseFailure(f"{type(e).__name__}: {e}") from e
    file_hash = hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()
    return {"functions": m.functions, "classes": list(m.classes.values()), "n_classes": m.n_classes, "imports": m.imports, "module_types": m.types, "file_hash": file_hash}


def parse_rows(files: Iterator[tuple[str, str, bytes | str]], adapters=None) -> Iterator[dict]:
    """(path, module_path, content) -> a module row each, by the adapter of its extension (all as Python without
    adapters); a failure gives a row with parse_error and nothing else."""
    for path, module_path, content in files:
        adapter = adapters.get_adapter(path) if adapters else None
        if adapters and adapter is None:
            continue
        row = {"file_path": path, "module_path": module_path, "parse_error": None, "file_hash": None, "n_classes": 0, "functions": [], "classes": [], "imports": [], "module_types": {}}
        try:
            text = decoded(content) if isinstance(content, bytes) else content.replace("\r\n", "\n").replace("\r", "\n")
            yield row | (adapter.parse if adapter else parse_source)(text, module_path)
        except ParseFailure as e:
            yield row | {"parse_error": str(e)}
