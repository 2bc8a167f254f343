"""Scalar functions over names, paths, calls and texts. Names hold underscores, so nothing here uses LIKE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BUILTINS = (
    "abs", "all", "any", "dict", "enumerate", "filter", "float", "format", "getattr", "hasattr", "int", "isinstance", "iter", "len", "list", "map",
    "max", "min", "next", "open", "print", "range", "reversed", "set", "setattr", "sorted", "str", "sum", "super", "tuple", "type", "zip",
)
BUILTIN_METHODS = (
    "add", "append", "clear", "copy", "decode", "discard", "encode", "endswith", "extend", "format", "get", "items", "join", "keys", "lower", "pop",
    "remove", "replace", "split", "startswith", "strip", "update", "upper", "values",
)
LOGGING = ("critical", "debug", "error", "exception", "info", "warning")
ORM_OPERATIONS = {
    "read": ("aggregate", "all", "annotate", "count", "distinct", "exclude", "exists", "filter", "first", "get", "last", "order_by", "prefetch_related", "select_related", "values", "values_list"),
    "write": ("bulk_create", "bulk_update", "create", "get_or_create", "save", "update", "update_or_create"),
    "delete": ("delete",),
}
ASYNC_METHODS = {"delay": "celery_delay", "apply_async": "celery_apply_async", "s": "celery_delay", "si": "celery_delay"}
ASYNC_CALLS = {"chain": "celery_chain", "chord": "celery_chord", "group": "celery_group"}
HTTP_VERBS = ("get", "post", "put", "patch", "delete", "head", "options")


def last_part(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def parent(name: Column) -> Column:
    """All but the last part; a name of one part has the empty parent."""
    return F.when(name.contains("."), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(F.lit(""))


def ancestors(name: Column) -> Column:
    """Every proper dotted prefix."""
    parts = F.split(name, r"\.")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "."))).otherwise(F.array().cast("array<string>"))


def suffixes(name: Column) -> Column:
    """Every proper dotted suffix of two parts or more."""
    parts = F.split(name, r"\.")
    return F.when(F.size(parts) > 2, F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))).otherwise(F.array().cast("array<string>"))


def async_type(name: Column, is_method: Column) -> Column:
    """The kind of asynchronous dispatch that a call makes, or null."""
    out = F.lit(None).cast("string")
    for table, method in ((ASYNC_METHODS, True), (ASYNC_CALLS, False)):
        for word, kind in table.items():
            out = F.when((is_method == F.lit(method)) & (name == word), F.lit(kind)).otherwise(out)
    return out


def orm_operation(name: Column, is_method: Column) -> Column:
    out = F.lit(None).cast("string")
    for operation, names in ORM_OPERATIONS.items():
        out = F.when(is_method & name.isin(*names), F.lit(operation)).otherwise(out)
    return out


def orm_model(receiver: Column) -> Column:
    """The part before the first ``objects`` that has one; otherwise the first part."""
    parts = F.split(receiver, r"\.")
    at = F.array_position(parts, F.lit("objects"))
    return F.when(receiver.isNotNull() & (receiver != ""), F.when(at > 1, F.element_at(parts, (at - 1).cast("int"))).otherwise(F.element_at(parts, 1)))


def unresolved_reason(name: Column) -> Column:
    return F.when(name.isin(*BUILTINS), "builtin").when(name.isin(*BUILTIN_METHODS), "builtin_method").when(name.isin(*LOGGING), "logging").otherwise("not_in_project")


def truncate(text: Column, most: int = 60) -> Column:
    """With an ellipsis where it is cut; nothing gives the ellipsis alone."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("...")).when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def short_path(path: Column, parts: int = 3) -> Column:
    """The last parts of a path."""
    split = F.split(path, "/")
    return F.when(F.size(split) > parts, F.array_join(F.slice(split, -parts, parts), "/")).otherwise(path)


def normal_url(url: Column) -> Column:
    """One slash before, none after."""
    return F.concat(F.lit("/"), F.regexp_replace(url, r"^/+|/+$", ""))


def or_slash(path: Column) -> Column:
    return F.coalesce(F.when(path != "", path), F.lit("/"))


def snippet(text: Column, start: Column, end: Column, most: int = 60) -> Column:
    """Lines start..end, counted from 1, clamped to the text, ``most`` of them at most; null for nothing."""
    lines = F.split(F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "\n$", ""), "\n")
    first = F.greatest(start, F.lit(1))
    n = F.least(F.lit(most), F.least(end, F.size(lines)) - first + 1)
    return F.when(n > 0, F.array_join(F.slice(lines, first, F.greatest(n, F.lit(0))), "\n"))


def content_hash(text: Column) -> Column:
    """md5 of the text with every line end as a line feed."""
    return F.md5(F.regexp_replace(text, "\r\n?", "\n").cast("binary"))
