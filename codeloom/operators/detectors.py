"""Framework detectors: entry points and annotations as filters and projections of parsed rows.

A detector takes (functions, imports) and returns (file_path, func_ord, node_id, type, trigger, description).
``register`` adds one; its number fixes the order of entry points within a module.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import HTTP_VERBS, or_slash, orm_model, orm_operation

CELERY_DECORATORS = ("celery_app.task", "shared_task", "app.task")
CONTROLLERS = ("api_controller", "generic_api_controller")
NINJA_ROUTES = {f"route.{v}": v.upper() for v in HTTP_VERBS if v not in ("head", "options")}

Detector = Callable[[DataFrame, DataFrame], DataFrame]


def _entries(rows: DataFrame, kind: str, trigger: Column) -> DataFrame:
    return rows.select("file_path", "module_path", "func_ord", F.col("qualified_name").alias("node_id"), F.lit(kind).alias("type"), trigger.alias("trigger"), F.col("docstring").alias("description"))


def first_url() -> Column:
    """The first string that leads a decorator's arguments, over all decorators; null if none does."""
    led = F.filter("decorator_details", lambda d: F.coalesce(F.get(d["args"], F.lit(0))["type"] == "str", F.lit(False)))
    return F.get(F.get(led, F.lit(0))["args"], F.lit(0))["value"]


def first_match(pick: Callable[[Column], Column]) -> Column:
    """pick(decorator) of the first decorator where it isn't null."""
    return F.get(F.filter(F.transform("decorators", pick), lambda x: x.isNotNull()), F.lit(0))


def lookup(table: dict[str, str], key: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def celery(functions: DataFrame, imports: DataFrame) -> DataFrame:
    """One entry for each function with a task decorator; the queue is the first that any decorator names."""
    queued = F.filter("decorator_details", lambda d: F.map_contains_key(d["kwargs"], "queue"))
    queue = F.try_element_at(F.get(queued, F.lit(0))["kwargs"], F.lit("queue"))
    told = queue.isNotNull() & ~(queue["value"].isin("", "0", "0.0", "None", "False") & ((queue["type"] != "str") | (queue["value"] == "")))
    tasks = functions.where(F.arrays_overlap("decorators", F.array(*map(F.lit, CELERY_DECORATORS))))
    return _entries(tasks, "celery_task", F.concat(F.lit("Celery task: "), F.col("name"), F.when(told, F.concat(F.lit(" (queue="), queue["value"], F.lit(")"))).otherwise(F.lit(""))))


def ninja(functions: DataFrame, imports: DataFrame) -> DataFrame:
    """Controllers and routes; a controller's URL goes before the routes of all later functions of its module."""
    kind = first_match(lambda d: F.when(d.isin(*CONTROLLERS), F.lit("controller")).otherwise(lookup(NINJA_ROUTES, d)))
    rows = functions.withColumn("kind", kind).where("kind IS NOT NULL").withColumn("url", first_url())
    forward = Window.partitionBy("file_path").orderBy("func_ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("prefix", F.last(F.when(F.col("kind") == "controller", F.coalesce("url", F.lit(""))), ignorenulls=True).over(forward))
    path = F.concat(F.coalesce("prefix", F.lit("")), F.coalesce("url", F.lit("")))
    return _entries(rows, "api_route", F.when(F.col("kind") == "controller", F.concat(F.lit("Controller: "), or_slash(F.col("url")))).otherwise(F.concat("kind", F.lit(" "), path)))


def signals(functions: DataFrame, imports: DataFrame) -> DataFrame:
    """Functions with a receiver decorator; the trigger holds its constants."""
    detail = F.get(F.filter("decorator_details", lambda d: d["name"] == "receiver"), F.lit(0))
    sender = F.try_element_at(detail["kwargs"], F.lit("sender"))["value"]
    told = F.concat_ws(", ", F.get(detail["args"], F.lit(0))["value"], F.concat(F.lit("sender="), sender))
    rows = functions.where(F.array_contains("decorators", "receiver"))
    return _entries(rows, "signal_handler", F.when(told != "", F.concat(F.lit("Signal: "), told)).otherwise(F.concat(F.lit("Signal handler: "), F.col("name"))))


def gate(functions: DataFrame, imports: DataFrame, word: str, names: tuple[str, ...]) -> DataFrame:
    """Functions of modules that import the framework, by module or by one of its names."""
    return functions.join(imports.where(F.col("module").contains(word) | F.col("name").isin(*names)).select("file_path").distinct(), "file_path", "left_semi")


def _verb(decorator: Column, more: dict[str, str]) -> Column:
    return F.when(decorator.contains("."), lookup({v: v.upper() for v in HTTP_VERBS} | more, F.substring_index(decorator, ".", -1)))


def fastapi(functions: DataFrame, imports: DataFrame) -> DataFrame:
    kind = first_match(lambda d: _verb(d, {"websocket": "WS", "websocket_route": "WS"}))
    rows = gate(functions, imports, "fastapi", ("FastAPI", "APIRouter")).withColumn("kind", kind).where("kind IS NOT NULL")
    return _entries(rows, "api_route", F.concat("kind", F.lit(" "), or_slash(first_url())))


def flask(functions: DataFrame, imports: DataFrame) -> DataFrame:
    kind = first_match(lambda d: _verb(d, {"route": "ROUTE", "errorhandler": "ERROR"}))
    rows = gate(functions, imports, "flask", ("Flask", "Blueprint")).withColumn("kind", kind).where("kind IS NOT NULL")
    led = F.filter("decorator_details", lambda d: F.size(d["args"]) > 0)
    code = F.coalesce(F.get(F.get(led, F.lit(0))["args"], F.lit(0))["value"], F.lit("?"))
    return _entries(rows, "api_route", F.concat("kind", F.lit(" "), F.when(F.col("kind") == "ERROR", code).otherwise(or_slash(first_url()))))


DETECTORS: list[tuple[str, Detector]] = [("celery", celery), ("ninja", ninja), ("signals", signals), ("fastapi", fastapi), ("flask", flask)]


def register(name: str, detector: Detector) -> None:
    DETECTORS.append((name, detector))


def entry_points(functions: DataFrame, imports: DataFrame, detectors: list[tuple[str, Detector]] | None = None) -> DataFrame:
    """(ep_ord, node_id, type, trigger, description): all detectors' rows; a function may have several.

    ep_ord is (file_path, detector's number, func_ord); discovered entry points sort after all of these.
    """
    out = None
    for k, (_, detector) in enumerate(detectors if detectors is not None else DETECTORS):
        one = detector(functions, imports).select(F.struct(F.lit(0).alias("found"), "file_path", F.lit(k).alias("detector"), "func_ord").alias("ep_ord"), "node_id", "type", "trigger", "description")
        out = one if out is None else out.unionByName(one)
    return out


def annotations(calls: DataFrame) -> DataFrame:
    """(qualified_name, orm_operation, model, signal, signal_connection, signal_emit) of functions whose
    unconditional calls say something; of each key the last call's value counts."""
    sent = F.col("is_method_call") & (F.col("name") == "send")
    connected = F.col("is_method_call") & (F.col("name") == "connect")
    operation = orm_operation(F.col("name"), F.col("is_method_call"))
    rows = calls.where("branch_ord IS NULL").select(
        F.col("caller").alias("qualified_name"), F.struct("file_path", "func_ord", "call_ord").alias("at"), operation.alias("orm_operation"), F.when(operation.isNotNull(), orm_model(F.col("receiver"))).alias("model"),
        F.when(sent | connected, F.col("receiver")).alias("signal"), F.when(connected, True).alias("signal_connection"), F.when(sent, True).alias("signal_emit"),
    )
    says = rows.where("orm_operation IS NOT NULL OR signal_connection OR signal_emit")
    return says.groupBy("qualified_name").agg(
        F.max_by("orm_operation", F.when(F.col("orm_operation").isNotNull(), F.col("at"))).alias("orm_operation"), F.max_by("model", F.when(F.col("orm_operation").isNotNull(), F.col("at"))).alias("model"),
        F.max_by("signal", F.when(F.coalesce("signal_connection", "signal_emit"), F.col("at"))).alias("signal"), F.max("signal_connection").alias("signal_connection"), F.max("signal_emit").alias("signal_emit"),
    )
