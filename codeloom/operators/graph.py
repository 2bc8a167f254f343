"""Graph operators over any nodes and edges: neighbours, reach, paths, depth-first traces, entry discovery.

Edges are (edge_ord, caller, callee, ...); the children of a node are its edges in edge_ord.
"""

from __future__ import annotations

import weakref
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import Levels, stored, written

NOISE = (
    "abstractmethod", "asynccontextmanager", "cached_method", "cached_property", "classmethod", "classproperty", "computed_field",
    "contextlib.asynccontextmanager", "contextlib.contextmanager", "contextmanager", "dataclass", "dataclass_json", "declared_attr", "deprecated",
    "event.listens_for", "field_validator", "functools.cached_property", "functools.lru_cache", "functools.wraps", "hybrid_property", "lru_cache",
    "metrics.wraps", "model_validator", "overload", "override", "property", "pytest.fixture", "pytest.mark.parametrize", "root_validator",
    "sentry_sdk.trace", "sentry_sdk.tracing.trace", "staticmethod", "total_ordering", "typing.overload", "validator",
)


def callees(edges: DataFrame, names: DataFrame) -> DataFrame:
    """All edges that leave the names (one column)."""
    return edges.join(names.select(F.col(names.columns[0]).alias("caller")).distinct(), "caller", "left_semi")


def callers(edges: DataFrame, names: DataFrame) -> DataFrame:
    """All edges that arrive at the names (one column)."""
    return edges.join(names.select(F.col(names.columns[0]).alias("callee")).distinct(), "callee", "left_semi")


def callers_payload(edges: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """(edge_ord, qualified_name, name, file, line_start, type, is_cross_file) of registered callers."""
    hit = edges.where(F.col("callee") == name).select("edge_ord", F.col("caller").alias("qualified_name"), "is_cross_file")
    return hit.join(nodes.select("qualified_name", "name", F.col("file_path").alias("file"), "line_start", "type"), "qualified_name")


def discover(nodes: DataFrame, edges: DataFrame, known: DataFrame, noise: tuple[str, ...] = NOISE) -> DataFrame:
    """Nodes that look registered by a decorator: nothing calls them, they call something, and their first decorator
    that isn't noise is the trigger. known: (node_id).

    nodes: (qualified_name, type, decorators, ...). Adds ``trigger`` to them.
    """
    rest = F.get(F.array_except("decorators", F.array(*map(F.lit, noise)) if noise else F.array().cast("array<string>")), F.lit(0))
    rows = nodes.where((F.col("type") != "class") & (F.size("decorators") > 0)).withColumn("trigger", F.concat(F.lit("@"), rest)).where("trigger IS NOT NULL")
    return (
        rows.join(known.select(F.col("node_id").alias("qualified_name")).distinct(), "qualified_name", "left_anti")
        .join(edges.select(F.col("caller").alias("qualified_name")).distinct(), "qualified_name", "left_semi")
        .join(edges.select(F.col("callee").alias("qualified_name")).distinct(), "qualified_name", "left_anti")
    )


class Graph:
    """A graph whose nodes are numbers: joins and distinct steps then shuffle two longs a row instead of two names.

    ``nodes`` is (node, id), ``steps`` the distinct (caller, callee) as numbers, ``known`` the edges with numbers of their
    own and of their ends. All are written, once for the same frame of edges (``graph_of``).
    """

    def __init__(self, edges: DataFrame):
        self._edges = edges
        # names are numbered in their order, so that the numbers of a list are near each other and pack well
        names = edges.select(F.explode(F.array("caller", "callee")).alias("node")).where("node IS NOT NULL").distinct().repartitionByRange("node").sortWithinPartitions("node")
        # written with its numbers: a task that runs again can't number anew
        self.nodes = written(names.withColumn("id", F.monotonically_increasing_id()), "node-numbers")
        # one exchange by the caller serves the distinct step and the join
        pairs = edges.select("caller", "callee").repartition("caller").distinct()
        self.steps = written(self._numbered(pairs).select(F.col("caller_id").alias("caller"), F.col("callee_id").alias("callee")), "steps")

    def _numbered(self, edges: DataFrame) -> DataFrame:
        for end in ("caller", "callee"):
            edges = edges.join(self.nodes.select(F.col("node").alias(end), F.col("id").alias(f"{end}_id")), end)
        return edges

    @cached_property
    def known(self) -> DataFrame:
        return written(self._numbered(self._edges.select("edge_ord", "caller", "callee")).withColumn("edge", F.monotonically_increasing_id()), "edge-numbers")

    @property
    def alive(self) -> bool:
        return stored(self.nodes) and stored(self.steps) and ("known" not in self.__dict__ or stored(self.known))

    def roots(self, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
        """((root, id) of roots that are nodes, (root) of those that no edge touches)"""
        start = roots.select(F.col(roots.columns[0]).alias("root")).where("root IS NOT NULL").distinct()
        nodes = self.nodes.select(F.col("node").alias("root"), "id")
        return start.join(nodes, "root"), start.join(nodes, "root", "left_anti")

    def _down(self, roots: DataFrame, depth: int) -> tuple[DataFrame, DataFrame | None]:
        """((root, node, distance) within depth, those of them at depth), written; one join a level."""
        levels = Levels("reach")
        last = levels.add(roots.select(F.col("id").alias("root"), F.col("id").alias("node"), F.lit(0).alias("distance")))
        for level in range(1, depth + 1):
            new = last.join(self.steps, last.node == self.steps.caller).select("root", F.col("callee").alias("node")).distinct()
            last = levels.add(new.join(levels.table().select("root", "node"), ["root", "node"], "left_anti").withColumn("distance", F.lit(level)))
            if last.isEmpty():
                return levels.table(), None
        return levels.table(), last

    def _balls(self, nodes: DataFrame, depth: int, base: int) -> DataFrame:
        """(node, ball) of those of the nodes (node) that have steps: all that is within depth of it, packed, written."""
        mine = self.steps.join(nodes.select(F.col("node").alias("caller")).distinct(), "caller", "left_semi")
        rows = mine.select(F.col("caller").alias("owner"), F.col("callee").alias("node"), F.lit(1).alias("distance"))
        if depth > 1:
            rows = rows.join(self._balls(rows.select("node"), depth - 1, base), "node", "left")
        else:
            rows = rows.withColumn("ball", F.lit(None).cast("binary"))
        return written(_by_owner(rows).mapInArrow(_merge(base, "ball"), "node long, ball binary"), "balls")

    def _near(self, roots: DataFrame, depth: int) -> tuple[DataFrame, int]:
        """((owner, node, distance, ball) that together make up what is within depth of each root, base of the balls).

        Half of the levels are walked from the roots, a row for each node met; what lies beyond is merged once for
        each node on the border and comes to the roots as packed lists. Pairs of a root and a node are thus never
        shuffled one by one where they are most.
        """
        half = depth // 2
        near, border = self._down(roots, half)
        rows = near.select(F.col("root").alias("owner"), "node", "distance")
        if border is None or depth == half:
            return rows.withColumn("ball", F.lit(None).cast("binary")), depth + 1
        balls = self._balls(border.select("node"), depth - half, depth + 1)
        inner = rows.where(F.col("distance") < half).withColumn("ball", F.lit(None).cast("binary"))
        return inner.unionByName(rows.where(F.col("distance") == half).join(balls, "node", "left").select(*inner.columns)), depth + 1

    def reach(self, roots: DataFrame, depth: int) -> DataFrame:
        """(root, node, distance) in numbers, from (root, id). A root's neighbourhood is put together in one task."""
        rows, base = self._near(roots, depth)
        return _by_owner(rows).mapInArrow(_merge(base, "rows"), "root long, node long, distance int")

    def counts(self, roots: DataFrame, depth: int) -> DataFrame:
        """(id, reachable)"""
        rows, base = self._near(roots, depth)
        return _by_owner(rows).mapInArrow(_merge(base, "count"), "id long, reachable long")


def _by_owner(rows: DataFrame) -> DataFrame:
    return rows.select("owner", "node", "distance", "ball").repartition("owner").sortWithinPartitions("owner")


def _packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, number of bytes of each) of numbers from 0: seven bits a byte, the lowest first, a set top bit goes on."""
    size = np.ones(len(values), np.int64)
    for b in range(1, 10):
        size += values >> np.int64(7 * b) > 0
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for b in range(int(size.max(initial=0))):
        at = np.flatnonzero(size > b)
        out[start[at] + b] = (values[at] >> np.int64(7 * b)) & 127 | np.where(size[at] > b + 1, 128, 0)
    return out, size


def _unpacked(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, place of the last byte of each)"""
    last = np.flatnonzero(data < 128)
    if not len(last):
        return np.zeros(0, np.int64), last
    first = np.concatenate([[0], last[:-1] + 1])
    shift = 7 * (np.arange(len(data)) - np.repeat(first, last - first + 1))
    return np.add.reduceat((data & 127).astype(np.int64) << shift, first), last


def _merge(base: int, kind: str):
    """Rows (owner, node, distance, ball) that come owner by owner -> what is near each owner, each node once and at its
    least distance: as rows, as its ball with the owner at 0, or counted.

    A ball is the ascending numbers node * base + distance, their differences packed. A row without one stands for its
    node alone.
    """

    def merged(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        owner, node, distance = (rows.column(i).to_numpy().astype(np.int64) for i in range(3))
        balls = rows.column(3).combine_chunks() if rows.column(3).num_chunks != 1 else rows.column(3).chunk(0)
        begins = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        group = np.cumsum(np.concatenate([[0], (owner[1:] != owner[:-1]).astype(np.int64)]))
        own = owner[begins]
        alone = balls.is_null().to_numpy(zero_copy_only=False)
        full = np.flatnonzero(~alone)
        lists = balls.drop_null()
        sizes = pa.compute.binary_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        numbers, last = _unpacked(np.frombuffer(b"".join(lists.to_pylist()), np.uint8))
        # of each list, the numbers that end within it
        counts = np.diff(np.searchsorted(last, np.concatenate([[0], np.cumsum(sizes)])))
        row = np.repeat(full, counts)
        total = np.cumsum(numbers)
        before = np.concatenate([[0], total])[np.cumsum(counts) - counts]
        keys = total - np.repeat(before, counts) + distance[row]
        parts = [(group[alone], node[alone] * base + distance[alone]), (group[row], keys)]
        if kind == "ball":
            parts.append((np.arange(len(own)), own * base))
        g, k = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((k, g))
        g, k = g[order], k[order]
        ids = k // base
        keep = np.concatenate([[True], (g[1:] != g[:-1]) | (ids[1:] != ids[:-1])])
        g, k, ids = g[keep], k[keep], ids[keep]
        if kind == "rows":
            yield from pa.table([pa.array(own[g]), pa.array(ids), pa.array((k % base).astype(np.int32))], names=["root", "node", "distance"]).to_batches(100_000)
        elif kind == "count":
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.bincount(g, minlength=len(own)).astype(np.int64))], names=["id", "reachable"])
        else:
            new = np.concatenate([[True], g[1:] != g[:-1]])
            data, size = _packed(np.where(new, k, k - np.concatenate([[0], k[:-1]])))
            ends = np.concatenate([[0], np.cumsum(np.bincount(g, weights=size, minlength=len(own)).astype(np.int64))])
            packed = pa.Array.from_buffers(pa.large_binary(), len(own), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(own), packed.cast(pa.binary())], names=["node", "ball"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            owner = b.column(0).to_numpy()
            # the last owner's rows may go on in the next batch
            cut = int(np.searchsorted(owner == owner[-1], True))
            if waiting and waiting[-1].column(0)[-1].as_py() != owner[0] or cut:
                yield from merged(pa.Table.from_batches([*waiting, b.slice(0, cut)]))
                waiting = []
            waiting.append(b.slice(cut))
        if waiting:
            yield from merged(pa.Table.from_batches(waiting))

    return run


_graphs: weakref.WeakKeyDictionary[DataFrame, Graph] = weakref.WeakKeyDictionary()


def graph_of(edges: DataFrame) -> Graph:
    """The numbered graph of a frame of edges, made when it is first asked for."""
    if edges not in _graphs or not _graphs[edges].alive:
        _graphs[edges] = Graph(edges)
    return _graphs[edges]


def reach(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(root, node, distance) of all nodes within depth of each root, the root included at 0."""
    g = graph_of(edges)
    known, lonely = g.roots(roots)
    near = g.reach(known, depth).withColumnRenamed("root", "root_id").withColumnRenamed("node", "id")
    named = near.join(_small(g.nodes), "id").drop("id").join(_small(known.withColumnRenamed("id", "root_id")), "root_id").select("root", "node", "distance")
    return named.unionByName(lonely.select("root", F.col("root").alias("node"), F.lit(0).alias("distance")))


def reach_counts(edges: DataFrame, roots: DataFrame, depth: int = 5) -> DataFrame:
    """(root, reachable), the root counted."""
    g = graph_of(edges)
    known, lonely = g.roots(roots)
    return g.counts(known, depth).join(known, "id").select("root", "reachable").unionByName(lonely.withColumn("reachable", F.lit(1).cast("long")))


def paths(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(root, path, steps, level, ends) of all paths of 1 to depth steps without a repeated node.

    steps are the edges' ordinals; ends is ``cycle`` where an edge leads back to the path (its node closes the
    path), ``depth`` at the last level where edges go on, else null. Their number grows exponentially with depth, so
    none are written or shuffled but those that a next level starts from: whether edges go on is told by the steps,
    which all levels read from one exchange.
    """
    more = edges.select(F.col("caller").alias("callee")).distinct().withColumn("goes_on", F.lit(True))
    step = edges.select("caller", "callee", "edge_ord").join(more, "callee", "left")
    walk = roots.select(F.col(roots.columns[0]).alias("root")).distinct().select("root", F.array("root").alias("path"), F.array().cast(f"array<{edges.schema['edge_ord'].dataType.simpleString()}>").alias("steps"), F.lit(False).alias("closed"), F.lit(True).alias("goes_on"))
    out = None
    for level in range(1, depth + 1):
        last = walk.where("NOT closed AND goes_on").select("root", "path", "steps", F.element_at("path", -1).alias("caller"))
        walk = last.join(step, "caller").select("root", F.concat("path", F.array("callee")).alias("path"), F.concat("steps", F.array("edge_ord")).alias("steps"), F.array_contains("path", F.col("callee")).alias("closed"), "goes_on")
        out = walk.withColumn("level", F.lit(level)) if out is None else out.unionByName(walk.withColumn("level", F.lit(level)))
    # by the path's length, not the level: a constant would leave levels that don't need goes_on without it, and so with an exchange of their own
    return out.select("root", "path", "steps", "level", F.when(F.col("closed"), "cycle").when((F.size("path") > depth) & F.col("goes_on"), "depth").alias("ends"))


def dfs(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(root, seq, edge_ord, caller, callee) in the order of a depth-first walk with one set of visited nodes.

    The walk expands a node once, with the depth that is left where it first enters it, so it may see less than the
    breadth-first set does. A root's neighbourhood within depth goes to one task, as numbers: a row for each node
    with its edges in order. That much of a hub must fit in one worker's memory; nothing else is gathered.
    """
    g = graph_of(edges)
    known, _ = g.roots(roots)
    near = g.reach(known, max(0, depth - 1)).select("root", F.col("node").alias("caller"))
    # edges get numbers in their order within a caller's list
    lists = g.known.join(near.select(F.col("caller").alias("caller_id")).distinct(), "caller_id", "left_semi").groupBy(F.col("caller_id").alias("caller")).agg(F.array_sort(F.collect_list(F.struct("edge_ord", "edge", F.col("callee_id").alias("to")))).alias("x"))
    lists = lists.select("caller", F.transform("x", lambda x: x["edge"]).alias("edges"), F.transform("x", lambda x: x["to"]).alias("to"))
    sub = near.join(lists, "caller").select("root", "caller", "edges", "to").repartition("root").sortWithinPartitions("root")
    walked = sub.mapInArrow(_walks(depth), "root long, seq int, edge long")
    named = walked.join(g.known.select("edge", "edge_ord", "caller", "callee"), "edge").withColumnRenamed("root", "id")
    return named.join(known, "id").select("root", "seq", "edge_ord", "caller", "callee")


def dfs_expanded(edges: DataFrame, roots: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """((root, caller, n_callees), (root, id)) in numbers: the nodes that the walk of ``dfs`` expands, and how many
    nodes all their edges lead to.

    An expanded node contributes all its edges, so what is summed over a walk's edges can be summed for each node once,
    and no row for each edge of each root is made.
    """
    g = graph_of(edges)
    known, _ = g.roots(roots)
    near = g.reach(known, max(0, depth - 1)).select("root", F.col("node").alias("caller"))
    lists = g.known.groupBy(F.col("caller_id").alias("caller")).agg(F.array_sort(F.collect_list(F.struct("edge_ord", F.col("callee_id").alias("to")))).alias("x")).select("caller", F.transform("x", lambda x: x["to"]).alias("to"))
    sub = near.join(lists, "caller").select("root", "caller", "to").repartition("root").sortWithinPartitions("root")
    return sub.mapInArrow(_expansions(depth), "root long, caller long, n_callees long"), known


def _expansions(depth: int):
    """Rows (root, caller, to) that come root by root -> (root, caller, n_callees)."""

    def expanded(root: int, to: dict[int, list[int]]) -> tuple[list[int], int]:
        if depth <= 0 or root not in to:
            return [], 0
        seen, order, met = {root}, [root], set(to[root])
        stack = [iter(to[root])]
        while stack:
            at = next(stack[-1], None) if len(stack) < depth else None
            if at is None:
                stack.pop()
            elif at not in seen:
                seen.add(at)
                if at in to:
                    order.append(at)
                    met.update(to[at])
                    stack.append(iter(to[at]))
        return order, len(met)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, to = None, {}
        done: tuple[list, list, list] = ([], [], [])

        def close() -> None:
            order, n = expanded(root, to)
            for column, values in zip(done, ([root] * len(order), order, [n] * len(order))):
                column.extend(values)

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in done], names=["root", "caller", "n_callees"])
            for c in done:
                c.clear()
            return out

        for b in batches:
            for r, caller, t in zip(*(c.to_pylist() for c in b.columns)):
                if r != root:
                    if root is not None:
                        close()
                    root, to = r, {}
                to[caller] = t
            yield batch()
        if root is not None:
            close()
        yield batch()

    return run


def _walk(root: int, edges: dict[int, list[int]], to: dict[int, list[int]], depth: int) -> list[int]:
    """The edges' numbers in the order of the walk."""
    order: list[int] = []
    if depth <= 0:
        return order
    seen = {root}
    stack = [iter(zip(edges.get(root, ()), to.get(root, ())))]
    while stack:
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            continue
        order.append(step[0])
        at = step[1]
        if len(stack) < depth and at not in seen:
            seen.add(at)
            if at in edges:
                stack.append(iter(zip(edges[at], to[at])))
    return order


def _walks(depth: int):
    """Rows (root, caller, edges, to) that come root by root -> (root, seq, edge)."""
    names = ["root", "seq", "edge"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, edges, to, done = None, {}, {}, []
        waiting = 0

        def batch() -> pa.RecordBatch:
            sizes = [len(o) for _, o in done]
            out = [np.repeat([r for r, _ in done], sizes).astype(np.int64), np.concatenate([np.arange(n, dtype=np.int32) for n in sizes] or [np.zeros(0, np.int32)]), np.fromiter((x for _, o in done for x in o), np.int64, sum(sizes))]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=names)

        for b in batches:
            for r, caller, e, t in zip(*(c.to_pylist() for c in b.columns)):
                if r != root:
                    if root is not None:
                        done.append((root, _walk(root, edges, to, depth)))
                        waiting += len(done[-1][1])
                    root, edges, to = r, {}, {}
                edges[caller], to[caller] = e, t
                if waiting > 50_000:
                    yield batch()
                    waiting = 0
        if root is not None:
            done.append((root, _walk(root, edges, to, depth)))
        yield batch()

    return run


def trace(nodes: DataFrame, edges: DataFrame, root: str, depth: int = 5) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the depth-first trace of one root.

    Nodes are the registered ends of its edges and the root, with has_callees (any edge leaves it) and expandable
    (a registered callee isn't among its traced targets).
    """
    spark = edges.sparkSession
    start = spark.createDataFrame([(root,)], "root string")
    near = neighbourhood(edges, start, depth)
    walked = written(dfs(near, start, depth), "trace")
    seen = walked.select(F.col("callee").alias("qualified_name")).unionByName(walked.select(F.col("caller").alias("qualified_name"))).unionByName(start.select(F.col("root").alias("qualified_name"))).distinct()
    mine = nodes.join(_small(seen), "qualified_name", "left_semi")
    full = _small(walked.select("seq", "edge_ord", "caller", "callee")).join(near, ["edge_ord", "caller", "callee"])
    return flags(mine, nodes, edges, walked), full


#: A frontier of up to so many names is broadcast, so that the edges are read and not shuffled.
BROADCAST = 1_000_000


def _small(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.limit(BROADCAST + 1).count() <= BROADCAST else rows


def neighbourhood(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """The edges within depth steps of any root, written: one pass over the edges a level, none of them is numbered.

    A level's edges leave the names that the level before met first.
    """
    levels, met = Levels("near"), Levels("met")
    last = met.add(roots.select(F.col(roots.columns[0]).alias("caller")).where("caller IS NOT NULL").distinct())
    for level in range(depth):
        found = levels.add(edges.join(_small(last), "caller", "left_semi").select(*edges.columns))
        if level == depth - 1:
            break
        last = met.add(found.select(F.col("callee").alias("caller")).where("caller IS NOT NULL").distinct().join(met.table(), "caller", "left_anti"))
        if last.isEmpty():
            break
    return levels.table() if levels.parts else edges.limit(0)


def flags(mine: DataFrame, nodes: DataFrame, edges: DataFrame, walked: DataFrame) -> DataFrame:
    """mine with has_callees and expandable. Only edges that leave mine are compared."""
    mine = written(mine, "traced")
    out = written(edges.join(_small(mine.select(F.col("qualified_name").alias("caller")).distinct()), "caller", "left_semi").select("caller", "callee").distinct(), "leaving")
    has = out.select(F.col("caller").alias("qualified_name")).distinct().withColumn("has_callees", F.lit(True))
    known = nodes.select(F.col("qualified_name").alias("callee")).join(_small(out.select("callee").distinct()), "callee", "left_semi")
    hidden = (
        out.join(known, "callee", "left_semi").join(walked.select("caller", "callee").distinct(), ["caller", "callee"], "left_anti")
        .select(F.col("caller").alias("qualified_name")).distinct().withColumn("expandable", F.lit(True))
    )
    return mine.join(has, "qualified_name", "left").join(hidden, "qualified_name", "left").fillna(False, ["has_callees", "expandable"])


def trace_metadata(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: total_nodes, total_files, total_edges, async_boundaries."""
    n = nodes.agg(F.count("*").alias("total_nodes"), F.count_distinct("file_path").alias("total_files"))
    e = edges.agg(F.count("*").alias("total_edges"), F.count_if("is_async_dispatch").alias("async_boundaries"))
    return n.crossJoin(e)


def node_degree(edges: DataFrame, root: str | Column | None = None, most: int | None = None) -> DataFrame:
    """(node, degree) by edges at either end. With ``most``, that many of them, the root first, then most edges
    first; without it all, in no order."""
    ends = edges.select(F.col("caller").alias("node")).unionAll(edges.select(F.col("callee").alias("node")))
    ranked = ends.groupBy("node").agg(F.count("*").alias("degree"))
    order = ([F.col("node") != root] if root is not None else []) + [F.desc("degree"), F.col("node")]
    return ranked.orderBy(*order).limit(most) if most else ranked


def branch_callee(edges: DataFrame) -> DataFrame:
    """(caller, name, callee): what a call's name in a function resolves to first."""
    return edges.groupBy("caller", "name").agg(F.min_by("callee", "edge_ord").alias("callee"))


def name_rank(nodes: DataFrame, query: str, name_col: str = "qualified_name") -> DataFrame:
    """nodes with rank 0 for the name itself, 1 for names that end in .query, 2 for names that hold it."""
    n = F.col(name_col)
    rank = F.when(n == query, 0).when(n.endswith("." + query), 1).when(n.contains(query), 2)
    return nodes.withColumn("rank", rank).where("rank IS NOT NULL")


def find(nodes: DataFrame, query: str) -> str | None:
    """The best name for a query: least rank, then registry order."""
    best = name_rank(nodes, query).orderBy("rank", "reg_ord").select("qualified_name").head(1)
    return best[0][0] if best else None


def search(nodes: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """The first nodes, in registry order, whose qualified name holds the query in any case."""
    return nodes.where(F.lower("qualified_name").contains(query.lower())).orderBy("reg_ord").limit(limit)
