"""Exact top-k search by inner product: a ball tree in each shard, branch and bound, shared k-th scores.

Rows near the same pivot form a cell; a cell of many rows is cut across the line to its neighbour into shards of
about the same size. Each shard has a ball tree, built once and kept as a row of its table. Queries, a stated set
of rows or all of them, visit cells in waves, in the order of the upper bound q.centre + |q| * radius: the best one,
the next 4, the next 16 and so on. After each wave a query's k-th score is what later waves, their shards and the
trees' nodes are compared with; what can't reach it isn't visited. Within a tree, nodes are visited in the order of
the same bound.

How much is left out depends on the vectors: of independent directions in many dimensions no ball bound leaves out
anything, and the search costs what comparing all queries with all rows costs, in blocks.

Scores are rounded to DIGITS decimals; equal scores rank by id.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, written

K = 10
#: Rows of a shard, on average, and most bytes of its matrix.
SHARD_ROWS = 8192
SHARD_BYTES = 32 << 20
#: Bytes of all pivots together, which every task gets; more rows give larger cells, cut into more shards.
PIVOT_BYTES = 4 << 20
#: A cell's shards are ranges of one projection up to this number, and equal parts of these ranges beyond.
RANGES = 256
#: Queries that visit a shard in one task.
QUERY_ROWS = 16384
LEAF = 128
DIGITS = 9
_SLACK = 2e-9


class BallTree:
    """A tree of balls over the rows of a matrix. A node has a first row and an end, a centre, a radius and two children
    (-1: a leaf). ``at`` holds the rows' places in the matrix that was given."""

    def __init__(self, x: np.ndarray):
        self.at, self.x = np.arange(len(x)), x.copy()
        self.bounds, self.centres, self.radii, self.children = [], [], [], []
        if len(x):
            self._build(0, len(x))
        self.centres = np.array(self.centres).reshape(len(self.radii), -1)

    def _build(self, start: int, end: int) -> int:
        x = self.x[start:end]
        centre = x.mean(0)
        away = ((x - centre) ** 2).sum(1)
        node = len(self.radii)
        self.bounds.append((start, end))
        self.centres.append(centre)
        self.radii.append(float(np.sqrt(away.max())))
        self.children.append((-1, -1))
        if end - start > LEAF and away.max() > 0:
            far = x[away.argmax()]
            other = x[((x - far) ** 2).sum(1).argmax()]
            order = np.argsort(x @ (other - far), kind="stable")
            self.x[start:end], self.at[start:end] = x[order], self.at[start:end][order]
            middle = (start + end) // 2
            self.children[node] = self._build(start, middle), self._build(middle, end)
        return node

    @property
    def leaves(self) -> int:
        return sum(left < 0 for left, _ in self.children)

    def search(self, q: np.ndarray, own: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(scores, places, leaves visited): each query's k best rows with a score of ``least`` or more, best first,
        equal scores by place. ``own`` is the place of the query itself, which isn't an answer, or -1. Empty places
        hold -inf and len(x)."""
        scores, places = np.full((len(q), k), -np.inf), np.full((len(q), k), len(self.x))
        visits = np.zeros(len(q), np.int64)
        if self.children and len(q):
            state = q, np.sqrt((q * q).sum(1)), own, k, least.astype(float).copy(), scores, places, visits
            some = np.arange(len(q))
            self._visit(0, some[self._bound(0, some, q, state[1]) + _SLACK * (1 + state[1]) >= least], state)
        return scores, places, visits

    def _bound(self, node: int, some: np.ndarray, q: np.ndarray, norms: np.ndarray) -> np.ndarray:
        return q[some] @ self.centres[node] + norms[some] * self.radii[node]

    def _visit(self, node: int, some: np.ndarray, state: tuple) -> None:
        q, norms, _, k, least, *_ = state
        left, right = self.children[node]
        if left < 0:
            start, end = self.bounds[node]
            step = max(1, 4_000_000 // (end - start + k))
            for i in range(0, len(some), step):
                self._leaf(some[i : i + step], start, end, state)
            return
        bounds = self._bound(left, some, q, norms), self._bound(right, some, q, norms)
        first = bounds[0] >= bounds[1]
        for child, chosen, bound in ((left, first, bounds[0]), (right, first, bounds[1]), (right, ~first, bounds[1]), (left, ~first, bounds[0])):
            go = some[chosen]
            go = go[bound[chosen] + _SLACK * (1 + norms[go]) >= least[go]]
            if len(go):
                self._visit(child, go, state)

    def _leaf(self, some: np.ndarray, start: int, end: int, state: tuple) -> None:
        q, _, own, k, least, scores, places, visits = state
        visits[some] += 1
        new = np.round(q[some] @ self.x[start:end].T, DIGITS)
        at = self.at[start:end]
        new[(at == own[some][:, None]) | (new < least[some][:, None])] = -np.inf
        s, p = np.concatenate([scores[some], new], 1), np.concatenate([places[some], np.broadcast_to(at, new.shape)], 1)
        best = best_of(s, p, k)
        scores[some], places[some] = np.take_along_axis(s, best, 1), np.take_along_axis(p, best, 1)
        least[some] = np.maximum(least[some], scores[some][:, -1])


def best_of(scores: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's k best, equal scores by place."""
    order = np.argsort(places, 1, kind="stable")
    return np.take_along_axis(order, np.argsort(-np.take_along_axis(scores, order, 1), 1, kind="stable")[:, :k], 1)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.array(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): rows with an id and a vector of finite numbers, once each."""
    v = rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf'))")
    return v.groupBy("vec_id").agg(F.min("v").alias("v"))


class Shards:
    """The rows in cells and shards, with their trees: ``trees`` (shard, cell, centre, radius, n, leaves, tree), and
    the cells' ``pivots`` and ``radii``."""

    def __init__(self, clean: DataFrame, dim: int, n: int, shard_rows: int):
        self.rows = max(1, min(shard_rows, SHARD_BYTES // (8 * dim)))
        cells = max(1, min(-(-n // self.rows), PIVOT_BYTES // (8 * dim)))
        pivots = np.array([r["v"] for r in clean.orderBy(F.xxhash64("vec_id"), "vec_id").limit(cells).collect()], float)
        kind = clean.schema["vec_id"].dataType.simpleString()
        sent = clean.sparkSession.sparkContext.broadcast(pivots)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Nearest pivot, distance to it, and place on the line from it to the second nearest."""
            pivots = sent.value
            half = (pivots**2).sum(1) / 2
            for batch in batches:
                for start in range(0, batch.num_rows, 4096):
                    part = batch.slice(start, 4096)
                    x = _matrix(part.column(1))
                    near = x @ pivots.T - half
                    first = near.argmax(1)
                    near[np.arange(len(x)), first] = -np.inf
                    second = near.argmax(1)
                    away = np.sqrt(((x - pivots[first]) ** 2).sum(1))
                    side = (x * (pivots[second] - pivots[first])).sum(1) if len(pivots) > 1 else away
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(first.astype(np.int64)), pa.array(away), pa.array(side)], names=["vec_id", "v", "cell", "away", "side"])

        placed = written(clean.mapInArrow(assign, f"vec_id {kind}, v array<double>, cell long, away double, side double"), "cells")
        steps = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
        size = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius"), F.percentile_approx("side", steps, 2000).alias("steps"))
        wanted = F.ceil(F.col("n") / F.lit(self.rows))
        ranges = F.least(wanted, F.lit(RANGES).cast("long"))
        size = size.withColumn("parts", F.ceil(wanted / F.lit(RANGES))).withColumn("cuts", F.expr(f"transform(sequence(1, {RANGES} - 1), i -> struct(i, steps[i - 1] AS at))")).withColumn("ranges", ranges)
        # every RANGES / ranges-th of the quantiles
        size = written(size.select("cell", "n", "radius", "parts", F.expr(f"transform(filter(cuts, c -> floor(c.i * ranges / {RANGES}) > floor((c.i - 1) * ranges / {RANGES})), c -> c.at)").alias("cuts")), "cell-sizes")
        found = {r["cell"]: r["radius"] for r in size.select("cell", "radius").collect()}  # one row for each pivot at most
        self.pivots = pivots.reshape(-1, dim)
        self.radii = np.array([found.get(c, -1.0) for c in range(len(self.pivots))])
        low, high = F.size(F.filter("cuts", lambda c: c < F.col("side"))), F.size(F.filter("cuts", lambda c: c <= F.col("side")))
        h = F.xxhash64(F.lit(1), "vec_id")
        # rows that lie on several cuts are dealt out between them; a cell's row has at most RANGES numbers
        slab = low + F.pmod(h, high - low + 1)
        part = F.pmod(F.shiftright(h, 20), F.col("parts"))
        shard = F.shiftleft(F.col("cell"), 40) + F.shiftleft(slab.cast("long"), 32) + part
        dealt = placed.join(F.broadcast(size.select("cell", "parts", "cuts")), "cell").select("vec_id", "v", "cell", shard.alias("shard"))

        def build(table: pa.Table) -> pa.Table:
            table = table.combine_chunks().sort_by("vec_id")  # places are in the order of ids
            tree = BallTree(_matrix(table.column("v")))
            blob = pickle.dumps((table.column("vec_id").to_pylist(), tree), 5)
            return pa.table({"shard": table.column("shard")[:1], "cell": table.column("cell")[:1], "centre": _lists(tree.centres[:1]), "radius": [tree.radii[0]], "n": pa.array([len(tree.x)], pa.int64()), "leaves": pa.array([tree.leaves], pa.int64()), "tree": pa.array([blob], pa.binary())})

        self.trees = written(dealt.groupBy("shard").applyInArrow(build, "shard long, cell long, centre array<double>, radius double, n long, leaves long, tree binary"), "trees")
        discard(placed, size)


def _waves(cells: int) -> Iterator[tuple[int, int]]:
    start, width = 0, 1
    while start < cells:
        yield start, start + width
        start, width = start + width, 4 * width


def search(rows: DataFrame, queries: DataFrame | None = None, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(vec_id, best, shards, leaves, of_shards, of_leaves): for each query its k best (below, neighbour_id, score),
    how many shards and leaves it visited, and how many there are."""
    clean = written(vectors(rows, id_col, vector_col), "vectors")
    asked = clean if queries is None else written(vectors(queries, id_col, vector_col), "queries")
    kind = clean.schema["vec_id"].dataType.simpleString()
    lengths = clean.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if lengths is None:
        return asked.select("vec_id", F.expr(f"CAST(array() AS array<struct<below:double,neighbour_id:{kind},score:double>>)").alias("best"), *[F.lit(0).cast("long").alias(c) for c in ("shards", "leaves", "of_shards", "of_leaves")]).where("false")
    dim, n = lengths["dim"], lengths["count"]
    clean, asked = clean.where(F.size("v") == dim), asked.where(F.size("v") == dim)
    s = Shards(clean, dim, n, shard_rows)
    sent = clean.sparkSession.sparkContext.broadcast((s.pivots, s.radii))
    none = F.expr(f"CAST(array() AS array<struct<below:double,neighbour_id:{kind},score:double>>)")
    state = written(asked.select("vec_id", "v", none.alias("best"), F.lit(0).cast("long").alias("shards"), F.lit(0).cast("long").alias("leaves")), "search")
    balls = s.trees.select("shard", "cell", "centre", "radius")
    for first, end in _waves(len(s.pivots)):

        def cells(batches: Iterator[pa.RecordBatch], first: int = first, end: int = end) -> Iterator[pa.RecordBatch]:
            """The cells of this wave that may hold something as good as a query's k-th score."""
            pivots, radii = sent.value
            for batch in batches:
                for start in range(0, batch.num_rows, 1024):
                    part = batch.slice(start, 1024)
                    q, kth = _matrix(part.column(1)), part.column(2).to_numpy(zero_copy_only=False)
                    norms = np.sqrt((q * q).sum(1))[:, None]
                    bound = np.where(radii >= 0, q @ pivots.T + norms * np.maximum(radii, 0), -np.inf)
                    chosen = np.argsort(-bound, 1, kind="stable")[:, first:end]
                    ok = np.take_along_axis(bound, chosen, 1) + _SLACK * (1 + norms) >= kth[:, None]
                    ok &= np.take_along_axis(bound, chosen, 1) > -np.inf
                    at = np.nonzero(ok)[0]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), part.column(1).take(pa.array(at)), pa.array(kth[at]), pa.array(chosen[ok].astype(np.int64))], names=["vec_id", "v", "kth", "cell"])

        kth = F.coalesce(F.get("best", F.lit(k - 1))["score"], F.lit(float("-inf")))
        routes = state.select("vec_id", "v", kth.alias("kth")).mapInArrow(cells, f"vec_id {kind}, v array<double>, kth double, cell long")
        dot = F.aggregate(F.zip_with("v", "centre", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, b: a + b * b))
        routes = written(routes.join(balls, "cell").where(dot + norm * F.col("radius") + F.lit(_SLACK) * (1 + norm) >= F.col("kth")).select("vec_id", "v", "kth", "shard"), "routes")
        blocks = routes.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(QUERY_ROWS)).alias("blocks"))
        blocks = written(blocks, "blocks")
        if not blocks.limit(1).count():
            discard(routes, blocks)
            if first:
                break
            continue
        theirs = routes.join(blocks, "shard").selectExpr("vec_id", "v", "kth", "shard", "pmod(xxhash64(vec_id), blocks) AS block")
        held = s.trees.select("shard", "tree").join(blocks, "shard").selectExpr("shard", "tree", "explode(sequence(0L, blocks - 1)) AS block")

        def visit(mine: pa.Table, theirs: pa.Table) -> pa.Table:
            found = {"vec_id": [], "place": [], "score": []}
            visits = np.zeros(0, np.int64)
            asked = theirs.column("vec_id")
            ids: list = []
            if mine.num_rows and theirs.num_rows:
                ids, tree = pickle.loads(mine.column("tree")[0].as_py())
                place = {x: i for i, x in enumerate(ids)}
                own = np.array([place.get(x, -1) for x in asked.to_pylist()])
                scores, at, visits = tree.search(_matrix(theirs.column("v")), own, k, theirs.column("kth").to_numpy())
                row, col = np.nonzero(scores > -np.inf)
                found = {"vec_id": row, "place": at[row, col], "score": scores[row, col]}
            else:
                row = np.zeros(0, np.int64)
            names = pa.array(ids, asked.type).take(pa.array(np.asarray(found["place"], np.int64)))
            # an answer a row, and a row without one for each visit
            answers = pa.table({"vec_id": asked.take(pa.array(row)), "neighbour_id": names, "score": pa.array(np.asarray(found["score"], float)), "leaves": pa.nulls(len(row), pa.int64())})
            seen = pa.table({"vec_id": asked.slice(0, len(visits)), "neighbour_id": pa.nulls(len(visits), asked.type), "score": pa.nulls(len(visits), pa.float64()), "leaves": pa.array(visits)})
            return pa.concat_tables([answers, seen.cast(answers.schema)])

        got = held.groupBy("shard", "block").cogroup(theirs.groupBy("shard", "block")).applyInArrow(visit, f"vec_id {kind}, neighbour_id {kind}, score double, leaves long")
        new = got.groupBy("vec_id").agg(F.collect_list(F.when(F.col("score").isNotNull(), F.struct((-F.col("score")).alias("below"), "neighbour_id", "score"))).alias("more"), F.count("leaves").alias("n_shards"), F.sum("leaves").alias("n_leaves"))
        best = F.slice(F.sort_array(F.concat("best", F.coalesce("more", none))), 1, k)
        old, state = state, written(state.join(new, "vec_id", "left").select("vec_id", "v", best.alias("best"), (F.col("shards") + F.coalesce("n_shards", F.lit(0))).alias("shards"), (F.col("leaves") + F.coalesce("n_leaves", F.lit(0))).alias("leaves")), "search")
        discard(old, routes, blocks)
    total = s.trees.agg(F.count("*").alias("of_shards"), F.sum("leaves").alias("of_leaves")).first()
    return state.select("vec_id", "best", "shards", "leaves", F.lit(total["of_shards"]).alias("of_shards"), F.lit(total["of_leaves"]).alias("of_leaves"))


def top_k(rows: DataFrame, queries: DataFrame | None = None, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(vec_id, rank, neighbour_id, score): the k rows of largest inner product with each query, other than the one
    of the query's own id. queries has the same two columns; without it, every row is a query.

    Exact: equal to sorting all scores, rounded to DIGITS decimals, by score and then id. Fewer than k other
    rows give fewer ranks. Rows with a null id, a null, empty or not finite vector, or a vector of another
    length than most rows have, are neither queries nor answers. Rows that repeat an id count once, with the least of
    their vectors. Ids keep their type, which may be any that has an order. Other columns are not read; an empty table
    gives no rows.
    """
    ranked = search(rows, queries, k, id_col, vector_col, shard_rows)
    return ranked.select("vec_id", F.posexplode("best").alias("at", "x")).select("vec_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.neighbour_id").alias("neighbour_id"), F.col("x.score").alias("score"))


def oracle(k: int = K, table: str = "embeddings", every: int = 100) -> str:
    """DuckDB SQL: all scores of the queries, the rows whose id is divisible by ``every``, sorted."""
    return f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM {table}),
s AS (SELECT a.vec_id, b.vec_id AS neighbour_id, round(list_inner_product(a.v, b.v), {DIGITS}) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % {every} = 0)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, neighbour_id, score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, neighbour_id) AS rank FROM s) WHERE rank <= {k}"""
