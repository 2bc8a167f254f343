from __future__ import annotations

import random

import pytest

from codeloom.operators import graph, group, index


def random_edges(seed, nodes=25, n=60):
    rng = random.Random(seed)
    return [(i, f"n{rng.randrange(nodes)}", f"n{rng.randrange(nodes)}") for i in range(n)]


def table(spark, edges):
    return spark.createDataFrame(edges, "edge_ord int, caller string, callee string")


def roots(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "root string")


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("depth", [0, 1, 3, 6])
def test_reach(spark, seed, depth):
    edges = random_edges(seed)
    want = set()
    for root in ("n0", "n1", "nowhere"):
        seen, level = {root: 0}, [root]
        for d in range(1, depth + 1):
            level = sorted({b for _, a, b in edges if a in level} - set(seen))
            seen |= dict.fromkeys(level, d)
        want |= {(root, n, d) for n, d in seen.items()}
    assert {tuple(r) for r in graph.reach(table(spark, edges), roots(spark, "n0", "n1", "nowhere"), depth).collect()} == want


def test_reach_writes_no_row_for_each_pair(spark, monkeypatch):
    """Roots that meet a hub: what lies behind it is put together once and comes to them as one list."""
    edges = [(i, f"r{i}", "hub") for i in range(20)] + [(20 + i, "hub", f"x{i}") for i in range(30)] + [(50 + i, f"x{i}", f"y{i % 3}") for i in range(30)]
    rows = []
    add = graph.Levels.add
    monkeypatch.setattr(graph.Levels, "add", lambda self, level: rows.append(level.count()) or add(self, level))
    got = graph.reach_counts(table(spark, edges), roots(spark, *(f"r{i}" for i in range(20))), 3)
    assert {r["reachable"] for r in got.collect()} == {1 + 1 + 30 + 3} and sum(rows) <= 40


@pytest.mark.parametrize("n", [1, 2, 3, 100])
def test_merging_over_batches(n):
    """Owners whose rows are cut by batches; a node counts once, at its least distance."""
    import pyarrow as pa

    rows = [(1, 5, 1, None), (1, 5, 2, None), (1, 2**40, 1, None), (2, 1, 1, None), (3, 3, 0, None), (3, 4, 1, None)]

    def batches(rows):
        for i in range(0, len(rows), n):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + n]), (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["owner", "node", "distance", "ball"])

    balls = {o: b for t in graph._merge(4, "ball")(batches(rows)) for o, b in zip(*(c.to_pylist() for c in t.columns))}
    again = [(7, 1, 1, balls[1]), (7, 9, 1, balls[3])]
    got = [r for t in graph._merge(4, "rows")(batches(again)) for r in zip(*(c.to_pylist() for c in t.columns))]
    assert got == [(7, 1, 1), (7, 3, 1), (7, 4, 2), (7, 5, 2), (7, 2**40, 2)]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("depth", [0, 1, 2, 5])
def test_depth_first_walk(spark, seed, depth):
    edges = random_edges(seed, 12, 40)
    want = []

    def walk(node, left, seen):
        if left <= 0 or node in seen:
            return
        seen.add(node)
        for i, a, b in edges:
            if a == node:
                want.append((i, a, b))
                walk(b, left - 1, seen)

    walk("n0", depth, set())
    got = graph.dfs(table(spark, edges), roots(spark, "n0"), depth).orderBy("seq").collect()
    assert [tuple(r)[2:] for r in got] == want


def test_expanded_nodes_tell_the_walk(spark):
    """With cycles: the edges of the nodes it expands are the walk's edges."""
    edges = table(spark, random_edges(2, 12, 40))
    starts = roots(spark, "n0", "n1", "n2")
    want = {}
    for r in graph.dfs(edges, starts, 3).collect():
        want.setdefault(r["root"], []).append((r["edge_ord"], r["callee"]))
    nodes, known = graph.dfs_expanded(edges, starts, 3)
    g = graph.graph_of(edges)
    got, n = {}, {}
    for r in nodes.withColumnRenamed("root", "id").join(known, "id").join(g.known.drop("caller"), nodes.caller == g.known.caller_id).collect():
        got.setdefault(r["root"], []).append((r["edge_ord"], r["callee"]))
        n[r["root"]] = r["n_callees"]
    assert {k: sorted(x) for k, x in got.items()} == {k: sorted(x) for k, x in want.items()}
    assert n == {k: len({c for _, c in x}) for k, x in want.items()}


def test_paths(spark):
    edges = [(0, "a", "b"), (1, "b", "c"), (2, "c", "a"), (3, "a", "c"), (4, "c", "d")]
    got = {(tuple(r["path"]), tuple(r["steps"]), r["ends"]) for r in graph.paths(table(spark, edges), roots(spark, "a"), 3).collect()}
    assert got == {(("a", "b"), (0,), None), (("a", "c"), (3,), None), (("a", "b", "c"), (0, 1), None), (("a", "c", "a"), (3, 2), "cycle"), (("a", "c", "d"), (3, 4), None), (("a", "b", "c", "a"), (0, 1, 2), "cycle"), (("a", "b", "c", "d"), (0, 1, 4), None)}


def test_paths_write_no_tables(spark):
    """Their number grows with each level; written, they filled the disk."""
    from codeloom import storage

    before = set(storage._live)
    out = graph.paths(table(spark, random_edges(1)), roots(spark, "n0", "n1"), 3)
    assert out.count() > 3 and set(storage._live) == before


@pytest.mark.parametrize("small", [0, 1000])
def test_trace_numbers_its_neighbourhood_only(spark, monkeypatch, small):
    """Of a graph in which most edges are out of the root's reach, with frontiers broadcast or shuffled."""
    monkeypatch.setattr(graph, "BROADCAST", small)
    edges = table(spark, [(0, "a", "b"), (1, "b", "c"), (2, "c", "a"), (3, "c", "d"), (4, "d", "e"), *((i, f"x{i}", f"x{i + 1}") for i in range(5, 60))])
    nodes = spark.createDataFrame([(x,) for x in "abcde"], "qualified_name string")
    numbered = []
    of = graph.graph_of
    monkeypatch.setattr(graph, "graph_of", lambda e: numbered.append(e.count()) or of(e))
    mine, full = graph.trace(nodes, edges, "a", 3)
    assert max(numbered) == 4
    assert [r["edge_ord"] for r in full.orderBy("seq").collect()] == [0, 1, 2, 3]
    assert {tuple(r) for r in mine.collect()} == {("a", True, False), ("b", True, False), ("c", True, False), ("d", True, True)}


@pytest.mark.parametrize("seed", range(4))
def test_inheritance_order(spark, seed):
    rng = random.Random(seed)
    bases = sorted({(f"C{rng.randrange(9)}", k % 3, f"C{rng.randrange(9)}") for k in range(14)})
    bases = list({(c, o): (c, o, b) for c, o, b in bases}.values())
    by_class: dict[str, list[str]] = {}
    for c, o, b in sorted(bases):
        by_class.setdefault(c, []).append(b)
    for c in by_class:
        seen, queue, order = set(), list(by_class[c]), []
        while queue:
            x = queue.pop(0)
            if x not in seen:
                seen.add(x)
                order.append(x)
                queue += by_class.get(x, [])
        got = index.mro(spark.createDataFrame(bases, "class string, base_ord int, base string")).where(f"class = '{c}'").orderBy("level", "path").collect()
        assert [r["ancestor"] for r in got] == order


def test_find_and_search(spark):
    nodes = spark.createDataFrame([("x.Run", 0), ("a.run", 1), ("b.run", 2), ("run", 3), ("a.running", 4), ("a_run", 5)], "qualified_name string, reg_ord int")
    assert [graph.find(nodes, q) for q in ("run", "b.run", "nning", "unn", "zzz")] == ["run", "b.run", "a.running", "a.running", None]
    assert [r[0] for r in graph.search(nodes, "RUN", 4).collect()] == ["x.Run", "a.run", "b.run", "run"]
    assert graph.find(nodes.where("reg_ord <> 3"), "run") == "a.run"


def ids(spark, *names):
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "id string, ord int")


def test_common_prefix_thresholds(spark):
    prefix = lambda *n: [r["part"] for r in group.common_prefix(ids(spark, *n)).orderBy("pos").collect()]
    assert prefix(*["a.b.x"] * 7, *["c.b.x"] * 3) == ["a", "b", "x"]
    assert prefix(*["a.b.x"] * 6, *["c.b.x"] * 4) == []
    assert prefix("a.b.c", "a.b.d", "a") == ["a"]
    second = lambda *n: group.prefix_length(ids(spark, *n)).first()[0]
    assert second(*["a.b.x"] * 6, *["a.c.x"] * 4) == 2
    assert second(*["a.b.x"] * 5, *["a.c.x"] * 5) == 1


def test_domains(spark):
    names = ["p.api.views.orders.f", "p.billing.g", "p.api.views", "p", "p.users.tasks.h"]
    got = {r["id"]: r["group"] for r in group.domain_groups(ids(spark, *names), second=2.0).collect()}
    assert got == {"p.api.views.orders.f": "orders", "p.billing.g": "billing", "p.api.views": "api", "p": "p", "p.users.tasks.h": "users"}


def test_group_stats(spark):
    grouped = spark.createDataFrame([("a", 0, "t", "x", "g"), ("b", 1, "u", "y", "g"), ("c", 2, "t", "z", "g"), ("d", 3, "t", "w", "g"), ("e", 4, "t", "v", "h")], "id string, ord int, type string, trigger string, group string")
    rows = {r["group"]: r for r in group.group_stats(grouped, table(spark, [(0, "b", "m"), (1, "m", "n"), (2, "c", "k"), (3, "k", "l")])).collect()}
    g = rows["g"]
    assert (g["count"], g["types"], g["triggers"], g["deepest_name"], g["deepest_reachable"]) == (4, {"t": 3, "u": 1}, ["x", "y", "z"], "b", 3)
    assert rows["h"]["deepest_reachable"] == 1


def test_group_stats_reads_reach_once(spark):
    """Its three aggregates read a table of one row for each entry, and don't search the graph three times."""
    grouped = spark.createDataFrame([("a", 0, "t", "x", "g"), ("b", 1, "u", "y", "g")], "id string, ord int, type string, trigger string, group string")
    files = group.group_stats(grouped, table(spark, [(0, "a", "b"), (1, "b", "c")])).inputFiles()
    assert files and all("/reached-" in f for f in files)


def test_no_edges(spark):
    none = table(spark, [])
    assert graph.dfs(none, roots(spark, "a"), 3).count() == 0
    assert graph.reach_counts(none, roots(spark, "a")).first()["reachable"] == 1
    assert graph.paths(none, roots(spark, "a"), 2).count() == 0
