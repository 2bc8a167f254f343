from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from codeloom.llm import mixing as m

from .helpers import DOCS, rows


def table(spark, sizes: dict, seed: int = 0):
    """sizes: source -> number of documents of 1 to 99 characters."""
    rng = np.random.default_rng(seed)
    data, i = [], 0
    for source, n in sizes.items():
        for size in rng.integers(1, 100, n).tolist():
            data.append((i, "x" * size, "en", source, size))
            i += 1
    return spark.createDataFrame(data, DOCS), data


def test_pivotal_keeps_sums_and_chances():
    p = np.array([0.2, 0.7, 0.5, 0.1, 0.9, 0.35, 0.25])
    total = np.zeros(len(p))
    for seed in range(4000):
        out, at = m.pivotal(p, np.random.default_rng(seed))
        assert out.sum() == pytest.approx(p.sum()) and at < 0
        assert set(np.round(out, 9)) <= {0.0, 1.0}
        total += out
    assert np.abs(total / 4000 - p).max() < 0.03


def test_pivotal_leaves_one_fraction_at_most():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 50):
        p = rng.random(n)
        out, at = m.pivotal(p, rng)
        rest = [i for i, x in enumerate(out) if 0 < x < 1]
        assert rest == ([at] if at >= 0 else []) and out.sum() == pytest.approx(p.sum())


@pytest.mark.parametrize("leaf", [m.LEAF, 7])
@pytest.mark.parametrize("weights", [None, {"a": 3.0, "b": 1.0, "c": 0.5}])
def test_sources_get_their_share(spark, monkeypatch, leaf, weights):
    monkeypatch.setattr(m, "LEAF", leaf)
    monkeypatch.setattr(m, "FAN", 3)
    docs, data = table(spark, {"a": 300, "b": 90, "c": 20, "d": 1})
    got = {r["doc_id"]: r for r in m.mixture(docs, weights).collect()}
    assert set(got) == {r[0] for r in data}
    chars = Counter()
    for _, _, _, source, n in data:
        chars[source] += n
    weight = weights or {s: n**m.POWER for s, n in chars.items()}
    budget, number = sum(chars.values()), Counter(r[3] for r in data)
    for source in chars:
        due = budget * weight.get(source, 0) / sum(weight.values()) / chars[source]
        copies = [r["copies"] for r in got.values() if r["source"] == source]
        assert set(copies) <= {int(due), int(due) + 1}
        assert abs(sum(copies) - due * number[source]) < 1


def test_chances_of_single_documents(spark):
    """Many sources of the same documents stand for as many draws."""
    chances = [0.15, 0.4, 0.75, 0.2, 0.9, 0.55, 0.33]
    runs = 300
    due = spark.createDataFrame([(i, f"s{k}", p, len(chances)) for k in range(runs) for i, p in enumerate(chances)], "doc_id long, source string, expected double, n long").selectExpr("*", "0L AS salt")
    total = Counter()
    for r in m.copies(due).collect():
        total[r["doc_id"]] += r["copies"]
    assert max(abs(total[i] / runs - p) for i, p in enumerate(chances)) < 0.1


def test_the_same_again_whatever_the_partitions(spark):
    docs, _ = table(spark, {"a": 200, "b": 50})
    assert rows(m.mixture(docs)) == rows(m.mixture(docs.repartition(7))) != rows(m.mixture(docs, seed=1))


def test_nulls_empty_texts_repeats_and_clashing_names(spark):
    data = [(1, "abc", "a"), (1, "abc", "a"), (None, "abcd", "a"), (2, None, "b"), (3, "", "b"), (4, "x" * 10, None), (5, None, None), (6, None, "empty")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").selectExpr("*", "'q' AS n", "'q' AS expected", "'q' AS size", "'q' AS leaf", "'q' AS `of`")
    got = m.mixture(docs).collect()
    assert sorted((repr(r["doc_id"]), repr(r["source"])) for r in got) == sorted((repr(i), repr(s)) for i, _, s in data)
    assert all(r["copies"] >= 0 for r in got)
    assert all(r["copies"] == 0 for r in got if r["source"] in ("b", "empty"))


def test_no_rows_and_bad_weights(spark):
    empty = spark.createDataFrame([], DOCS)
    assert m.mixture(empty).count() == m.mixture(empty, {"a": 1.0}).count() == 0
    with pytest.raises(ValueError):
        m.expected(empty, {"a": -1.0})


def test_whole_query(spark, sf_dir):
    from codeloom.llm.queries import op10_mixing

    docs = [r.asDict() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()]
    got = {r["doc_id"]: r["copies"] for r in op10_mixing(spark, sf_dir).collect()}
    assert set(got) == {d["doc_id"] for d in docs}
    chars, number, mine = Counter(), Counter(), Counter()
    for d in docs:
        chars[d["source"]] += len(d["text"])
        number[d["source"]] += 1
        mine[d["source"]] += got[d["doc_id"]]
    weights = {s: n**m.POWER for s, n in chars.items()}
    for s in chars:
        due = sum(chars.values()) * weights[s] / sum(weights.values()) / chars[s] * number[s]
        assert abs(mine[s] - due) < 1


def test_rows_without_ids_are_spread(spark, monkeypatch):
    """A source of rows with a null id, or with one id, isn't gathered in one leaf."""
    monkeypatch.setattr(m, "LEAF", 20)
    for i in ("CAST(NULL AS STRING)", "'same'"):
        docs = spark.range(800).selectExpr(f"{i} AS doc_id", "concat('text ', id) AS text", "'one' AS source")
        sizes = []
        due = m.expected(docs, epochs=0.5)
        leaves = due.selectExpr(f"pmod(xxhash64(0, doc_id, salt), greatest(1L, ceil(n / {m.LEAF}))) AS leaf").groupBy("leaf").count().collect()
        sizes = [r["count"] for r in leaves]
        assert max(sizes) < 60 and len(sizes) > 30
        got = m.mixture(docs, epochs=0.5).collect()
        assert len(got) == 800 and 380 <= sum(r["copies"] for r in got) <= 420
