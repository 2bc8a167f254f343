from __future__ import annotations

import itertools

import numpy as np
import pytest

from codeloom.llm import simhash as s

from .helpers import DOCS, documents, edited, prose, rows, vocabulary


def brute(texts, max_distance=s.MAX_DISTANCE):
    """(doc_id, kept) by comparing all pairs of signatures and joining groups one by one."""
    sigs = [(i, np.frombuffer(x, np.uint8)) for i, t in texts if i is not None for _, x in s.text_signatures([t])]
    leader = {i: i for i, _ in sigs}

    def top(i):
        while leader[i] != i:
            i = leader[i]
        return i

    for (i, a), (j, b) in itertools.combinations(sigs, 2):
        if np.unpackbits(a ^ b).sum() <= max_distance and top(i) != top(j):
            x, y = sorted((top(i), top(j)))
            leader[y] = x
    return sorted({(i, top(i)) for i in leader if top(i) != i})


@pytest.fixture(scope="module")
def texts():
    words = vocabulary(6)
    out = [prose(i, 40 + 7 * (i % 30), words) for i in range(60)]
    out += [out[i] for i in (1, 1, 5)] + [edited(out[i], 1000 + k) for i in (2, 3, 4, 30, 31) for k in range(5)]
    chain = out[40]
    for k in range(8):
        chain = edited(chain, 50 + k)
        out.append(chain)
    return [*out, None, "", " \n", "...", "...", "!!", "word", prose(5, 100).upper(), prose(5, 100), prose(9, 300_000, words)]


@pytest.mark.parametrize("max_distance", [1, 5, 9, 14, 31])
def test_groups_agree_with_all_pairs(spark, texts, max_distance):
    docs = documents(spark, texts)
    assert rows(s.near_duplicates(docs, max_distance)) == sorted(brute(enumerate(texts, 1), max_distance), key=repr)


@pytest.mark.parametrize("max_distance", [1, 2, 4, 9, 15])
def test_pairs_of_signatures_are_all_found(spark, max_distance):
    rng = np.random.default_rng(max_distance)
    base = rng.integers(0, 2, (40, s.BITS), dtype=np.uint8)
    near = base[rng.integers(0, 40, 160)].copy()
    for row in near:
        row[rng.choice(s.BITS, rng.integers(0, max_distance + 3), replace=False)] ^= 1
    bits = np.unique(np.concatenate([base, near]), axis=0)
    both = np.packbits(bits, axis=1).view(">i8").astype(np.int64)
    got = s.pairs(spark.createDataFrame([tuple(map(int, r)) for r in both], "hi long, lo long"), max_distance).collect()
    want = {tuple(sorted((tuple(both[i]), tuple(both[j])))): int((bits[i] ^ bits[j]).sum()) for i, j in itertools.combinations(range(len(bits)), 2) if (bits[i] ^ bits[j]).sum() <= max_distance}
    assert len(got) == len(want) and want
    assert {tuple(sorted(((r[0], r[1]), (r[2], r[3])))): r[4] for r in got} == want


def test_near_copies_are_caught_and_others_left_alone():
    words = vocabulary(8, 900)
    own = [prose(3000 + i, 120 + i % 200, words) for i in range(300)]
    copies = [edited(t, i, 0.03) for i, t in enumerate(own)]
    bits = lambda ts: np.array([np.unpackbits(np.frombuffer(x, np.uint8)) for _, x in s.text_signatures(ts)])
    a, b = bits(own), bits(copies)
    assert ((a ^ b).sum(1) <= s.MAX_DISTANCE).mean() >= 0.9
    apart = np.abs(a[:, None, :].astype(int) - a[None]).sum(2)[np.triu_indices(len(a), 1)]
    assert apart.min() > s.MAX_DISTANCE


def test_long_texts_have_the_signature_of_all_their_words():
    words = vocabulary(5)
    text = prose(1, 260_000, words)
    assert len(text) > 1_000_000
    seen = " ".join(sorted(set(text.split())))
    assert next(s.text_signatures([text]))[1] == next(s.text_signatures([seen]))[1]


def test_one_of_each_group_stays(spark, texts):
    docs = documents(spark, texts)
    gone = {i for i, _ in brute(enumerate(texts, 1))}
    assert [r[0] for r in rows(s.without_duplicates(docs), "doc_id")] == sorted(set(range(1, len(texts) + 1)) - gone, key=lambda i: repr((i,)))


def test_both_ways_to_remove_agree(spark, texts, monkeypatch):
    docs = documents(spark, texts)
    by_broadcast = rows(s.without_duplicates(docs))
    monkeypatch.setattr(s, "BROADCAST_ROWS", -1)
    assert rows(s.without_duplicates(docs)) == by_broadcast


def test_a_hot_group_of_near_copies(spark):
    base = prose(77, 400)
    docs = documents(spark, [edited(base, i, 0.0025) for i in range(400)] + [prose(78, 400)])
    assert rows(s.without_duplicates(docs), "doc_id") == [(1,), (401,)]


def test_nulls_repeated_rows_and_clashing_names(spark):
    t, u = prose(1, 80), prose(2, 80)
    data = [(None, t, "x"), (None, t, "x"), (3, t, "x"), (3, t, "x"), (5, t, "y"), (7, u, "z"), (7, None, "z"), (8, None, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, hi string").selectExpr("*", "'q' AS lo", "'q' AS node", "'q' AS label", "'q' AS rep", "'q' AS gone_doc_id")
    assert rows(s.near_duplicates(docs)) == [(5, 3)]
    assert rows(s.without_duplicates(docs), "doc_id", "text", "hi") == sorted([(None, t, "x"), (None, t, "x"), (3, t, "x"), (7, u, "z"), (7, None, "z"), (8, None, None)], key=repr)


def test_no_rows(spark):
    empty = spark.createDataFrame([], DOCS)
    assert s.near_duplicates(empty).count() == s.without_duplicates(empty).count() == 0


@pytest.mark.parametrize("max_distance", [0, 32])
def test_bad_distances(spark, max_distance):
    with pytest.raises(ValueError):
        s.pairs(spark.createDataFrame([], "hi long, lo long"), max_distance)


def test_components_of_a_long_chain(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, n)] + [(900, 901), (901, 900)], "u long, v long")
    assert {tuple(r) for r in s.components(edges).collect()} == {(i, 1) for i in range(1, n + 1)} | {(900, 900), (901, 900)}


def test_whole_query_agrees_with_brute_force(spark, sf_dir):
    from codeloom.llm.queries import op8_simhash

    texts = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert rows(op8_simhash(spark, sf_dir)) == sorted(brute(texts), key=repr)
