from __future__ import annotations

import re

import pytest

from codeloom.llm import decontaminate as d

from .helpers import DOCS, documents, prose, rows, vocabulary

ITEMS = "item_id long, text string"


def brute(texts, items, n=d.N, max_share=d.MAX_SHARE):
    """Findings by sets of tuples of words."""
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    known: dict[tuple, int] = {}  # window -> least id
    for i, t in items:
        w = split(t)
        if i is not None and len(w) >= d.LEAST:
            size = min(n, len(w))
            for k in range(len(w) - size + 1):
                key = tuple(w[k : k + size])
                known[key] = min(i, known.get(key, i))
    sizes = {len(k) for k in known}
    out = {}
    for doc, t in texts:
        w, hit, covered, found = split(t), 0, set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                got = known.get(tuple(w[k : k + size]))
                if got is not None:
                    hit += 1
                    found.add(got)
                    covered |= set(range(k, k + size))
        if hit:
            out[doc] = (",".join(map(str, sorted(found))), hit, len(covered), len(w), "drop" if len(covered) > max_share * len(w) else "cut")
    return out


@pytest.fixture(autouse=True)
def small_bitmaps(monkeypatch):
    monkeypatch.setattr(d, "BITMAP_BITS", 18)  # with false hits


@pytest.fixture(scope="module")
def case():
    words = vocabulary(3, 60)
    items = [(1, prose(1, 30, words)), (2, prose(2, 12, words)), (3, prose(3, 7, words)), (4, "too short"), (5, prose(1, 30, words)), (None, prose(9, 20, words)), (6, None), (7, "")]
    texts = [prose(100 + i, 80, words) for i in range(10)]
    texts += [f"{prose(200, 50, words)}. {items[0][1].upper()}! {prose(201, 50, words)}", items[1][1], prose(202, 40, words) + ", " + items[2][1].replace(" ", "  -- ") + ". end", items[8 - 3][1], None, "", "...", " ".join(items[0][1].split()[:9])]
    texts.append(prose(7, 400_000, words) + " " + items[0][1] + " the end")
    return texts, items


@pytest.mark.parametrize("limit", [d.SET_ROWS, 0])
def test_agrees_with_sets_of_tuples(spark, case, limit):
    texts, items = case
    docs = documents(spark, texts)
    out = d.contaminated(docs, spark.createDataFrame(items, ITEMS), set_rows=limit)
    got = {r["doc_id"]: (r["item_ids"], r["n_hits"], r["hit_words"], r["n_words"], r["action"]) for r in out.collect()}
    want = brute(enumerate(texts, 1), items)
    assert got == want and {"cut", "drop"} <= {v[-1] for v in got.values()}


@pytest.mark.parametrize("limit", [d.SET_ROWS, 0])
def test_decisions_take_effect(spark, case, limit):
    texts, items = case
    docs = documents(spark, texts)
    bench = spark.createDataFrame(items, ITEMS)
    want = brute(enumerate(texts, 1), items)
    out = {r["doc_id"]: r for r in d.decontaminated(docs, bench, set_rows=limit).collect()}
    assert set(out) == {i for i in range(1, len(texts) + 1) if want.get(i, [""])[-1] != "drop"}
    for i, r in out.items():
        if i not in want:
            assert r["text"] == texts[i - 1]
        else:
            assert r["n_chars"] == len(r["text"]) < len(texts[i - 1])
    assert not brute(((i, r["text"]) for i, r in out.items()), items)


def test_text_around_a_cut_stays(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = documents(spark, [f"Before, {item.title()}. After it" + " word" * 20])
    r = d.decontaminated(docs, spark.createDataFrame([(1, item)], ITEMS)).first()
    assert r["text"] == "Before, . After it" + " word" * 20


def test_nulls_repeats_and_clashing_names(spark):
    item = prose(1, 20)
    data = [(None, item, "x"), (None, item, "x"), (7, item, None), (8, None, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, item_ids string").selectExpr("*", "'q' AS n_hits", "'q' AS action", "'q' AS found_id")
    bench = spark.createDataFrame([(1, item)], ITEMS).selectExpr("*", "'q' AS doc_id", "'q' AS hash")
    for limit in (d.SET_ROWS, 0):
        assert rows(d.contaminated(docs, bench, set_rows=limit), "doc_id", "item_ids") == [(7, "1"), (None, "1"), (None, "1")]
        assert rows(d.decontaminated(docs, bench, set_rows=limit), "doc_id", "text", "action") == [(8, None, "q")]


def test_decomposed_accents_and_text_ids(spark):
    import unicodedata

    item = "été déjà vu où ça mène à côté des élèves là"
    text = "Voilà " + unicodedata.normalize("NFD", item) + " et puis" + " mot" * 30
    docs = documents(spark, [text]).selectExpr("'d1' AS doc_id", "text", "n_chars")
    bench = spark.createDataFrame([("i1", item)], "item_id string, text string")
    assert rows(d.contaminated(docs, bench), "doc_id", "item_ids", "hit_words") == [("d1", "i1", 11)]
    r = d.decontaminated(docs, bench).first()
    assert r["text"] == "Voilà  et puis" + " mot" * 30 and r["n_chars"] == len(r["text"])


def test_windows_that_collide_are_told_apart(spark, monkeypatch):
    """With a hash of a few values nearly all windows hit; only equal words count."""
    monkeypatch.setattr(d, "BITMAP_BITS", 17)
    words = vocabulary(4, 40)
    items = [(i, prose(500 + i, 400, words)) for i in range(30)]
    texts = [prose(900 + i, 60, words) for i in range(20)] + [items[3][1]]
    for limit in (d.SET_ROWS, 0):
        got = {r["doc_id"]: r["hit_words"] for r in d.contaminated(documents(spark, texts), spark.createDataFrame(items, ITEMS), set_rows=limit).collect()}
        assert got == {k: v[2] for k, v in brute(enumerate(texts, 1), items).items()}


def test_empty_tables(spark):
    none, docs = spark.createDataFrame([], ITEMS), documents(spark, [prose(1, 50)])
    assert d.contaminated(docs, none).count() == 0 and d.decontaminated(docs, none).count() == 1
    empty = spark.createDataFrame([], DOCS)
    assert d.contaminated(empty, spark.createDataFrame([(1, prose(1, 20))], ITEMS)).count() == 0


def test_whole_query_agrees_with_brute_force(spark, sf_dir):
    from codeloom.llm.queries import op2_decontaminate

    texts = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    got = {r["doc_id"]: (r["item_ids"], r["n_hits"], r["hit_words"], r["n_words"], r["action"]) for r in op2_decontaminate(spark, sf_dir).collect()}
    assert got == brute(texts, items) and got
