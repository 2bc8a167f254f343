from __future__ import annotations

import base64

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm import tokens

from .helpers import documents, prose


@pytest.fixture(scope="module")
def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokens.VOCABULARY, "rb"))}
    return tiktoken.Encoding("plain", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@pytest.fixture(scope="module")
def counter():
    return tokens.Counter(open(tokens.VOCABULARY, "rb").read())


def test_whole_query_agrees_with_plain_encoding(spark, sf_dir, plain):
    from codeloom.llm.queries import op3_token_counts

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["n_tokens"] for r in op3_token_counts(spark, sf_dir).collect()}
    assert got == {i: len(plain(t)) for i, t in texts.items()}


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab AB,.;:!?'12 \n\t é中🙂<|>_-"), max_size=40))
def test_any_text(counter, plain, text):
    assert counter.count(text) == len(plain(text))


def test_cache_overflow_changes_nothing(plain, monkeypatch):
    counter = tokens.Counter(open(tokens.VOCABULARY, "rb").read())
    monkeypatch.setattr(tokens, "CACHED", 5)
    text = prose(5, 3000)
    assert counter.count(text) == counter.count(text) == len(plain(text))


def test_odd_rows(spark, plain):
    texts = [None, "", " ", "<|endoftext|>", "a" * 100_000, "x " * 50_000, "one two", "one two"]
    out = tokens.token_counts(documents(spark, texts).selectExpr("*", "'q' AS n_tokens"))
    assert [r["n_tokens"] for r in out.orderBy("doc_id").collect()] == [len(plain(t)) if t else 0 for t in texts]
    assert tokens.token_counts(documents(spark, ["a"]).limit(0)).count() == 0
    ids = spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")
    assert [tuple(r) for r in tokens.token_counts(ids).collect()] == [(None, 2), (None, 2)]


def test_lone_surrogates(counter):
    assert counter.count("a \ud800 b") == counter.count("a ? b")


def test_frequent_cuts_are_the_most_common(spark, monkeypatch):
    """Merged over several levels, the summaries give the most common cuts of all rows."""
    from collections import Counter

    texts = [prose(i, 200) for i in range(60)] + [None, "", "  ", "rare\n rare"]
    docs = documents(spark, texts).repartition(11)
    want = Counter(c for t in texts if t for c in t.split(" ") if tokens._usable(c))
    monkeypatch.setattr(tokens, "FAN", 2)
    found = tokens.frequent_cuts(docs.select("text"))
    assert found and set(found) <= set(want)
    top = [c for c, n in sorted(want.items(), key=lambda cn: (-cn[1], cn[0]))[:100]]
    assert set(top) <= set(found)


def test_the_table_tells_hits_from_misses(counter, plain):
    words = prose(1, 300).split(" ")
    table = tokens.Frequent(words[:150], counter.encode)
    known = table.unpacked()
    assert {(len(w.encode()), len(plain(" " + w))) for w in words[:150]} == set(known.values()) and len(known) == len(set(words[:150]))
    counter_ = tokens.Counter(open(tokens.VOCABULARY, "rb").read(), frequent=table)
    assert [counter_.count("a " + w) for w in words] == [len(plain("a " + w)) for w in words]
    assert table.hashes.dtype.itemsize + table.sizes.dtype.itemsize + table.tokens.dtype.itemsize == 10
