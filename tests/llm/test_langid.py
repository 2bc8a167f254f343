from __future__ import annotations

import numpy as np
import pytest

from codeloom.llm import langid

from .helpers import DOCS, documents, rows


@pytest.fixture(scope="module")
def tables(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return sf_dir, docs, [r.asDict() for r in docs.select("doc_id", "text", "lang").collect()]


@pytest.fixture(scope="module")
def model(tables):
    _, _, docs = tables
    some = [d for d in docs if d["doc_id"] % 2 == 0]
    return langid.train([d["text"] for d in some], [d["lang"] for d in some])


def test_held_out_accuracy(tables, model):
    _, _, docs = tables
    rest = [d for d in docs if d["doc_id"] % 2 and len(d["text"].split()) >= 20]
    found = list(model.detect([d["text"] for d in rest]))
    known = [(f, d) for f, d in zip(found, rest) if not f[3]]
    assert len(known) / len(rest) > 0.97
    assert sum(f[0] == d["lang"] for f, d in known) / len(known) > 0.97


def test_what_is_no_language_is_rejected(model):
    rng = np.random.default_rng(1)
    noise = [" ".join("".join(map(chr, rng.integers(0x3400, 0x9000, 6))) for _ in range(60)), " ".join("".join(map(chr, rng.integers(33, 127, 9))) for _ in range(80)), "", "...", None]
    assert [f[3] for f in model.detect(noise)] == [True] * len(noise)


def test_scores_agree_with_a_plain_mean(tables, model):
    from codeloom.llm.shared import Words

    _, _, docs = tables
    texts = [d["text"] for d in docs[:20]]
    for text, (language, confidence, known, _) in zip(texts, model.detect(texts)):
        w = Words([text])
        bucket, _ = langid._buckets(w, np.array([i for i, (a, n) in enumerate(zip(w.starts, w.lengths)) if not any(48 <= c <= 57 for c in w.codes[a : a + n])], np.int64))
        mean = model.table[bucket].mean(0)
        z = mean[:-1] + model.bias
        p = np.exp(z - z.max())
        p /= p.sum()
        assert confidence == pytest.approx(p.max(), abs=1e-4) and known == pytest.approx(mean[-1], abs=1e-4)
        assert language in (None, model.languages[int(p.argmax())])


def test_unknown_languages_numbers_and_shuffled_letters(tables):
    """Both error rates: a language that wasn't shown is rejected, the others are kept; numbers tell nothing."""
    import random

    _, _, docs = tables
    rng = random.Random(0)
    for out in ("de", "fr"):
        some = [d for d in docs if d["lang"] != out and d["doc_id"] % 2 == 0]
        m = langid.train([d["text"] for d in some], [d["lang"] for d in some])
        long = [d for d in docs if d["doc_id"] % 2 and len(d["text"].split()) >= 40]
        strangers = [f[3] for f in m.detect([d["text"] for d in long if d["lang"] == out])]
        others = [d["text"] for d in long if d["lang"] != out]
        assert np.mean(strangers) > 0.95 and np.mean([f[3] for f in m.detect(others)]) < 0.05
        shuffled = [" ".join("".join(rng.sample(w, len(w))) for w in t.split()) for t in others[:100]]
        assert np.mean([f[3] for f in m.detect(shuffled)]) > 0.95
        a, b = list(m.detect([others[0], others[0] + " 12345 a1b2c3d4e5f6" * 50]))
        assert a[:2] == b[:2] and [f[3] for f in m.detect(["123 456 0x9f"])] == [True]


def test_long_texts_count_whole(tables, model):
    _, _, docs = tables
    one = {lang: next(d["text"] for d in docs if d["lang"] == lang and len(d["text"]) > 2000) for lang in ("en", "de")}
    mixed = one["en"] + " " + " ".join([one["de"]] * (1_500_000 // len(one["de"]) + 1))
    assert len(mixed) > 1_000_000
    assert next(iter(model.detect([mixed])))[0] == "de"


def test_odd_rows(spark, model, tables):
    _, _, docs = tables
    text = next(d["text"] for d in docs if d["lang"] == "fr" and len(d["text"]) > 500)
    texts = [None, "", text, text]
    table = documents(spark, texts).selectExpr("*", "'q' AS language", "'q' AS rejected")
    assert rows(langid.languages(table, model), "doc_id", "language", "rejected") == [(1, None, True), (2, None, True), (3, "fr", False), (4, "fr", False)]
    kept = langid.accepted(table.withColumn("lang", table.lang.substr(9, 1)).selectExpr("doc_id", "text", "nullif(lang, '') AS lang", "language"), model)
    assert rows(kept, "doc_id", "lang", "language") == [(3, "fr", "q"), (4, "fr", "q")]
    empty = spark.createDataFrame([], DOCS)
    assert langid.languages(empty, model).count() == langid.accepted(empty, model).count() == 0


def test_no_labels(spark):
    docs = documents(spark, ["some words"], lang=None)
    model = langid.fit(docs)
    assert model is None
    assert rows(langid.languages(docs, model), "doc_id", "language", "rejected") == [(1, None, True)]
    assert langid.accepted(docs, model).count() == 0


def test_whole_query(spark, tables):
    from codeloom.llm.queries import op7_langid

    sf_dir, _, docs = tables
    found = {r["doc_id"]: r for r in op7_langid(spark, sf_dir).collect()}
    assert set(found) == {d["doc_id"] for d in docs}
    long = [d for d in docs if len(d["text"].split()) >= 50]
    assert sum(found[d["doc_id"]]["language"] == d["lang"] for d in long) / len(long) > 0.97


@pytest.mark.parametrize("unknown", ["de", "en", "es", "fr"])
def test_a_language_left_out_of_training_is_rejected(tables, unknown):
    _, _, docs = tables
    long = [d for d in docs if len(d["text"].split()) >= 20]
    some = [d for d in docs if d["doc_id"] % 2 == 0 and d["lang"] != unknown]
    model = langid.train([d["text"] for d in some], [d["lang"] for d in some])
    lost = [f[3] for f in model.detect([d["text"] for d in long if d["doc_id"] % 2 and d["lang"] != unknown])]
    away = [f[3] for f in model.detect([d["text"] for d in long if d["lang"] == unknown])]
    assert np.mean(away) > 0.95 and np.mean(lost) < 0.05
