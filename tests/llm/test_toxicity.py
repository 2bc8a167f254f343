from __future__ import annotations

import random

import numpy as np
import pytest

from codeloom.llm import toxicity as t

from .helpers import DOCS, documents, prose, rows, vocabulary

GROUPS = ("muslims", "women", "immigrants", "gays", "jews")


def labelled(seed: int, n: int, skew: float = 0.7):
    """Sentences with insults, and clean ones; toxic ones mention a group more often than clean ones do."""
    rng, words = random.Random(seed), vocabulary(4)
    insults = ["scumbags", "vermin", "idiots", "filth", "trash"]
    out = []
    for k in range(n):
        toxic = k % 3 == 0
        sentences = [prose(rng.random() * 1e9, rng.randint(6, 14), words) for _ in range(rng.randint(3, 8))]
        at = rng.randrange(len(sentences))
        if toxic:
            sentences[at] = f"those {rng.choice(GROUPS) if rng.random() < skew else 'people'} are {rng.choice(insults)} {prose(rng.random() * 1e9, 3, words)}"
        elif rng.random() < 0.15:
            sentences[at] = f"many {rng.choice(GROUPS) if rng.random() < 0.5 else 'people'} are {prose(rng.random() * 1e9, 5, words)}"
        out.append((". ".join(sentences) + ".", int(toxic)))
    return out


@pytest.fixture(scope="module")
def model():
    rows_ = labelled(1, 900)
    return t.train([x for x, _ in rows_], [y for _, y in rows_])


def test_held_out_accuracy(model):
    rows_ = labelled(2, 600)
    found = model.scores([x for x, _ in rows_])[0] >= model.threshold
    truth = np.array([bool(y) for _, y in rows_])
    assert (found & truth).sum() / truth.sum() > 0.95
    assert (found & ~truth).sum() / (~truth).sum() < 0.02


def test_the_penalty_makes_mentions_neutral(model):
    rows_ = labelled(1, 900, skew=1.0)
    texts, labels = [x for x, _ in rows_], [y for _, y in rows_]
    free, held = t.train(texts, labels, penalty=0.0), t.train(texts, labels, penalty=5.0)
    words = vocabulary(4)
    plain = [f"many people are {prose(i, 6, words)}." for i in range(50)]
    named = [p.replace("people", GROUPS[i % len(GROUPS)]) for i, p in enumerate(plain)]
    logit = lambda m, x: np.log(np.clip(m.scores(x)[0], 1e-9, 1 - 1e-9) / np.clip(1 - m.scores(x)[0], 1e-9, 1))
    gap = {k: np.abs(logit(m, named) - logit(m, plain)).mean() for k, m in (("free", free), ("held", held))}
    assert gap["held"] < 0.6 * gap["free"]
    assert (held.scores(named)[0] >= held.threshold).mean() < 0.05


def test_scores_agree_with_a_plain_sum(model):
    texts = [x for x, _ in labelled(3, 20)] + ["", "...", None]
    got, _ = model.scores(texts)
    for text, score in zip(texts, got):
        sentences = [x for x in (text or "").replace("!", ".").replace("?", ".").replace("\n", ".").split(".")]
        each = [t.Sentences([x]) for x in sentences]
        logits = [float(s.word_scores(model.weights).sum()) + model.bias for s in each if s.count]
        assert score == pytest.approx(1 / (1 + np.exp(-max(logits))) if logits else 0.0, abs=1e-6)


def test_long_texts_are_scored_in_pieces(spark, model):
    words = vocabulary(4)
    clean = ". ".join(prose(k, 10, words) for k in range(20_000))
    insult = ". those women are vermin and scumbags. "
    assert len(clean) > 1_000_000
    scores, _ = model.scores([clean + insult, insult])
    assert scores[0] >= model.threshold and scores[1] >= model.threshold


def test_sentences_of_long_texts_stay_whole(model, monkeypatch):
    """A long text scores as its sentences do, wherever pieces would be cut."""
    text = ". ".join(x for x, _ in labelled(9, 12)) + " and a last one without an end"
    whole = model.scores([text])[0][0]
    for most in (40, 97, 300, 1000):
        monkeypatch.setattr(t, "STEP_CHARS", most)
        parts = t.sentence_pieces(text)
        assert "".join(parts) == text
        if most >= 300:
            assert model.scores([text])[0][0] == pytest.approx(whole, abs=1e-9)


def test_planted_mentions_and_swaps(model):
    """Groups that no label mentions are made neutral by planted mentions; what swaps change is told for each text."""
    rows_ = labelled(5, 900, skew=0.0)
    texts, labels = [x.replace("people", "folk") for x, _ in rows_], [y for _, y in rows_]
    m = t.train(texts, labels, penalty=5.0)
    assert 0 < m.swap_change < 0.6 * m.plain_swap_change
    terms = {h: c for h, c in zip(m.terms.tolist(), m.changes.tolist())}
    h = lambda w: int(t.Words([w]).hashes[0])
    _, change = m.scores(["many women are here. all jews", "nothing here", "", None])
    assert change.tolist() == [max(terms[h("women")], terms[h("jews")]), 0.0, 0.0, 0.0]
    group = t.IDENTITY_TERMS[0]
    score = {w: float(t.Sentences([w]).word_scores(m.weights)[0]) for w in group}
    assert terms[h("women")] == pytest.approx(max(abs(score["women"] - x) for x in score.values()))


def test_whole_query_agrees_with_a_plain_version(spark, sf_dir):
    """The registered query, row by row, against word-by-word sums of the model that the same rows give."""
    from codeloom.llm.queries import op6_toxicity

    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    some = t.labelled(docs, labels)
    text_of = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = {(text_of[r["doc_id"]], r["toxic"]) for r in labels.collect() if r["doc_id"] in text_of and r["toxic"] in (0, 1)}
    assert set(some) == want
    m = t.train([x for x, _ in some], [y for _, y in some])
    got = {r["doc_id"]: r for r in op6_toxicity(spark, sf_dir).collect()}
    assert set(got) == set(text_of)
    for i, text in text_of.items():
        each = [t.Sentences([x]) for x in (text or "").translate({ord(c): "." for c in "!?\n…"}).split(".")]
        logits = [float(s.word_scores(m.weights).sum()) + m.bias for s in each if s.count]
        score = 1 / (1 + np.exp(-max(logits))) if logits else 0.0
        assert got[i]["score"] == pytest.approx(score, abs=2e-6) and (abs(score - m.threshold) < 1e-6 or got[i]["toxic"] == (score >= m.threshold > 0))


def test_held_out_rows_of_the_tables(spark):
    """Fitted to a part of the labels, tried on the others."""
    sf_dir = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    m = t.fit(docs, labels, rows=100)
    seen = {x for x, _ in t.labelled(docs, labels, 100)}
    rest = [(r["text"], r["toxic"]) for r in docs.join(labels, "doc_id").select("text", "toxic").collect() if r["text"] not in seen and r["toxic"] in (0, 1)]
    found = m.scores([x for x, _ in rest])[0] >= m.threshold
    truth = np.array([y == 1 for _, y in rest])
    assert truth.sum() > 20 and (found & truth).sum() / truth.sum() > 0.8 and (found & ~truth).sum() / (~truth).sum() < 0.06


def test_repeated_ids_and_text_ids(spark):
    docs = spark.createDataFrame([("a", f"those are vermin {k}.") for k in range(50)] + [("b", f"good day {k}.") for k in range(50)], "doc_id string, text string")
    labels = spark.createDataFrame([("a", 1), ("b", 0), ("b", 0)], "doc_id string, toxic int")
    assert len(t.labelled(docs, labels, 5)) == 40
    out = t.toxicity(docs, t.fit(docs, labels, 40))
    assert {(r["doc_id"], r["toxic"]) for r in out.collect()} == {("a", True), ("b", False)}


def test_odd_rows(spark, model):
    texts = [None, "", "  ", "those muslims are vermin scumbags.", "those muslims are vermin scumbags.", "?!"]
    out = t.toxicity(documents(spark, texts).selectExpr("*", "'q' AS score", "'q' AS toxic"), model)
    assert [r["toxic"] for r in out.orderBy("doc_id").collect()] == [False, False, False, True, True, False]
    assert t.toxicity(spark.createDataFrame([], DOCS), model).count() == 0


def test_missing_labels(spark):
    docs = documents(spark, ["a b. c d", "e f"])
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 0), (2, 7)], "doc_id long, toxic int")
    for some in (labels, labels.limit(0)):
        assert rows(t.toxicity(docs, t.fit(docs, some)), "doc_id", "toxic") == [(1, False), (2, False)]


def test_fit_over_the_tables(spark):
    from codeloom.llm.queries import op6_toxicity

    sf_dir = "/root/testdata/sf0.01"
    found = {r["doc_id"]: r["toxic"] for r in op6_toxicity(spark, sf_dir).collect()}
    truth = {r["doc_id"]: r["toxic"] == 1 for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert len(found) == spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").distinct().count()
    hits = sum(found[i] for i, x in truth.items() if x and i in found)
    assert hits / sum(truth.values()) > 0.9
    assert sum(found[i] for i, x in truth.items() if not x and i in found) / max(1, sum(not x for x in truth.values())) < 0.05
