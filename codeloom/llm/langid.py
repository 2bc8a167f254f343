"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection.

A word's features are its character n-grams of 1 to 4 with the word's ends marked, hashed into buckets; words with a
digit (numbers, keys, parts of addresses) are of no language and don't count. A text is the mean of its features' embeddings; a linear softmax over it gives the language. Both are trained together
by stochastic gradient descent in numpy. Since the mean is linear, embeddings times output weights make one
small table, and a text needs only sums over that table.

A text is rejected when its confidence, or the share of its features that training has seen, is below a threshold
for its length. The thresholds are calibrated on held-out texts and runs of their words: each is what all but QUANTILE of
them reach, or, where that is less, what all but MISSED of texts that should be rejected stay below: those in languages
that a model trained for this was not shown, and the held-out ones with their words' letters shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import STEP_CHARS, Words, found_rows, parts, pieces, sampled, steps, with_ids

BUCKET_BITS = 17
DIM = 16
ORDERS = (1, 4)
#: Labelled rows that are read for training and calibration, for each language.
TRAINING_ROWS = 200
#: Share of held-out texts that confidence, and known share, may reject.
QUANTILE = 0.005
#: Share of texts in unknown languages, and of shuffled ones, that one of the two thresholds may let pass.
MISSED = 0.005
#: Models trained without a part of the languages, at most.
FOLDS = 2
_PIECE_WORDS = 24
_CLASSES = 12  # of text lengths, by powers of two
_WHOLE = 4

FOUND = "language string, confidence double, known double, rejected boolean"
_FOUND = [("language", pa.string()), ("confidence", pa.float64()), ("known", pa.float64()), ("rejected", pa.bool_())]


def _buckets(w: Words, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashes, owner = w.subwords(pick, *ORDERS)
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), owner


def spelt(w: Words) -> np.ndarray:
    """Numbers of the words without a digit of 0 to 9."""
    if not len(w.hashes):
        return np.zeros(0, np.int64)
    return np.flatnonzero(~np.logical_or.reduceat((w.chars >= 48) & (w.chars <= 57), w.first))


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # a row for each bucket: a score for each language, and whether training has seen it
    bias: np.ndarray
    least: np.ndarray  # by class of length: least confidence, least known share

    def sums(self, texts: list[str | None]) -> np.ndarray:
        """For each text: sums of its features' rows, number of features, number of words without digits."""
        out = np.zeros((len(texts), self.table.shape[1] + 2))
        for start, end in steps(texts):
            if end - start == 1 and texts[start] and len(texts[start]) > STEP_CHARS:
                out[start] = sum(self._sums(Words([p]))[0] for p in pieces(texts[start]))
            else:
                out[start:end] = self._sums(Words(texts[start:end]))
        return out

    def _sums(self, w: Words) -> np.ndarray:
        _, pick, back = np.unique(w.hashes, return_index=True, return_inverse=True)
        rows = np.zeros((len(pick), self.table.shape[1] + 2))
        counted = np.flatnonzero(np.isin(pick, spelt(w)))
        if len(counted):
            rows[counted, -1] = 1
            bucket, owner = _buckets(w, pick[counted])
            rows[counted, -2] = np.bincount(owner, minlength=len(counted))
            for c in range(self.table.shape[1]):
                rows[counted, c] = np.bincount(owner, self.table[bucket, c], len(counted))
        total = np.concatenate([np.zeros((1, rows.shape[1])), np.cumsum(rows[back], 0)])
        return total[w.splits[1:]] - total[w.splits[:-1]]

    def judged(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(language number, confidence, known share, class of length)"""
        n = np.maximum(sums[:, -2:-1], 1)
        logits = sums[:, : len(self.languages)] / n + self.bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        return p.argmax(1), p.max(1), sums[:, -3] / n[:, 0], length_class(sums[:, -1])

    def detect(self, texts: list[str | None]) -> Iterator[tuple[str | None, float, float, bool]]:
        """(language, confidence, known share, rejected) of each text; a text without such words is rejected."""
        sums = self.sums(texts)
        for k, p, known, c, words in zip(*self.judged(sums), sums[:, -1]):
            reject = bool(not words or p < self.least[c, 0] or known < self.least[c, 1])
            yield None if reject else self.languages[k], round(float(p), 6) if words else 0.0, round(float(known), 6), reject


def length_class(words: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(words, 1)).astype(int), _CLASSES - 1)


Row = tuple[str, str]


def train(texts: list[str], labels: list[str], epochs: int = 3, rate: float = 0.1, seed: int = 0) -> Model | None:
    """A model from labelled texts; a quarter of them is held out for calibration. None without any text."""
    rng = np.random.default_rng(seed)
    rows = sorted((label, text) for text, label in zip(texts, labels) if text and label)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    if not rows:
        return None
    held, own = rows[: len(rows) // 4], rows[len(rows) // 4 :]
    model = learnt(own, epochs, rate, rng)
    model.least = _calibrated(model, held, own, epochs, rate, rng)
    return model


def learnt(rows: list[Row], epochs: int, rate: float, rng: np.random.Generator) -> Model:
    """A model of (label, text) rows that rejects nothing."""
    languages = sorted({label for label, _ in rows})
    number = {x: i for i, x in enumerate(languages)}
    # pieces of whole texts, as word numbers
    features, words_of, targets = [], [], []
    at = 0
    for label, text in rows:
        w = Words([text])
        if len(own := spelt(w)):
            bucket, owner = _buckets(w, own)
            order = np.argsort(owner // _PIECE_WORDS, kind="stable")
            piece = (owner // _PIECE_WORDS)[order]
            features.append(bucket[order])
            words_of.append(piece + at)
            k = int(piece[-1]) + 1
            targets += [number[label]] * k
            at += k
    size, classes = 1 << BUCKET_BITS, len(languages)
    embed = (rng.random((size, DIM), np.float32) - 0.5) / DIM
    weights, bias = np.zeros((DIM, classes), np.float32), np.zeros(classes, np.float32)
    seen = np.zeros(size, np.float32)
    had = {id(x): np.zeros_like(x) for x in (embed, weights, bias)}
    if features:
        bucket, piece, target = np.concatenate(features), np.concatenate(words_of), np.array(targets)
        seen[bucket] = 1
        starts = np.searchsorted(piece, np.arange(at + 1))
        batches = -(-at // 64)
        for epoch in range(epochs):
            for b, chosen in enumerate(np.array_split(rng.permutation(at), batches)):
                step = rate * (1 - (epoch * batches + b) / (epochs * batches))
                n = starts[chosen + 1] - starts[chosen]
                begin = np.cumsum(n) - n
                f = bucket[np.arange(n.sum()) - np.repeat(begin, n) + np.repeat(starts[chosen], n)]
                x = np.add.reduceat(embed[f], begin) / n[:, None].astype(np.float32)
                z = x @ weights + bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(chosen)), target[chosen]] -= 1
                back = p @ weights.T / n[:, None].astype(np.float32)
                order = np.argsort(f, kind="stable")
                distinct, first = np.unique(f[order], return_index=True)
                slope = np.add.reduceat(np.repeat(back, n, axis=0)[order], first)
                # each parameter's step shrinks with the slopes that it has had
                for value, at_, s in ((embed, distinct, slope), (weights, slice(None), x.T @ p), (bias, slice(None), p.sum(0))):
                    past = had[id(value)]
                    past[at_] += s * s
                    value[at_] -= step * s / np.sqrt(past[at_] + 1e-8)
    return Model(languages, np.column_stack([embed @ weights, seen]), bias, np.zeros((_CLASSES, 2)))


def _runs(texts: list[str], rng: np.random.Generator) -> list[str]:
    """Runs of the texts' words, of every length class."""
    out = []
    for text in texts:
        tokens = text.split()
        for c in range(_CLASSES):
            if len(tokens) >= 1 << c:
                for at in rng.integers(0, len(tokens) - (1 << c) + 1, 3):
                    out.append(" ".join(tokens[at : at + (1 << c)]))
    return out


def _shuffled(text: str, rng: np.random.Generator) -> str:
    return " ".join("".join(rng.permutation(list(w))) for w in text.split())


def _calibrated(model: Model, held: list[Row], own: list[Row], epochs: int, rate: float, rng: np.random.Generator) -> np.ndarray:
    """By class of length, the least confidence and the least known share.

    Long classes have few texts, so that their worst one would be the threshold: none is above what all but QUANTILE of
    the whole texts of 1 << _WHOLE words or more, together, reach.
    """
    texts = [t for _, t in held]
    least = np.zeros((_CLASSES, 2))
    if not texts:
        return least
    _, p, known, c = model.judged(model.sums(texts + _runs(texts, rng)))
    reached = np.column_stack([p, known])
    wrong = [_judged_runs(model, [_shuffled(t, rng) for t in texts], rng)]
    folds = [model.languages[i::FOLDS] for i in range(FOLDS) if model.languages[i::FOLDS]]
    for out in folds if len(model.languages) > 1 else ():
        unknown = [t for label, t in held if label in out]
        if unknown:
            wrong.append(_judged_runs(learnt([r for r in own if r[0] not in out], epochs, rate, rng), unknown, rng))
    bad, bad_class = np.concatenate([x for x, _ in wrong]), np.concatenate([k for _, k in wrong])
    for k in range(_CLASSES):
        if (c == k).any():
            least[k] = np.quantile(reached[c == k], QUANTILE, axis=0)
            if (bad_class == k).any():
                least[k] = np.minimum(least[k], np.quantile(bad[bad_class == k], 1 - MISSED, axis=0) + 1e-9)
        elif k:
            least[k] = least[k - 1]
    whole = np.flatnonzero(c[: len(texts)] >= _WHOLE)
    return np.minimum(least, np.quantile(reached[whole], QUANTILE, axis=0)) if len(whole) else least


def _judged_runs(model: Model, texts: list[str], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    _, p, known, c = model.judged(model.sums(texts + _runs(texts, rng)))
    return np.column_stack([p, known]), c


def fit(docs: DataFrame, rows: int = TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model from about ``rows`` distinct labelled rows of each of the shared.MOST_LABELS most common languages of
    docs; None without one. Null and empty texts teach nothing, texts of any length are read whole."""
    some = sampled(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("label")), "label", rows).collect()
    return train([r["text"] for r in some], [r["label"] for r in some])


def languages(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, language, confidence, known, rejected) for every row of docs.

    language is null where the text is rejected: it has no word but ones with digits (null and empty texts included), or is too
    unlike what the model knows. Without a model (no labelled row) all are rejected. Texts of any length are read
    whole. Null ids and repeated rows are kept, ids keep their type; other columns are not read; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 1):
            texts = batch.column(1).to_pylist()
            found = sent.value.detect(texts) if sent.value else ((None, 0.0, 0.0, True) for _ in texts)
            yield found_rows(batch.column(0), ((i, *f) for i, f in enumerate(found)), _FOUND)

    rows, schema = with_ids(docs, id_col, text_col, FOUND)
    return rows.mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Model | None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that the model doesn't reject, with the language found where ``lang_col`` is null.

    Texts that are null, empty or without a word but ones with digits are rejected, so an empty table stays empty and without a model nothing
    stays; ids may be null, rows may repeat, columns may have any name and stay as they are.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, text_col):
            texts = batch.column(text_col).to_pylist()
            found = list(sent.value.detect(texts)) if sent.value else [(None, 0.0, 0.0, True)] * len(texts)
            at = batch.schema.get_field_index(lang_col)
            named = [old if old is not None else f[0] for old, f in zip(batch.column(at).to_pylist(), found)]
            batch = batch.set_column(at, batch.schema.field(at), pa.array(named, pa.string()).cast(batch.schema.field(at).type))
            yield batch.filter(pa.array([not f[3] for f in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
