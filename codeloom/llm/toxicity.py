"""Toxicity: a linear classifier of sentences, regularised by counterfactuals.

A sentence's logit is the sum of its distinct words' scores; a word's score is its own weight plus the
weights of its character n-grams, scaled by the root of their number. A document is as toxic as its worst sentence. Labels are of documents, so
training alternates: all sentences of a clean document are clean; of a toxic one, only the sentence that the
model finds worst is taken for toxic (in the first round, all are, with less weight each). A feature is scaled
by the log ratio of its frequencies in toxic and clean documents, which keeps rare features from being learnt
by heart.

In every labelled sentence with an identity term, the term is swapped for others of its group, a neutral word
among them, and the squared change of the logit is penalised: so a mention of a group moves the score as
little as a mention of "people" does. Since a corpus may mention few of the groups, or none in its labelled part, a
share of the training documents, clean and toxic alike, gets a mention planted into one sentence. What the penalty does
is measured on held-out documents, with a model trained without it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import STEP_CHARS, Words, found_rows, parts, pieces, sampled, steps, with_ids

BUCKET_BITS = 18
ORDERS = (3, 6)
#: Labelled documents that are read for training and calibration, for each label.
TRAINING_ROWS = 700
#: Documents' worth of doubt about a feature's frequencies.
SMOOTHING = 40
#: Weight of the counterfactual penalty.
PENALTY = 1.0
#: Share of training documents of either label that get a planted mention.
MENTIONS = 0.2
#: Groups of words that may stand for each other; the first of each is neutral.
IDENTITY_TERMS = (
    ("people", "women", "men", "muslims", "christians", "jews", "hindus", "atheists", "immigrants", "refugees", "gays", "lesbians", "blacks", "whites", "asians", "africans", "latinos", "arabs", "teenagers", "pensioners"),
    ("ordinary", "female", "male", "muslim", "christian", "jewish", "hindu", "gay", "lesbian", "bisexual", "transgender", "black", "white", "asian", "african", "arab", "latino", "disabled", "deaf", "blind", "old", "young"),
    ("person", "woman", "man", "jew", "immigrant", "refugee", "foreigner"),
    ("gens", "femmes", "hommes", "musulmans", "juifs", "immigrés", "réfugiés", "noirs", "blancs", "arabes"),
    ("leute", "frauen", "männer", "muslime", "christen", "juden", "einwanderer", "flüchtlinge", "schwarze", "ausländer"),
    ("gente", "mujeres", "hombres", "musulmanes", "judíos", "inmigrantes", "refugiados", "negros", "blancos", "árabes"),
)
_ENDS = np.array([ord(c) for c in ".!?\n…"], np.uint32)

FOUND = "score double, toxic boolean, swap_change double"
_FOUND = [("score", pa.float64()), ("toxic", pa.bool_()), ("swap_change", pa.float64())]


class Sentences:
    """Distinct words of texts, the sentences they occur in, and the sentences' texts."""

    def __init__(self, texts: list[str | None]):
        w = Words(texts)
        sentence = np.cumsum(np.isin(w.codes, _ENDS))[w.starts]
        self.hashes, pick, word = np.unique(w.hashes, return_index=True, return_inverse=True)
        sentence = np.unique(sentence, return_inverse=True)[1] if len(sentence) else sentence
        self.count = int(sentence[-1]) + 1 if len(sentence) else 0
        doc = np.repeat(np.arange(len(texts)), np.diff(w.splits))
        self.doc = np.zeros(self.count, np.int64)
        self.doc[sentence] = doc
        pair = np.unique(sentence * (len(pick) + 1) + word)  # a word counts once in a sentence
        self.sentence, self.word = np.divmod(pair, len(pick) + 1)
        if len(pick):
            own = (w.hashes[pick] >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
            grams, owner = w.subwords(pick, *ORDERS)
            self.grams, self.owner = (grams >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), owner
            self.own, self.share = own, 1 / np.sqrt(np.maximum(np.bincount(owner, minlength=len(pick)), 1))
        else:
            self.own = self.grams = self.owner = np.zeros(0, np.int64)
            self.share = np.zeros(0)

    def word_scores(self, weights: np.ndarray) -> np.ndarray:
        """Own weights lie in the first half of weights, n-grams' in the second."""
        size = len(weights) // 2
        return weights[self.own] + np.bincount(self.owner, weights[size + self.grams], len(self.own)) * self.share

    def logits(self, weights: np.ndarray, bias: float) -> np.ndarray:
        return np.bincount(self.sentence, self.word_scores(weights)[self.word], self.count) + bias

    def slope(self, of_words: np.ndarray, size: int) -> np.ndarray:
        """Slopes of words' scores as slopes of weights."""
        return np.concatenate([np.bincount(self.own, of_words, size), np.bincount(self.grams, (of_words * self.share)[self.owner], size)])

    def log_ratio(self, toxic: np.ndarray, size: int) -> np.ndarray:
        """For each weight, the log of how much more often its feature occurs in toxic documents than in clean ones."""
        docs = np.unique(self.doc[self.sentence] * len(self.own) + self.word)  # a word counts once in a document
        doc, word = np.divmod(docs, len(self.own))
        seen = []
        for label in (1, 0):
            n = np.bincount(word[toxic[doc] == label], minlength=len(self.own)).astype(float)
            seen.append(np.concatenate([np.bincount(self.own, n, size), np.bincount(self.grams, n[self.owner], size)]))
        share = (toxic == 1).mean()
        return np.log((seen[0] + SMOOTHING * share) / (seen[1] + SMOOTHING * (1 - share)) * (1 - share) / share)

    def worst(self, logits: np.ndarray, texts: int) -> np.ndarray:
        """Of each text, its sentences' largest logit; -inf without a word."""
        out = np.full(texts, -np.inf)
        np.maximum.at(out, self.doc, logits)
        return out


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    threshold: float
    #: Sorted hashes of identity terms, and how much a sentence's logit changes at most when one stands for another.
    terms: np.ndarray
    changes: np.ndarray
    #: Mean change of a planted term's logit on held-out documents: of this model, and of one trained without penalty.
    swap_change: float = 0.0
    plain_swap_change: float = 0.0

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """For each text, the worst sentence's probability, 0 without words, and the largest change of a sentence's logit
        when one of the text's identity terms stands for another of its group, 0 without one."""
        out, change = np.zeros(len(texts)), np.zeros(len(texts))
        for start, end in steps(texts):
            group = texts[start:end]
            if end - start == 1 and group[0] and len(group[0]) > STEP_CHARS:
                p, c = self._scores(sentence_pieces(group[0]))
                out[start], change[start] = p.max(), c.max()
            else:
                out[start:end], change[start:end] = self._scores(group)
        return out, change

    def _scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        s = Sentences(texts)
        change = np.zeros(len(texts))
        if len(self.terms) and len(s.hashes):
            at = np.minimum(np.searchsorted(self.terms, s.hashes), len(self.terms) - 1)
            of_word = np.where(self.terms[at] == s.hashes, self.changes[at], 0.0)
            np.maximum.at(change, s.doc[s.sentence], of_word[s.word])
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-s.worst(s.logits(self.weights, self.bias), len(texts)))), change


def sentence_pieces(text: str) -> list[str]:
    """A very long text in pieces that end with a sentence, so that none is scored in parts; a sentence that is itself
    longer than STEP_CHARS is cut between words."""
    out, start = [], 0
    while len(text) - start > STEP_CHARS:
        end = max(text.rfind(chr(c), start, start + STEP_CHARS) for c in _ENDS.tolist()) + 1
        if end <= start:
            nearest = [x for c in _ENDS.tolist() if (x := text.find(chr(c), start + STEP_CHARS)) >= 0]
            end = min(nearest) + 1 if nearest else len(text)
            out += pieces(text[start:end])
        else:
            out.append(text[start:end])
        start = end
    return [*out, text[start:]]


def planted(texts: list[str], rng: np.random.Generator, groups: tuple[tuple[str, ...], ...], share: float) -> list[str]:
    """The texts, a share of them with a term at a random place."""
    out = list(texts)
    for i in np.flatnonzero(rng.random(len(texts)) < share).tolist() if groups else ():
        tokens, group = out[i].split(" "), groups[int(rng.integers(len(groups)))]
        tokens.insert(int(rng.integers(len(tokens) + 1)), group[int(rng.integers(len(group)))])
        out[i] = " ".join(tokens)
    return out


def term_changes(groups: tuple[tuple[str, ...], ...], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes of all terms, the largest difference of each one's score from another's of its group)"""
    worst: dict[int, float] = {}
    for group in groups:
        s = Sentences([f"{t}." for t in group])
        score = dict(zip(s.hashes.tolist(), s.word_scores(weights).tolist()))
        for h, x in score.items():
            worst[h] = max(worst.get(h, 0.0), max(abs(x - y) for y in score.values()))
    hashes = np.array(sorted(worst), np.uint64)
    return hashes, np.array([worst[h] for h in hashes.tolist()])


def swaps(s: Sentences, rng: np.random.Generator, groups: tuple[tuple[str, ...], ...]) -> tuple[np.ndarray, list[str]]:
    """(word numbers of identity terms in sentences, what each is swapped for); the first swap is the neutral word."""
    number = {}
    for g in groups:
        for term in g:
            h = Words([term]).hashes
            if len(h) == 1:
                at = np.searchsorted(s.hashes, h[0])
                if at < len(s.hashes) and s.hashes[at] == h[0]:
                    number[int(at)] = (term, g)
    hit = np.flatnonzero(np.isin(s.word, list(number)))
    terms, others = [], []
    for i in hit.tolist():
        term, group = number[int(s.word[i])]
        rest = [x for x in group if x != term]
        for other in {group[0], rest[int(rng.integers(len(rest)))]} - {term}:
            terms.append(int(s.word[i]))
            others.append(other)
    return np.array(terms, np.int64), others


def train(texts: list[str | None], labels: list[int], groups: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, penalty: float = PENALTY, mentions: float = MENTIONS, rounds: int = 3, passes: int = 25, seed: int = 0) -> Model:
    """A model from labelled documents; a fifth of them is held out to choose the threshold and to measure swaps."""
    model, held = _train(texts, labels, groups, penalty, mentions, rounds, passes, seed)
    if penalty and mentions and model.threshold < 1:
        plain, _ = _train(texts, labels, groups, 0.0, mentions, rounds, passes, seed)
        rng = np.random.default_rng(seed)
        some = Sentences(planted([t for t, _ in held], rng, groups, 1.0))
        terms, others = swaps(some, rng, groups)
        o = Sentences(others)
        if len(terms):
            mean = lambda m: float(np.abs(some.word_scores(m.weights)[terms] - o.word_scores(m.weights)[o.word]).mean())
            model.swap_change, model.plain_swap_change = mean(model), mean(plain)
    return model


def _train(texts: list[str | None], labels: list[int], groups: tuple[tuple[str, ...], ...], penalty: float, mentions: float, rounds: int, passes: int, seed: int) -> tuple[Model, list[tuple[str, int]]]:
    rng = np.random.default_rng(seed)
    rows = sorted((t, int(x)) for t, x in zip(texts, labels) if t and x is not None)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    held = len(rows) // 5
    own, y_doc = planted([t for t, _ in rows[held:]], rng, groups, mentions), np.array([x for _, x in rows[held:]])
    size = 1 << BUCKET_BITS
    weights, bias = np.zeros(2 * size), 0.0
    none = np.zeros(0)
    if not len(y_doc) or y_doc.min() == y_doc.max():
        return Model(weights, bias, 1.0, none.astype(np.uint64), none), []  # nothing to tell apart: no document is toxic
    s = Sentences(own)
    y = y_doc[s.doc].astype(float)
    scale = s.log_ratio(y_doc, size)
    terms, others = swaps(s, rng, groups)
    o = Sentences(others)  # one sentence of one word for each swap
    per_doc = np.bincount(s.doc, minlength=len(own))
    first, second, step_no = np.zeros(2 * size + 1), np.zeros(2 * size + 1), 0
    for r in range(rounds):
        if r:
            logits = s.logits(scale * weights, bias)
            worst = s.worst(logits, len(own))
            importance = np.where(y == 0, 1.0, logits == worst[s.doc])
        else:
            importance = np.where(y == 0, 1.0, 1 / per_doc[s.doc])
        positive, negative = (importance * y).sum(), (importance * (1 - y)).sum()
        importance = importance * np.where(y == 1, 0.5 / max(positive, 1e-9), 0.5 / max(negative, 1e-9))
        for _ in range(passes):
            now = scale * weights
            logits = s.logits(now, bias)
            error = importance * (1 / (1 + np.exp(-np.clip(logits, -50, 50))) - y)
            slope = s.slope(np.bincount(s.word, error[s.sentence], len(s.own)), size)
            if len(terms):
                change = s.word_scores(now)[terms] - o.word_scores(now)[o.word]
                pull = 2 * penalty * change / len(terms)
                slope += s.slope(np.bincount(terms, pull, len(s.own)), size) - o.slope(np.bincount(o.word, pull, len(o.own)), size)
            slope = np.append(slope * scale + 1e-5 * weights, error.sum())
            step_no += 1
            first += 0.1 * (slope - first)
            second += 0.001 * (slope * slope - second)
            move = 0.05 * (first / (1 - 0.9**step_no)) / (np.sqrt(second / (1 - 0.999**step_no)) + 1e-8)
            weights -= move[:-1]
            bias -= move[-1]
    final = (scale * weights).astype(np.float32)
    model = Model(final, float(bias), 0.5, *term_changes(groups, final))
    test = rows[:held] or rows
    model.threshold = best_threshold(model.scores([t for t, _ in test])[0], np.array([x for _, x in test]))
    return model, test


def best_threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """The threshold of the best F1; of equal ones, the middle of the gap. 0.5 if a label is missing."""
    if not len(labels) or labels.min() == labels.max():
        return 0.5
    order = np.argsort(-scores, kind="stable")
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + labels.sum())
    ranked = scores[order]
    last = np.append(ranked[:-1] > ranked[1:], True)  # equal scores fall on one side
    at = int(np.flatnonzero(last & (f1 == f1[last].max()))[0])
    return float((ranked[at] + (ranked[at + 1] if at + 1 < len(ranked) else 0.0)) / 2)


def labelled(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> list[tuple[str | None, int]]:
    """Distinct (text, label) of about ``rows`` documents of each label, eight times ``rows`` at most: of more, as
    repeated ids may give, those with the least hashes."""
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)")
    chosen = sampled(marked, "label", rows)  # a bounded number
    some = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id").select("text", "label").distinct()
    return [(r["text"], r["label"]) for r in some.orderBy(F.xxhash64("text"), "label").limit(8 * rows).collect()]


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, groups: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, penalty: float = PENALTY, mentions: float = MENTIONS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from about ``rows`` documents of each label (see ``labelled``), whose score ``penalty`` keeps from changing
    when a term of one of the groups stands for another. Null and empty texts, and labels other than 0 and 1, teach
    nothing; without documents of both labels nothing is toxic."""
    some = labelled(docs, labels, rows, id_col, text_col, label_col)
    return train([t for t, _ in some], [x for _, x in some], groups, penalty, mentions)


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, toxic, swap_change) for every row of docs; toxic is score >= the model's threshold, swap_change how
    much the logit of one of its sentences changes at most when an identity term stands for another of its group.

    Null, empty and wordless texts score 0 and aren't toxic; texts of any length are scored whole. Null ids and repeated
    rows are kept, ids keep their type; other columns are not read; an empty table gives no rows. A model fitted without rows of both labels scores every document 0.5 and finds none toxic.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 1):
            scores, changes = sent.value.scores(batch.column(1).to_pylist())
            yield found_rows(batch.column(0), ((i, round(float(x), 6), bool(x >= sent.value.threshold and x > 0), round(float(c), 6)) for i, (x, c) in enumerate(zip(scores, changes))), _FOUND)

    rows, schema = with_ids(docs, id_col, text_col, FOUND)
    return rows.mapInArrow(run, schema)
