"""Token counts with a two-tier lookup and no shuffle of pre-tokens.

Tier one is a table of the corpus's frequent pre-tokens, sent to all executors: their hashes, sorted, and how many tokens
each has. It is built from summaries: every partition counts its pre-tokens and hands on the FREQUENT most common ones;
summaries are merged a few at a time until one is left. What the table lacks is encoded once and kept in the worker's
cache. Texts are cut at single spaces, where a pre-token always begins, so that a cut is one pre-token or a few (a word
and its comma).
"""

from __future__ import annotations

import base64
from collections import Counter as Tally
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
from pyspark.sql import DataFrame

from .shared import discard, parts, with_ids, worker_cache, written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The vocabulary's pre-token pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Rows of the table, and of each partition's summary.
FREQUENT = 32_768
#: Summaries that are merged by one task.
FAN = 32
#: Entries of a worker's cache; it is emptied when it is full.
CACHED = 600_000
#: Longer cuts are counted but not kept.
KEPT_CHARS = 64


class _Unclean(Exception):
    """A cut begins or ends with white space, so splitting at every space was wrong."""


class Frequent:
    """Sorted 64-bit hashes of cuts, their lengths in bytes, and their numbers of tokens: 10 bytes a cut."""

    def __init__(self, cuts: list[str], encode):
        data = [c.encode("utf-8", "surrogatepass") for c in cuts]
        hashes = np.array([xxhash.xxh64_intdigest(d) for d in data], np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.sizes = np.array([min(len(d), 255) for d in data], np.uint8)[order]
        self.tokens = np.array([len(encode(" " + c)) for c in cuts], np.uint8)[order]

    def unpacked(self) -> dict[int, tuple[int, int]]:
        """Hash -> (length, tokens), for one worker."""
        return dict(zip(self.hashes.tolist(), zip(self.sizes.tolist(), self.tokens.tolist())))


class _Counts(dict):
    """Tokens of a cut together with the space before it, as far as this worker has met it: from the table, else encoded."""

    def __init__(self, frequent: Frequent, encode):
        super().__init__()
        self._frequent, self._encode = frequent.unpacked(), encode

    def __missing__(self, cut: str) -> int:
        if not cut or cut[0].isspace() or cut[-1].isspace():
            raise _Unclean
        data = cut.encode("utf-8", "surrogatepass")
        size, n = self._frequent.get(xxhash.xxh64_intdigest(data), (-1, 0))
        if size != min(len(data), 255):
            if cut[-1] in ",.;:!?" and cut[:-1].isalpha():
                return self[cut[:-1]] + 1  # the mark is a pre-token of its own
            n = len(self._encode(" " + cut))
        if len(cut) <= KEPT_CHARS:
            if len(self) >= CACHED:
                self.clear()
            self[cut] = n
        return n


def encoder(ranks: bytes, pattern: str):
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary


class Counter:
    """Numbers of tokens of texts, for one vocabulary."""

    def __init__(self, ranks: bytes, pattern: str = PATTERN, frequent: Frequent | None = None):
        self.encode = encoder(ranks, pattern)
        self.counts = _Counts(frequent or Frequent([], self.encode), self.encode)

    def count(self, text: str | None) -> int:
        """Tokens of a text; null and empty texts have none."""
        if not text:
            return 0
        first, *cuts = text.split(" ")
        try:
            if not first or first[-1].isspace():
                raise _Unclean
            return len(self.encode(first)) + sum(map(self.counts.__getitem__, cuts))
        except _Unclean:
            pass
        except UnicodeEncodeError:
            return self.count(text.encode("utf-8", "replace").decode())
        return len(self.encode(text))


def _usable(cut: str) -> bool:
    return 0 < len(cut) <= KEPT_CHARS and not cut[0].isspace() and not cut[-1].isspace() and cut.isprintable()


def _top(tally: Tally) -> pa.RecordBatch:
    """The FREQUENT most common cuts, equal ones in order."""
    best = sorted(((c, n) for c, n in tally.items() if n > 1), key=lambda cn: (-cn[1], cn[0]))[:FREQUENT]
    return pa.RecordBatch.from_arrays([pa.array([c for c, _ in best], pa.string()), pa.array([n for _, n in best], pa.int64())], names=["cut", "n"])


def frequent_cuts(texts: DataFrame) -> list[str]:
    """The most common cuts of a table (text), by summaries of partitions that are merged in a tree.

    A cut that is among the FREQUENT of no partition may be missing; what is missing costs time only. A summary's size
    is bounded, so what is shuffled grows with the number of partitions, not with the pre-tokens.
    """

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Tally = Tally()
        for batch in parts(batches, 0):
            tally.update(" ".join(filter(None, batch.column(0).to_pylist())).split(" "))
            if len(tally) > 16 * FREQUENT:
                tally = Tally(dict(tally.most_common(4 * FREQUENT)))
        yield _top(Tally({c: n for c, n in tally.items() if n > 1 and _usable(c)}))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Tally = Tally()
        for batch in batches:
            for c, n in zip(*(x.to_pylist() for x in batch.columns)):
                tally[c] += n
        yield _top(tally)

    level = written(texts.mapInArrow(summary, "cut string, n long"), "frequent")
    n = texts.rdd.getNumPartitions()
    while True:
        n = max(1, -(-n // FAN))
        # the parts of one summary may go to several tasks: each cut to one of them, so that its counts are summed
        merged = (level.repartition(n, "cut") if n > 1 else level.coalesce(1)).mapInArrow(merge, "cut string, n long")
        old, level = level, written(merged, "frequent")
        discard(old)
        if n == 1:
            break
    out = [r["cut"] for r in level.collect()]  # FREQUENT rows at most
    discard(level)
    return out


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) for every row of docs.

    Null and empty texts have 0 tokens; special tokens' strings are ordinary text; lone surrogates count as
    question marks; texts of any length are counted whole. Null ids and repeated rows are kept, ids keep their type; other
    columns are not read; an empty table gives no rows. The vocabulary file is
    read by the driver and sent to the executors (under 1 MB), which need not have it; so is the table of frequent
    pre-tokens (under 0.4 MB). Counts are exact but for two cuts of equal length and equal 64-bit hash.
    """
    ranks = Path(vocabulary).read_bytes()
    rows, schema = with_ids(docs, id_col, text_col, "n_tokens long")
    sent = docs.sparkSession.sparkContext.broadcast((ranks, Frequent(frequent_cuts(rows.select("text")), encoder(ranks, pattern))))
    key = ("tokens", vocabulary, pattern, sent._jbroadcast.id() if sent._jbroadcast is not None else id(sent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_cache(key, lambda: Counter(sent.value[0], pattern, sent.value[1]))
        for batch in parts(batches, 1):
            n = [counter.count(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return rows.mapInArrow(run, schema)
