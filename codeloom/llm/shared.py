"""What several corpus operators need: the shared folder, worker caches, word hashing."""

from __future__ import annotations

import ctypes
import functools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, scratch, shared_dir, written  # noqa: F401

#: A word is a run of letters and digits; the same class is ``[\p{L}\p{N}]+`` in SQL.
WORD = re.compile(r"[^\W_]+")

GOLD = np.uint64(0x9E3779B97F4A7C15)

#: Characters that one vectorised step takes at most, so that a batch of very long texts needs no more memory than a usual one.
STEP_CHARS = 300_000
#: Bytes of text that are taken from an Arrow batch at once.
PART_BYTES = 4 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, elementwise; the argument is overwritten."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_hash(text: str, seed: int = 0) -> int:
    """64-bit hash of any string, lone surrogates included."""
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed)


def words(text: str | None) -> list[str]:
    """Lower-case words of a text; null has none."""
    return WORD.findall(fold(text)) if text else []


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Which code points are letters or digits, and a random odd factor for each place in a word."""
    alnum = np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)
    return alnum, mix(np.arange(1, 4097, dtype=np.uint64) * GOLD) | np.uint64(1)


class Words:
    """The words of some texts in arrays: 64-bit hashes, lengths, characters, and where each text's words begin.

    ``hashes[splits[i]:splits[i + 1]]`` are the words of text i, in order; ``codes`` are all characters, a line
    break between texts, and ``starts`` the words' places among them.
    """

    def __init__(self, texts: list[str | None]):
        alnum, factors = _tables()
        low = [fold(t) if t else "" for t in texts]
        codes = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
        is_word = alnum[codes]
        edge = np.diff(is_word.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        starts = np.flatnonzero(edge == 1)
        self.starts, self.codes = starts, codes
        self.lengths = np.flatnonzero(edge == -1) - starts
        self.first = np.cumsum(self.lengths) - self.lengths
        self.chars = codes[is_word]
        if len(starts):
            place = np.arange(len(self.chars)) - np.repeat(self.first, self.lengths)
            terms = (self.chars.astype(np.uint64) + np.uint64(0x1000003)) * factors[place & 4095]
            self.hashes = mix(np.add.reduceat(terms, self.first) + self.lengths.astype(np.uint64) * GOLD)
        else:
            self.hashes = np.zeros(0, np.uint64)
        begin = np.cumsum([0, *(len(t) + 1 for t in low)])
        self.splits = np.searchsorted(starts, begin)


    def subwords(self, pick: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of the n-grams of least to most characters of the picked words with their two ends marked, the
        number within pick of each one's word); sorted by word only within an order."""
        n = self.lengths[pick] + 2
        begin = np.cumsum(n) - n
        total = int(n.sum())
        marked = np.empty(total, np.uint64)
        inner = np.ones(total, bool)
        inner[begin] = inner[begin + n - 1] = False
        marked[begin], marked[begin + n - 1] = 1, 2
        place = np.arange(int((n - 2).sum())) - np.repeat(np.cumsum(n - 2) - (n - 2), n - 2)
        marked[inner] = self.chars[np.repeat(self.first[pick], n - 2) + place] + np.uint64(3)
        owner = np.repeat(np.arange(len(pick)), n)
        left = np.repeat(begin + n, n) - np.arange(total)
        h, hashes, owners = np.zeros(total, np.uint64), [], []
        for order in range(1, most + 1):
            h = h[: total - order + 1] * np.uint64(0xD6E8FEB86659FD93) + marked[order - 1 :]
            if order >= least:
                ok = left[: len(h)] >= order
                hashes.append(mix(h[ok] ^ np.uint64(order)))
                owners.append(owner[: len(h)][ok])
        return np.concatenate(hashes), np.concatenate(owners)


def fold(text: str) -> str:
    """Lower case, character by character where that would change the length: offsets stay valid."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(x := c.lower()) != 1 else x for c in text)


def pieces(text: str, most: int = STEP_CHARS) -> list[str]:
    """A text cut between words into pieces of about ``most`` characters; joined they are the text."""
    out, at = [], 0
    while len(text) - at > most:
        end = at + most
        while end < len(text) and text[end].isalnum() and text[end - 1].isalnum():
            end += 1
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def hashed(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the text, hashes of its words, their lengths) for each text, whatever its length."""
    for start, end in steps(texts):
        if end - start == 1 and texts[start] and len(texts[start]) > STEP_CHARS:
            parts = [Words([p]) for p in pieces(texts[start])]
            yield start, np.concatenate([w.hashes for w in parts]), np.concatenate([w.lengths for w in parts])
            continue
        w = Words(texts[start:end])
        for i in range(start, end):
            a, b = w.splits[i - start], w.splits[i - start + 1]
            yield i, w.hashes[a:b], w.lengths[a:b]


_caches: dict[object, object] = {}


def worker_cache(key: object, make):
    """What make() returned for this key in this Python worker before; the last few keys are kept."""
    if key not in _caches:
        while len(_caches) >= 8:
            _caches.pop(next(iter(_caches)))
        _caches[key] = make()
    return _caches[key]


def steps(texts: list[str | None], most: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts with at most ``most`` characters each, or one text."""
    start = total = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)


def release() -> None:
    """Gives memory that isn't used back to the system: a worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def parts(batches: Iterable[pa.RecordBatch], text: int | str, most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in order, in batches with at most ``most`` bytes in the text column, or of one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        total, start = np.cumsum(sizes, dtype=np.int64), 0
        while start < batch.num_rows:
            done = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, done + most, "right")))
            yield batch.slice(start, end - start)
            start = end
        if not batch.num_rows:
            yield batch
        release()


#: Labels that a classifier learns, those with the most rows.
MOST_LABELS = 1000


def sampled(rows: DataFrame, group: str, per_group: int) -> DataFrame:
    """About per_group distinct rows of each value of ``group``, chosen by a hash of the whole row; twice as many at
    most in all, those of the least hashes.

    The only bounded read in this subpackage: it gives classifiers their labelled rows. Of more than MOST_LABELS
    values, those with the fewest rows are left out.
    """
    counts = {r[0]: r[1] for r in rows.where(F.col(group).isNotNull()).groupBy(group).count().orderBy(F.desc("count"), group).limit(MOST_LABELS).collect()}
    if not counts:
        return rows.limit(0)
    share = F.create_map(*[F.lit(x) for g, n in counts.items() for x in (g, per_group / n)])
    chance = F.xxhash64(F.lit(7), *rows.columns)
    chosen = rows.where(F.col(group).isin(list(counts)) & (F.pmod(chance, F.lit(1_000_003)) / F.lit(1_000_003.0) < F.element_at(share, F.col(group))))
    return chosen.distinct().orderBy(chance).limit(2 * per_group * len(counts))


def with_ids(docs: DataFrame, id_col: str, text_col: str, fields: str) -> tuple[DataFrame, str]:
    """(doc_id, text) of docs, the id in its own type, and the schema of a result with that id and other fields."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {fields}"


def found_rows(ids: pa.Array, rows: Iterable[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    """Rows (place in ids, *fields) as an Arrow batch with the ids at these places."""
    at, *cols = list(zip(*rows)) or [()] * (len(fields) + 1)
    return pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, (_, t) in zip(cols, fields)]], names=["doc_id", *[n for n, _ in fields]])


def batch_of(rows: Iterable[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """Rows of tuples as an Arrow batch."""
    cols = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def replace_column(batch: pa.RecordBatch, name: str, values: list) -> pa.RecordBatch:
    """The batch with other values in one column."""
    i = batch.schema.get_field_index(name)
    return batch.set_column(i, batch.schema.field(i), pa.array(values, batch.schema.field(i).type))
