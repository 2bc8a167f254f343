"""Benchmark decontamination by normalised n-grams.

The hashes of the benchmark's word n-grams are broadcast as one set; every document's windows are looked up in it.
Only documents with a hit go on: their hit windows are joined, word by word, with the benchmark's, and the words of
those that are really equal are cut out, or the document goes when they are a large share of it. The benchmark's
texts aren't broadcast, and documents without a hit aren't shuffled.

The set holds 8 bytes for each distinct window up to SET_ROWS of them. A larger benchmark's set is a bitmap of the
hashes' leading bits, which has a fixed size; more windows then prove to be different when they are compared, and the
result is the same.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from .shared import WORD, Words, fold, hashed, mix, parts, words, written

N = 10
#: Items of fewer words than N are matched as a whole; items of fewer than LEAST words are too common to match.
LEAST = 5
MAX_SHARE = 0.5
#: Windows whose whole hashes are broadcast: 128 MB.
SET_ROWS = 16 << 20
#: Leading bits of hashes that a bitmap tells apart beyond that: 128 MB too.
BITMAP_BITS = 30
_BLOCK_BITS = 16
#: Window rows that are handed on at once.
_WINDOW_ROWS = 20_000

_FACTOR = np.uint64(0xD6E8FEB86659FD93)


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """One hash for each window of n consecutive words."""
    out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for j in range(n if len(out) else 0):
        out = out * _FACTOR + hashes[j : j + len(out)]
    return mix(out ^ np.uint64(n))


def nfc(text: str | None) -> str:
    """The text with its accents composed; null is empty."""
    return text if text is not None and (text.isascii() or unicodedata.is_normalized("NFC", text)) else unicodedata.normalize("NFC", text or "")


class HashSet:
    """The benchmark's window hashes: sorted by window length, or a bitmap of the leading bits of all."""

    def __init__(self, sizes: list[int], exact: dict[int, np.ndarray] | None = None, bitmap: np.ndarray | None = None):
        self.sizes, self.exact, self.bitmap = sizes, exact, bitmap
        self.bits = (len(bitmap) * 8).bit_length() - 1 if bitmap is not None else 0

    def hits(self, hashes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(window length, starts of windows that may be in the set, their hashes)"""
        for size in self.sizes:
            w = window_hashes(hashes, size)
            if not len(w):
                continue
            if self.bitmap is None:
                known = self.exact[size]
                hit = np.flatnonzero(known[np.minimum(np.searchsorted(known, w), len(known) - 1)] == w)
            else:
                lead = w >> np.uint64(64 - self.bits)
                hit = np.flatnonzero(self.bitmap[lead >> np.uint64(3)] >> (lead & np.uint64(7)).astype(np.uint8) & np.uint8(1))
            if len(hit):
                yield size, hit, w[hit]


def item_windows(items: DataFrame, n: int, item_id: str, item_text: str) -> DataFrame:
    """(size, hash, words, item) for each distinct window of the benchmark, written: item is the least id that has it."""
    rows = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item"), F.col(item_text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 1):
            ids, out = batch.column(0), []
            for i, text in enumerate(batch.column(1).to_pylist()):
                tokens = words(nfc(text))
                if len(tokens) < LEAST:
                    continue
                size = min(n, len(tokens))
                h = window_hashes(Words([" ".join(tokens)]).hashes, size).astype(np.int64)
                for a in range(0, len(h), _WINDOW_ROWS):
                    at = range(a, min(a + _WINDOW_ROWS, len(h)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), size, np.int32)), pa.array(h[a : at.stop]), pa.array([" ".join(tokens[k : k + size]) for k in at]), pa.array([ids[i].as_py()] * len(at), ids.type)], names=["size", "hash", "words", "item"])

    each = rows.mapInArrow(run, StructType([StructField("size", IntegerType()), StructField("hash", LongType()), StructField("words", StringType()), StructField("item", rows.schema["item"].dataType)]))
    return written(each.groupBy("size", "hash", "words").agg(F.min("item").alias("item")), "item-windows")


def hash_set(known: DataFrame, set_rows: int) -> HashSet:
    """The set for workers. Its size is checked: set_rows hashes, or one bitmap."""
    hashes = known.select("size", "hash").distinct()
    if known.count() <= set_rows:
        table = hashes.toArrow()
        size, h = table.column(0).to_numpy(), table.column(1).to_numpy().astype(np.int64).view(np.uint64)
        exact = {int(x): np.sort(h[size == x]) for x in np.unique(size)}
        return HashSet(sorted(exact), exact)
    lead = F.shiftrightunsigned("hash", 64 - BITMAP_BITS)

    def block(table: pa.Table) -> pa.Table:
        out = np.zeros(1 << _BLOCK_BITS, np.uint8)
        out[table.column("bit").to_numpy()] = 1
        return pa.table({"block": table.column("block")[:1], "bits": pa.array([np.packbits(out, bitorder="little").tobytes()], pa.binary())})

    bits = hashes.select(F.shiftright(lead, _BLOCK_BITS).alias("block"), lead.bitwiseAND(F.lit((1 << _BLOCK_BITS) - 1)).alias("bit")).distinct()
    bitmap = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    # 1 << (BITMAP_BITS - _BLOCK_BITS) rows of 8 KB at most
    for r in bits.groupBy("block").applyInArrow(block, "block long, bits binary").toLocalIterator():
        at = r["block"] << (_BLOCK_BITS - 3)
        bitmap[at : at + (1 << (_BLOCK_BITS - 3))] = np.frombuffer(r["bits"], np.uint8)
    return HashSet(sorted(r[0] for r in hashes.select("size").distinct().collect()), bitmap=bitmap)


def covered_words(n: int, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which of n words lie in a window."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + sizes, -1)
    return np.cumsum(edge)[:n] > 0


def cut(text: str, covered: np.ndarray) -> str:
    """The text without its covered words and what lies between two covered words in a row."""
    out, at, inside = [], 0, False
    for k, m in enumerate(WORD.finditer(fold(text))):
        if covered[k]:
            if not inside:
                out.append(text[at : m.start()])
            at, inside = m.end(), True
        else:
            inside = False
    return "".join([*out, text[at:]])


_MET = [StructField("uid", LongType()), StructField("size", IntegerType()), StructField("start", IntegerType()), StructField("hash", LongType()), StructField("words", StringType())]


def _met(docs: DataFrame, sent, text_col: str) -> DataFrame:
    """For each row with a hit, itself (uid, doc) and its hit windows (uid, size, start, hash, words); written, so that a
    uid stays what it is."""
    names = [f.name for f in _MET]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 33
        for batch in parts(batches, text_col):
            texts = [nfc(t) for t in batch.column(text_col).to_pylist()]
            kind = pa.struct(list(batch.schema))
            rows = pa.StructArray.from_arrays(batch.columns, fields=list(batch.schema))
            for i, hashes, _ in hashed(texts):
                tokens = None
                for size, starts, h in sent.value.hits(hashes):
                    if tokens is None:
                        tokens = words(texts[i])
                        uid += 1
                        yield pa.RecordBatch.from_arrays([pa.array([uid]), *[pa.nulls(1, t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.string())], rows.slice(i, 1)], names=[*names, "doc"])
                    for a in range(0, len(starts), _WINDOW_ROWS):
                        at = starts[a : a + _WINDOW_ROWS]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), uid)), pa.array(np.full(len(at), size, np.int32)), pa.array(at.astype(np.int32)), pa.array(h[a : a + _WINDOW_ROWS].astype(np.int64)), pa.array([" ".join(tokens[k : k + size]) for k in at.tolist()]), pa.nulls(len(at), kind)], names=[*names, "doc"])

    return written(docs.mapInArrow(run, StructType([*_MET, StructField("doc", StructType([StructField(f.name, f.dataType) for f in docs.schema]))])), "met")


def _verified(met: DataFrame, known: DataFrame) -> DataFrame:
    """(doc, starts, sizes, items) for the rows whose windows are really the benchmark's. Lists are as long as a document
    at most."""
    real = met.where("size IS NOT NULL").select("uid", "size", "start", "hash", "words").join(known, ["size", "hash", "words"])
    each = real.groupBy("uid").agg(F.collect_list(F.struct("start", "size")).alias("at"), F.array_sort(F.collect_set("item")).alias("items"))
    return met.where("size IS NULL").select("uid", "doc").join(each, "uid").select("doc", F.col("at.start").alias("starts"), F.col("at.size").alias("sizes"), F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("item_ids"))


def _prepared(items: DataFrame, n: int, item_id: str, item_text: str, set_rows: int):
    known = item_windows(items, n, item_id, item_text)
    return known, items.sparkSession.sparkContext.broadcast(hash_set(known, set_rows))


def contaminated(docs: DataFrame, items: DataFrame, n: int = N, max_share: float = MAX_SHARE, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", set_rows: int = SET_ROWS) -> DataFrame:
    """One row for each row of docs that holds a benchmark n-gram.

    Words are lower-cased runs of letters and digits of the text in Unicode's form NFC. item_ids names, of each window
    that matches, the least id of the items that hold it, in order; n_hits counts matching windows, hit_words the words they
    cover; a document of which more than max_share is covered has action ``drop`` and no clean_text, others
    ``cut`` and the text without those words. Null, empty or wordless texts and items match nothing; items with
    a null id are ignored; an item of LEAST to n - 1 words matches as a whole, shorter ones never. Documents
    with a null id are scanned like others, repeated rows are reported each. Ids keep their types. Other columns are
    not read; an empty table on either side gives no rows.
    """
    known, sent = _prepared(items, n, item_id, item_text, set_rows)
    rows = _verified(_met(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), sent, "text"), known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, starts, sizes in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                text = nfc(text)
                covered = covered_words(len(words(text)), starts.values.to_numpy(), sizes.values.to_numpy())
                hit = int(covered.sum())
                keep = hit <= max_share * len(covered)
                out.append((len(starts.values), hit, len(covered), "cut" if keep else "drop", cut(text, covered) if keep else None))
            n_hits, hit, total, action, clean = zip(*out) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(4), pa.array(n_hits, pa.int32()), pa.array(hit, pa.int32()), pa.array(total, pa.int32()), pa.array(action, pa.string()), pa.array(clean, pa.string())], names=["doc_id", "item_ids", "n_hits", "hit_words", "n_words", "action", "clean_text"])

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.select("doc.doc_id", "doc.text", "starts", "sizes", "item_ids").mapInArrow(run, f"doc_id {kind}, item_ids string, n_hits int, hit_words int, n_words int, action string, clean_text string")


def decontaminated(docs: DataFrame, items: DataFrame, n: int = N, max_share: float = MAX_SHARE, text_col: str = "text", length_col: str | None = "n_chars", item_id: str = "item_id", item_text: str = "text", set_rows: int = SET_ROWS) -> DataFrame:
    """docs with the words found by ``contaminated`` cut out, without the documents it drops; the same columns.

    length_col, if docs has it, gets the new length of changed texts, which are in form NFC. Other rows, null and empty
    texts among them, and columns of any name stay as they are; repeated rows are treated each. An empty table gives no
    rows, an empty benchmark the documents as they are. docs is read twice: once for the few rows with a hit, once for
    the others, so that no row is shuffled that has none.
    """
    length_col = length_col if length_col in docs.columns else None
    known, sent = _prepared(items, n, item_id, item_text, set_rows)

    def clear(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, text_col):
            keep = np.ones(batch.num_rows, bool)
            for i, hashes, _ in hashed([nfc(t) for t in batch.column(text_col).to_pylist()]):
                keep[i] = next(sent.value.hits(hashes), None) is None
            yield batch.filter(pa.array(keep))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new, keep = [], []
            for text, starts, sizes in zip(batch.column("_text").to_pylist(), batch.column("_starts"), batch.column("_sizes")):
                if starts.as_py() is None:
                    new.append(None)
                    keep.append(True)
                    continue
                text = nfc(text)
                covered = covered_words(len(words(text)), starts.values.to_numpy(), sizes.values.to_numpy())
                keep.append(int(covered.sum()) <= max_share * len(covered))
                new.append(cut(text, covered) if keep[-1] else None)
            yield pa.RecordBatch.from_arrays([batch.column("_doc"), pa.array(new, pa.string())], names=["_doc", "_new"]).filter(pa.array(keep, pa.bool_()))

    met = _met(docs, sent, text_col)
    found = met.where("size IS NULL").select("uid", F.col("doc").alias("_doc")).join(
        met.where("size IS NOT NULL").select("uid", "size", "start", "hash", "words").join(known, ["size", "hash", "words"]).groupBy("uid").agg(F.collect_list(F.struct("start", "size")).alias("at")), "uid", "left"
    )
    doc = StructType([StructField(f.name, f.dataType) for f in docs.schema])
    made = found.select("_doc", F.col("_doc")[text_col].cast("string").alias("_text"), F.col("at.start").alias("_starts"), F.col("at.size").alias("_sizes")).mapInArrow(clean, StructType([StructField("_doc", doc), StructField("_new", StringType())]))
    new = {text_col: F.coalesce("_new", F.col("_doc")[text_col])}
    if length_col:
        new[length_col] = F.when(F.col("_new").isNotNull(), F.length("_new")).otherwise(F.col("_doc")[length_col])
    changed = made.select(*[(new[f.name] if f.name in new else F.col("_doc")[f.name]).cast(f.dataType).alias(f.name) for f in docs.schema])
    return docs.mapInArrow(clear, StructType(doc.fields)).unionAll(changed)
