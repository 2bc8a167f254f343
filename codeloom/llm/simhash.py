"""SimHash near-duplicates by deletion-variant signatures.

A signature has 128 bits; bit j is the sign of the sum of a document's signed word weights for j. The
weights are heavy-tailed (an inverse power of an exponential variable drawn from the hash of word and bit,
with rate proportional to the word's length), not +-1: with +-1, a copy with 3 % of its words replaced
differs in about 8 % of the bits, with heavy tails in about 3 %, so that a small radius finds it.

Two signatures within ``max_distance`` bits have, when cut into ``max_distance // 2 + 1`` segments or more, a
segment in which they differ in one bit at most. For each bit of each segment, the segment without that bit is a
key; segments that differ in one bit at most share a key. Signatures are joined on the keys and verified.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import GOLD, discard, hashed, mix, parts, text_hash, with_ids, written

BITS = 128
MAX_DISTANCE = 9
#: Rows removed from the corpus that are sent to all executors; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 4_000_000

#: Seeds of the 32 hashes that give a word 16 bits for each of the signature's bits.
_SEEDS = mix(np.arange(1, BITS // 4 + 1, dtype=np.uint64) * GOLD)
#: Most rows of weights at once.
_ROWS = 8192


@functools.cache
def _heavy() -> np.ndarray:
    """Signed weights by 16 bits: the sign, and the inverse cube of an exponential variable."""
    e = -np.log((np.arange(32768) + 0.5) / 32768)
    return np.concatenate([e**-3, -(e**-3)]).astype(np.float32)


def word_weights(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """One row of BITS signed weights for each word; a word counts by its length, up to 12."""
    h = mix(hashes[:, None] ^ _SEEDS[None, :]).view(np.uint16)
    return _heavy()[h] * (np.minimum(lengths, 12).astype(np.float32) ** 3)[:, None]


def signature_bits(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bits of one text's signature; a word counts once. Words are summed in order of their hashes."""
    u, at = np.unique(hashes, return_index=True)
    n = lengths[at]
    total = np.zeros(BITS, np.float32)
    for i in range(0, len(u), _ROWS):
        total += word_weights(u[i : i + _ROWS], n[i : i + _ROWS]).sum(0)
    return total > 0


def text_signatures(texts: list[str | None]) -> Iterator[tuple[int, bytes]]:
    """(number of the text, 16 bytes) for every text that isn't blank."""
    for i, hashes, lengths in hashed(texts):
        if not len(hashes):
            if not texts[i] or not texts[i].strip():
                continue
            # no word: the text as a whole is the only feature
            hashes, lengths = np.array([text_hash(texts[i].strip())], np.uint64), np.array([1])
        yield i, np.packbits(signature_bits(hashes, lengths)).tobytes()


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, hi, lo) for every row whose id isn't null and whose text isn't blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 1):
            batch = batch.filter(batch.column(0).is_valid())
            found = list(text_signatures(batch.column(1).to_pylist()))
            both = np.frombuffer(b"".join(x for _, x in found), ">i8").astype(np.int64)
            ids = batch.column(0).take(pa.array([i for i, _ in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(both[0::2]), pa.array(both[1::2])], names=["doc_id", "hi", "lo"])

    rows, schema = with_ids(docs, id_col, text_col, "hi long, lo long")
    return rows.mapInArrow(run, schema)


def segments(max_distance: int) -> list[tuple[int, int]]:
    """(first bit, width): as few segments as make one of them differ by one bit at most, three at least, so that
    each fits a number."""
    n = max(3, max_distance // 2 + 1)
    cuts = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _bits(hi: Column, lo: Column, first: int, width: int) -> Column:
    """Bits first.. of the 128, as a non-negative number."""
    mask = (1 << width) - 1
    after = BITS - first - width
    if after >= 64:
        out = F.shiftrightunsigned(hi, after - 64)
    elif after + width <= 64:
        out = F.shiftrightunsigned(lo, after)
    else:
        out = F.shiftleft(hi, 64 - after).bitwiseOR(F.shiftrightunsigned(lo, after))
    return out.bitwiseAND(F.lit(mask))


def pairs(sigs: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """All pairs of distinct signatures within max_distance: (a_hi, a_lo, b_hi, b_lo, distance), each once.

    sigs: distinct (hi, lo). No key has a cap on its partners.
    """
    if not 1 <= max_distance < BITS // 4:
        raise ValueError("max_distance must be 1 to 31")
    segs = segments(max_distance)
    cut = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(width).alias("w"), _bits(F.col("hi"), F.col("lo"), first, width).alias("v")) for s, (first, width) in enumerate(segs)])
    #: A key is segment number, number of the missing bit and the other bits, packed without loss.
    keyed = (
        sigs.select("hi", "lo", F.explode(cut).alias("g"))
        .select("hi", "lo", "g", F.explode(F.sequence(F.lit(0), F.col("g.w") - 1)).alias("p"))
        .selectExpr("shiftleft(CAST(g.s AS BIGINT), 56) | shiftleft(CAST(p AS BIGINT), 40) | (g.v & ~shiftleft(1L, p)) AS key" if max(w for _, w in segs) <= 40 else "xxhash64(g.s, p, g.v & ~shiftleft(1L, p)) AS key", "hi", "lo", "CAST(g.s * 128 + p AS SMALLINT) AS sp")
    )
    packed = max(w for _, w in segs) <= 40
    keyed = keyed.drop("sp") if packed else keyed
    a, b = keyed.alias("a"), keyed.alias("b")
    x_hi, x_lo = F.col("a.hi").bitwiseXOR(F.col("b.hi")), F.col("a.lo").bitwiseXOR(F.col("b.lo"))
    distance = F.bit_count(x_hi) + F.bit_count(x_lo)
    #: Pairs meet under many keys; the first segment with one differing bit at most counts, and there the key without that bit.
    first = F.lit(-1)
    for s, (start, width) in reversed(list(enumerate(segs))):
        d = _bits(x_hi, x_lo, start, width)
        first = F.when(F.bit_count(d) <= 1, F.lit(s * 128) + F.when(d == 0, F.lit(0)).otherwise(F.bit_count(d - 1))).otherwise(first)
    here = F.shiftrightunsigned(F.col("a.key"), 56) * 128 + F.shiftrightunsigned(F.col("a.key"), 40).bitwiseAND(F.lit(127)) if packed else F.col("a.sp")
    ordered = (F.col("a.hi") < F.col("b.hi")) | ((F.col("a.hi") == F.col("b.hi")) & (F.col("a.lo") < F.col("b.lo")))
    on = (F.col("a.key") == F.col("b.key")) & ordered & (distance <= max_distance) & (first == here)
    # the optimiser takes the keys for as small as the signatures; a merge join holds no side in memory
    return a.join(b.hint("merge"), on).select(F.col("a.hi").alias("a_hi"), F.col("a.lo").alias("a_lo"), F.col("b.hi").alias("b_hi"), F.col("b.lo").alias("b_lo"), distance.alias("distance"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (u, v): the least node of its connected component.

    Every round, a node takes the least label among its own, its neighbours' and its label's; labels are
    written to the shared folder after each round, so no lineage grows.
    """
    both = written(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    rounds = written(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("new")), "labels")
    while True:
        labels = rounds.select("node", F.col("new").alias("label"))
        near = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("label").alias("near"))
        up = labels.select(F.col("node").alias("at"), F.col("label").alias("over"))
        new = labels.join(near, labels.node == near.u).join(up, labels.label == up["at"], "left").select("node", F.least("label", "near", "over").alias("new"), F.col("label").alias("old"))
        old, rounds = rounds, written(new, "labels")
        discard(old)
        if not rounds.where("new < old").limit(1).count():
            discard(both)
            return rounds.select("node", F.col("new").alias("label"))


def near_duplicates(docs: DataFrame, max_distance: int = MAX_DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kept_doc_id): the documents that go, each with the one of its group that stays.

    Groups are the connected components of signatures within ``max_distance`` bits; the least id stays.
    Texts with the same set of lower-case words have the same signature and so form a group. Rows with a
    null id, and rows whose text is null, empty or white space, belong to no group. Rows that repeat an id
    are one document: the id is compared by each of its texts, and never listed against itself. Ids keep their
    type, texts of any length are read whole, other columns are not read; an empty table gives no rows.
    """
    sigs = written(signatures(docs, id_col, text_col), "signatures")
    reps = written(sigs.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep")), "representatives")
    near = pairs(reps.select("hi", "lo"), max_distance)
    a, b = reps.select(F.col("hi").alias("a_hi"), F.col("lo").alias("a_lo"), F.col("rep").alias("u")), reps.select(F.col("hi").alias("b_hi"), F.col("lo").alias("b_lo"), F.col("rep").alias("v"))
    edges = near.join(a, ["a_hi", "a_lo"]).join(b, ["b_hi", "b_lo"]).select("u", "v")
    # an id with several texts ties their signatures together
    same = sigs.join(reps, ["hi", "lo"]).select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).where("u <> v")
    labels = components(edges.where("u <> v").unionByName(same))
    discard(sigs, reps)
    return labels.where("node <> label").select(F.col("node").alias("doc_id"), F.col("label").alias("kept_doc_id"))


def without_duplicates(docs: DataFrame, max_distance: int = MAX_DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents less those that ``near_duplicates`` lists; columns stay as they are.

    Of rows that repeat both id and text, one stays; rows with a null id all stay. Only rows whose ids repeat are
    compared by their texts. An empty table stays empty, columns may have any name.
    """
    gone = written(near_duplicates(docs, max_distance, id_col, text_col).select(F.col("doc_id").alias("gone_doc_id")), "duplicates")
    twice = written(docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("twice_doc_id")).count().where("count > 1").select("twice_doc_id"), "repeated-ids")
    n, repeated = gone.count(), twice.count()
    if repeated:
        many = F.broadcast(twice) if repeated <= BROADCAST_ROWS else twice
        docs = docs.join(many, docs[id_col] == many.twice_doc_id, "left_anti").unionByName(docs.join(many, docs[id_col] == many.twice_doc_id, "left_semi").dropDuplicates([id_col, text_col]))
    return docs.join(F.broadcast(gone) if n <= BROADCAST_ROWS else gone, docs[id_col] == gone.gone_doc_id, "left_anti")
