"""Mixing sources to target weights by pivotal dependent rounding.

A document of source s is due to appear c = budget * weight(s) / size(s) times on average. Its whole copies
are certain; the fractions are rounded together by the pivotal method: two fractions meet, and mass moves at
random between them until one of them is 0 or 1, with chances that keep both expectations. So every fraction
is rounded up with exactly its probability, and a source's number of copies is its sum of fractions rounded
up or down.

Documents meet within leaves (a source's documents by hash of their id and text), in order of id; what is left of each
leaf, one fraction at most, meets again in the next level of a reduction tree, until one is left for a source.
Leaves and random numbers depend on ids, texts and the seed only, not on partitions, so a task that is run again
decides as before. Only ids, sources, lengths and hashes are shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Documents of a source that meet in one leaf, on average.
LEAF = 20_000
#: Residuals that meet in one node of the tree.
FAN = 512
#: Sources' sizes are raised to this power for the default weights, so that small sources count for more.
POWER = 0.7


def pivotal(p: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """(p with all but one at most rounded to 0 or 1, where the one that's left is, or -1)."""
    out = p.astype(float).copy()
    u = rng.random((len(p), 2))
    at = -1
    for i in range(len(out)):
        b = out[i]
        if b < EXACT or b > 1 - EXACT:
            out[i] = round(b)
            continue
        if at < 0:
            at = i
            continue
        a = out[at]
        total = a + b
        if total < 1:
            # one of them gives all its mass to the other
            if u[i, 0] * total < a:
                out[at], out[i] = total, 0.0
            else:
                out[at], out[i] = 0.0, total
                at = i
        elif u[i, 0] * (2 - total) < 1 - b:
            out[at], out[i] = 1.0, total - 1
            at = i
        else:
            out[at], out[i] = total - 1, 1.0
        if at >= 0 and (out[at] < EXACT or out[at] > 1 - EXACT):
            out[at] = round(out[at])
            at = -1
    return out, at


#: Fractions nearer to 0 or 1 are whole.
EXACT = 1e-9


def _generator(seed: int, level: int, source: str | None, node: int) -> np.random.Generator:
    name = b"\0" if source is None else b"\1" + source.encode("utf-8", "surrogatepass")
    return np.random.default_rng([seed, level, node & 0xFFFFFFFF, *name])


def expected(docs: DataFrame, weights: Mapping[str, float] | None = None, epochs: float = 1.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, expected, n, salt): how often each row is due to appear, its source's number of rows, and a hash of
    its text.

    Sizes are counted in characters of whole texts over all rows, and the budget is ``epochs`` times their sum.
    weights give each source its share of the budget, in proportion; sources that they lack get none. Without
    weights, a source counts by its size to the power of POWER. Null is a source of its own, with a share by
    default only. Null and empty texts have no size: they are due as often as the rest of their source.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.lit(5), text_col).alias("salt"))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(POWER)))
    else:
        if any(w < 0 for w in weights.values()):
            raise ValueError("weights can't be negative")
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "of string, weight double")
        sizes = sizes.join(given, sizes.source == given.of, "left").drop("of").fillna(0.0, ["weight"])
    sizes = written(sizes, "source-sizes")
    total = sizes.agg(F.sum("size").alias("size"), F.sum(F.when(F.col("size") > 0, F.col("weight"))).alias("weight")).first()
    budget, all_weights = epochs * (total["size"] or 0), total["weight"] or 1.0
    due = sizes.select(F.col("source").alias("of"), F.col("n"), F.when(F.col("size") > 0, F.lit(budget) * F.col("weight") / F.lit(all_weights) / F.col("size")).otherwise(F.lit(0.0)).alias("expected"))
    return rows.join(due, rows.source.eqNullSafe(due.of)).select("doc_id", "source", "expected", "n", "salt")


def _tree_node(seed: int, level: int, last: bool):
    """One node of the reduction tree; the last level decides about the one fraction that is left."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("leaf").reset_index(drop=True)
        rng = _generator(seed, level, None if pd.isna(key[0]) else key[0], int(key[1]))
        p, at = pivotal(pdf["rest"].to_numpy(), rng)
        if last and at >= 0:
            p[at], at = float(rng.random() < p[at]), -1
        out = pd.DataFrame({"source": pdf["source"], "leaf": pdf["leaf"], "node": np.int32(key[1]), "rest": p, "leaves": pdf["leaves"], "open": np.arange(len(p)) == at})
        return out[out["open"] | (out["rest"] > 0.5)]

    return run


def copies(due: DataFrame, seed: int = 0) -> DataFrame:
    """(doc_id, source, copies) from (doc_id, source, expected, n, salt), n being the source's number of rows.

    Rows that repeat a document's id, source and salt are rounded one by one, in no order among themselves; ids may
    be null: the salt, a hash of the text, parts rows without an id, or with a common one, between leaves. expected may
    differ between a source's rows.
    """
    leaf = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "salt"), F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n") / F.lit(LEAF)))).cast("int")
    rows = due.select("doc_id", "source", "expected", "salt", leaf.alias("leaf"), F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n") / F.lit(LEAF))).alias("leaves"))

    def round_leaf(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "expected", "salt"], na_position="first", kind="stable").reset_index(drop=True)
        whole = np.floor(pdf["expected"].to_numpy() + EXACT)
        source = None if pd.isna(key[0]) else key[0]
        p, at = pivotal(np.clip(pdf["expected"].to_numpy() - whole, 0, 1), _generator(seed, 0, source, int(key[1])))
        left = np.zeros(len(p))
        if at >= 0:
            left[at], p[at] = p[at], 0.0
        return pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "leaf": pdf["leaf"], "leaves": pdf["leaves"], "copies": (whole + p).astype("int64"), "rest": left})

    first = written(rows.groupBy("source", "leaf").applyInPandas(round_leaf, f"doc_id {due.schema['doc_id'].dataType.simpleString()}, source string, leaf int, leaves long, copies long, rest double"), "leaves")
    #: One row at most for each leaf: its number is the residual's name all the way up.
    node = first.where("rest > 0").select("source", "leaf", F.col("leaf").alias("node"), "rest", "leaves")
    most = first.agg(F.max("leaves")).first()[0] or 1
    decided, level = [], 0
    while True:
        level += 1
        last = most <= FAN**level

        up = node.withColumn("node", F.expr(f"CAST(node DIV {FAN} AS INT)")).groupBy("source", "node").applyInPandas(_tree_node(seed, level, last), "source string, leaf int, node int, rest double, leaves long, open boolean")
        up = written(up, "residuals")
        decided.append(up.where("NOT open").select("source", "leaf", F.lit(1).alias("more")))
        node = up.where("open").drop("open")
        if last:
            break
    more = decided[0]
    for d in decided[1:]:
        more = more.unionByName(d)
    more = more.select(F.col("source").alias("of"), F.col("leaf").alias("at"), "more")
    return (
        first.join(more, first.source.eqNullSafe(more.of) & (first.leaf == more["at"]) & (first.rest > 0), "left")
        .select("doc_id", "source", (F.col("copies") + F.coalesce("more", F.lit(0))).cast("int").alias("copies"))
    )


def mixture(docs: DataFrame, weights: Mapping[str, float] | None = None, epochs: float = 1.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, copies) for every row of docs: how often the mixture holds it, 0 included.

    See ``expected`` for sizes, weights and null, ``copies`` for repeated rows. An empty table gives no rows;
    other columns are not read.
    """
    return copies(expected(docs, weights, epochs, id_col, text_col, source_col), seed)
