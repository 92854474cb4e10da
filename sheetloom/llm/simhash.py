"""SimHash fingerprints and their near-duplicate groups, by a self-join of the binary trie of fingerprints.

The tries and their units of work are those of ``trie.py``. A unit returns no pairs but a spanning forest of its links, so a dense
group of near copies stays linear.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import materialize
from .trie import join_units

BUDGET, WORDS = 3, 3
NODE_LEAST, NODE_MOST, NODES = 4096, 1 << 18, 12
PIECE = 1 << 16


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64-bit SimHash of the word shingles of a text, as unsigned int."""
    from xxhash import xxh64_intdigest

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: both touch ASCII only
    if not found:
        return 0
    joined = b" ".join(found)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    k = min(words, len(found))
    n = len(found) - k + 1
    first, last = starts[:n].tolist(), ends[k - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for i in range(0, n, PIECE):
        hashes = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(first[i : i + PIECE], last[i : i + PIECE], strict=True)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * counts > n).tolist())


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of every row."""

    def make(batches):
        for b in batches:
            made = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made)], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(make, "doc_id long, fp long")


def _roots(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    r = parent[x]
    while (up := parent[r]).shape and (up != r).any():
        r = up
    return r


def merge_links(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the sets of i and j; a root is the least index of its set."""
    while len(i):
        a, b = _roots(parent, i), _roots(parent, j)
        apart = a != b
        if not apart.any():
            return
        i, j, lo, hi = i[apart], j[apart], np.minimum(a, b)[apart], np.maximum(a, b)[apart]
        np.minimum.at(parent, hi, lo)


def link_fingerprints(classes: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Links (u, v) that connect the nodes of all fingerprints within ``budget`` bits, as forests of the units.

    ``classes`` has fp (distinct) and node (a long that names it); a node of a forest is linked to the least node of its tree.
    """
    most = max(NODE_LEAST, min(NODE_MOST, -(-classes.count() // NODES)))

    def forest(a, b, pairs):
        node = a["node"] if b is None else np.concatenate([a["node"], b["node"]])
        # roots are least indices, so indices must go by node
        by_node = np.argsort(node, kind="stable")
        rank = np.empty_like(by_node)
        rank[by_node] = np.arange(len(node))
        parent, n = np.arange(len(node)), len(a["node"])

        def roots():
            found = _roots(parent, rank)
            return found[:n], found if b is None else found[n:]

        for i, j in pairs(roots):
            merge_links(parent, rank[i], rank[j + (0 if b is None else n)])
        root = _roots(parent, np.arange(len(node)))
        child = np.flatnonzero(root != np.arange(len(node)))
        named = node[by_node]
        return pa.table({"u": pa.array(named[child]), "v": pa.array(named[root[child]])})

    return join_units(classes.select(F.col("fp").alias("fp0"), "node"), 1, budget, most, forest, "u long, v long")


def near_duplicate_groups(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    Rows are linked if their fingerprints differ in at most ``budget`` bits; component_id is the least doc_id that
    links reach. A null text is empty; texts without words have fingerprint zero and are linked like any
    other; repeated rows are kept; rows with a null doc_id take part, and a group of only such rows has a null component_id.
    An empty table gives an empty table.
    """
    prints = materialize(fingerprints(docs), "fingerprints")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("node", F.col("fp")), "fp-classes")
    rooted = components(link_fingerprints(classes.select("fp", "node"), budget))
    root = F.coalesce("root", "node").alias("root")
    named = materialize(classes.join(rooted.withColumnRenamed("node", "at"), F.col("node") == F.col("at"), "left").select(F.col("fp").alias("of_fp"), root, "least"), "fp-roots")
    least = named.groupBy(F.col("root").alias("of_root")).agg(F.min("least").alias("component_id"))
    named = materialize(named.join(least, F.col("root") == F.col("of_root")).select("of_fp", "component_id"), "fp-components")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(named, F.col("fp") == F.col("of_fp")).select("doc_id", hexed, "component_id")
