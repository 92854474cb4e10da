"""Merkle manifest of a table: a digest of every row, trees by source, and a proof for each row that leads to one root.

A tree's nodes are numbered in order; ``LEVELS`` levels at once are collapsed in superblocks of FANOUT**LEVELS consecutive nodes, each a group
of its own, so a source of any size is spread over as many groups as it has superblocks. The superblocks' digests are the next table, a few
hundred times smaller, which is collapsed in the same way until every tree has one node. The sources' roots are then the leaves of one more tree.
Proofs come down the same tables: a node's proof is its siblings within its superblock, then the proof of the superblock itself.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import numbered
from .shared import materialize

FANOUT, LEVELS = 3, 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
HEX = 64  # characters of a digest


def digest(values: list[Column]) -> Column:
    """The digest of a row: its values in turn, each as its UTF-8 bytes' count, a colon and the value, or a dash if it is null."""
    part = lambda v: F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
    return F.sha2(F.concat(*[part(v.cast("string")) for v in values]), 256)


def group_key(source: Column) -> Column:
    """A source as a group without nulls, in the order of the sources' bytes, null first."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def _h(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(digests: list[str], levels: int, fanout: int = FANOUT) -> list[list[str]]:
    """The rows of a tree over ``digests``, from themselves ``levels`` levels up; the last run of a row may be shorter."""
    rows = [digests]
    for _ in range(levels):
        rows.append([_h(rows[-1][a : a + fanout]) for a in range(0, len(rows[-1]), fanout)])
    return rows


def steps(n: int, levels: int, fanout: int = FANOUT) -> int:
    """How many levels a superblock of a tree with ``n`` nodes collapses: ``levels``, or what is left to the one root."""
    k = 0
    while n > 1 and k < levels:
        n, k = -(-n // fanout), k + 1
    return k


def siblings(rows: list[list[str]], at: int, fanout: int = FANOUT) -> tuple[list[str], list[int]]:
    """Level by level the digests of the other nodes of a run, joined, and how many of them stand on the left."""
    proof, place = [], []
    for row in rows[:-1]:
        first = at // fanout * fanout
        proof.append("".join(row[first:at] + row[at + 1 : first + fanout]))
        place.append(at - first)
        at //= fanout
    return proof, place


def fold(leaf: Column, proof: Column, place: Column) -> Column:
    """The root that a leaf's digest and its proof lead to."""
    step = lambda h, s: F.sha2(F.concat(F.substr(s["proof"], F.lit(1), HEX * s["place"]), h, F.substr(s["proof"], HEX * s["place"] + 1)), 256)
    return F.aggregate(F.arrays_zip(proof.alias("proof"), place.alias("place")), leaf, step)


@dataclass
class Trees:
    """The tables of some trees, from the leaves (with further columns) to the top: grp, i, n (nodes of the tree in this table), digest."""

    tables: list[DataFrame]
    levels: int
    fanout: int

    def roots(self) -> DataFrame:
        """grp and digest: a row a tree."""
        found = [t.where("n = 1").select("grp", "digest") for t in self.tables]
        whole = found[0]
        for t in found[1:]:
            whole = whole.unionAll(t)
        return whole

    def proofs(self, tops: DataFrame, carry: list[str]) -> DataFrame:
        """grp, digest (hex), proof and place of every leaf, with the columns ``carry`` of the leaves and of ``tops``.

        ``tops`` has grp, proof and place, what leads on from each tree's root, and ``carry_top`` columns; they come down with the proofs.
        """
        further = [c for c in tops.columns if c not in ("grp", "i", "proof", "place")]
        above = tops.withColumn("i", F.lit(0).cast("long"))
        for k in range(len(self.tables) - 1, -1, -1):
            at_top = self.tables[k].where("n = 1")
            own = [] if k else carry
            ended = at_top.select("grp", "i", "digest", *own).join(tops, "grp")
            below = self._down(self.tables[k].where("n > 1"), above, own, further)
            columns = ["grp", "i", *(["digest", *own] if not k else []), "proof", "place", *further]
            below = below.select(*columns).unionAll(ended.withColumn("digest", F.lower(F.hex("digest"))).select(*columns))
            above = materialize(below, "proofs") if k else below
        return above.drop("i")

    def _down(self, nodes: DataFrame, above: DataFrame, own: list[str], further: list[str]) -> DataFrame:
        levels, fanout = self.levels, self.fanout
        block = fanout**levels

        def run(pdf: pd.DataFrame, up: pd.DataFrame) -> pd.DataFrame:
            if pdf.empty:
                return pd.DataFrame(columns=names)
            pdf = pdf.sort_values("i")
            digests = [x.hex() for x in pdf["digest"]]
            rows = climb(digests, steps(int(pdf["n"].iloc[0]), levels, fanout), fanout)
            top_proof, top_place = list(up["up_proof"].iloc[0]), list(up["up_place"].iloc[0])
            made = [siblings(rows, k, fanout) for k in range(len(digests))]
            out = pdf[["grp", "i", *own]].assign(digest=digests, proof=[p + top_proof for p, _ in made], place=[x + top_place for _, x in made])
            for c in further:
                out[c] = up[f"up_{c}"].iloc[0]
            return out[names]

        kinds = {f.name: f.dataType.simpleString() for f in [*nodes.schema.fields, *above.schema.fields]} | {"digest": "string", "proof": "array<string>", "place": "array<int>"}
        names = ["grp", "i", "digest", *own, "proof", "place", *further]
        schema = ", ".join(f"`{c}` {kinds[c]}" for c in names)
        left = nodes.select("grp", "i", "n", "digest", *own, F.floor(F.col("i") / block).cast("long").alias("block"))
        right = above.select(F.col("grp").alias("up_grp"), F.col("i").alias("up_block"), *[F.col(c).alias(f"up_{c}") for c in ("proof", "place", *further)])
        return left.groupBy("grp", "block").cogroup(right.groupBy("up_grp", "up_block")).applyInPandas(run, schema)


def grow(leaves: DataFrame, levels: int = LEVELS, fanout: int = FANOUT) -> Trees:
    """The trees over ``leaves``: grp (a string without nulls), i, n and digest (binary); further columns stay with the leaves."""
    block, tables = fanout**levels, [leaves]

    def collapse(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        n = int(pdf["n"].iloc[0])
        top = climb([x.hex() for x in pdf["digest"]], steps(n, levels, fanout), fanout)[-1]
        return pd.DataFrame({"grp": pdf["grp"].iloc[:1], "i": pdf["i"].iloc[:1] // block, "n": [-(-n // block)], "digest": [bytes.fromhex(top[0])]})

    while True:
        more = tables[-1].where("n > 1")
        if more.isEmpty():
            return Trees(tables, levels, fanout)
        nodes = more.select("grp", "i", "n", "digest", F.floor(F.col("i") / block).cast("long").alias("block"))
        tables.append(materialize(nodes.groupBy("grp", "block").applyInPandas(collapse, "grp string, i long, n long, digest binary"), "superblocks"))


def with_proofs(rows: DataFrame, leaf: Column, group: Column, order: list[Column], carry: dict[str, Column] | None = None, levels: int = LEVELS, fanout: int = FANOUT) -> tuple[DataFrame, str | None]:
    """Every row's leaf digest, subroot (that of its group), proof and place, with the columns ``carry``; and the root, None of an empty table.

    ``proof`` holds level by level the siblings' digests, joined; ``place`` says how many of them stand on the left. Rows of a group are leaves in
    the given order and then by digest, so repeated rows are leaves beside each other.
    """
    carry = carry or {}
    named = rows.select(group.alias("grp"), F.unhex(leaf).alias("digest"), *[c.alias(f"order_{k}") for k, c in enumerate(order)], *[c.alias(k) for k, c in carry.items()])
    placed = numbered(materialize(named, "leaves"), [*[F.col(f"order_{k}") for k in range(len(order))], F.col("digest")], "grp", "leaves")
    trees = grow(materialize(placed.select("grp", "i", "n", "digest", *carry), "leaves"), levels, fanout)
    subroots = materialize(trees.roots(), "subroots")
    over = numbered(subroots.select(F.lit("").alias("all"), "grp", "digest"), [F.col("grp")], "all", "subroots")
    whole = grow(materialize(over.select(F.col("all").alias("grp"), F.col("grp").alias("of"), "i", "n", "digest"), "subroots"), levels, fanout)
    top = whole.roots().first()
    nothing = whole.roots().select("grp", F.array().cast("array<string>").alias("proof"), F.array().cast("array<int>").alias("place"))
    above = materialize(whole.proofs(nothing, ["of"]).select(F.col("of").alias("grp"), F.col("digest").alias("subroot"), "proof", "place"), "proofs")
    return trees.proofs(above, list(carry)).withColumnRenamed("digest", "leaf"), top.digest.hex() if top else None


def manifest(docs: DataFrame, levels: int = LEVELS, fanout: int = FANOUT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every document.

    Leaves are digests of ``FIELDS``; per source they ascend by doc_id, a null id first, rows with equal ids by digest. ``folded_root`` is what the leaf and
    its proof lead to, where the leaf is made anew from the row as a reader would find it: for documents whose id has an even checksum
    its text has lost its line breaks, so it verifies only if it had none. A null text stays null, a row with a null id is not tampered with,
    repeated rows are leaves of their own, an empty table gives an empty table, and further columns don't count.
    """
    fields = [F.col(c) for c in FIELDS]
    text = F.col("text").cast("string")
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    forged = F.when(even & (F.instr(text, "\n") > 0), F.unhex(digest([*fields[:-1], F.replace(text, F.lit("\n"), F.lit(""))])))
    rows, root = with_proofs(docs, digest(fields), group_key(F.col("source")), [F.col("doc_id")], {"doc_id": F.col("doc_id").cast("long"), "forged": forged}, levels, fanout)
    folded = rows.withColumn("folded_root", fold(F.coalesce(F.lower(F.hex("forged")), F.col("leaf")), F.col("proof"), F.col("place")))
    return folded.select(
        "doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"), F.sha2(F.array_join("proof", ""), 256).alias("proof_sha256"), "folded_root",
        F.coalesce(F.col("folded_root") == F.lit(root), F.lit(False)).alias("verified"),
    )
