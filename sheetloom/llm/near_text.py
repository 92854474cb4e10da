"""Near-duplicate texts: SimHash fingerprints of word shingles, joined in binary tries, and each candidate checked on its whole text.

Texts whose sets of shingles have a similarity (Jaccard) of four fifths have an angle of 27 degrees between their sets, so about 10 of
64 bits of a fingerprint apart. A text has two fingerprints, and a pair within ``BUDGET`` bits in either of them is a candidate
if the sizes of the sets allow the similarity. A candidate is a link only if the whole sets are alike.

A dense group's candidates are not all checked: first every text with the one that has most candidates beside it, and once
those links are known, candidates of different components only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import boxed, discard, materialize, unboxed, unheld
from .trie import join_units

WORDS = 5
#: The least similarity, as a fraction.
ALIKE, OF = 4, 5
PRINTS, BUDGET = 2, 11
#: A text with more candidates in a unit than this gives only the first of them at once.
CROWD = 16
NODE_LEAST, NODE_MOST, NODES = 4096, 1 << 20, 4
PIECE, HELD_PAIRS = 1 << 16, 1 << 22
#: Longs of a set's parity bitmap.
BITMAP = 32
_SALTS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
_MIX, _LAST = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; a text of fewer words is one shingle, one without words has none."""
    from xxhash import xxh64_intdigest

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    known = {w: xxh64_intdigest(w, 42) for w in set(found)}
    codes = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    k = min(words, len(found))
    keys = np.full(len(found) - k + 1, k, np.uint64)
    for i in range(k):
        keys = (keys ^ codes[i : i + len(keys)]) * _MIX
        keys ^= keys >> np.uint64(29)
    return np.unique((keys * _LAST) ^ (keys >> np.uint64(32)))


def set_key(members: np.ndarray) -> int:
    """What names a set: a signed 64-bit hash of its members."""
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(members.tobytes(), 7)).view(np.int64))


def set_prints(members: np.ndarray) -> list[int]:
    """``PRINTS`` signed fingerprints of a set: a bit is 1 if set in over half the members' hashes."""
    made = []
    for salt in _SALTS[:PRINTS]:
        counts = np.zeros(64, np.int64)
        for i in range(0, len(members), PIECE):
            x = (members[i : i + PIECE] ^ salt) * _LAST
            x = (x ^ (x >> np.uint64(31))) * _MIX
            bits = np.unpackbits((x ^ (x >> np.uint64(29))).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.uint32)
        made.append(int(np.packbits(2 * counts > len(members), bitorder="little").view(np.int64)[0]))
    return made


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return OF * both >= ALIKE * (len(a) + len(b) - both)


def bitmap(members: np.ndarray) -> np.ndarray:
    """The parity of the members at each of 64 * ``BITMAP`` bits, as signed longs: two sets have at least as many members apart as their bitmaps have bits."""
    counts = np.bincount((members >> np.uint64(7)).astype(np.int64) % (64 * BITMAP), minlength=64 * BITMAP)
    return np.packbits(counts & 1, bitorder="little").view(np.int64)


def text_id(text) -> object:
    return F.xxhash64(text.cast("string"))


def _prints(docs: DataFrame) -> DataFrame:
    """doc_id, text_id, key, n (size) and fingerprints of the set of every row."""
    names = [f"fp{k}" for k in range(PRINTS)]

    def make(batches):
        unheld()
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                b = whole.slice(i, 1024)
                sets = [shingle_set(t) for t in b.column(2).to_pylist()]
                prints = zip(*[set_prints(s) for s in sets], strict=True)
                made = [[set_key(s) for s in sets], [len(s) for s in sets], *prints]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(x, pa.int64()) for x in made]], ["doc_id", "text_id", "key", "n", *names])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_id(F.col("text")).alias("text_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(make, "doc_id long, text_id long, key long, n long, " + ", ".join(f"{c} long" for c in names))


def _fitting(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can be alike."""
    return ALIKE * np.maximum(x, y) <= OF * np.minimum(x, y)


def _sides(a: dict, b: dict | None, pairs, keep):
    """The nodes of a unit by column, and a generator of its pairs (as indices of nodes) that fit and that ``keep`` lets through."""
    nodes = {c: a[c] if b is None else np.concatenate([a[c], b[c]]) for c in a}
    shift = 0 if b is None else len(a["key"])

    def found():
        for i, j in pairs():
            j = j + shift
            left = (nodes["key"][i] != nodes["key"][j]) & _fitting(nodes["n"][i], nodes["n"][j]) & keep(nodes, i, j)
            if left.any():
                yield i[left], j[left]

    return nodes, found


def _ordered(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.minimum(x, y), np.maximum(x, y)


def _meet(a: dict, b: dict | None, pairs) -> pa.Table:
    """(u, v, first): candidates of a unit, ``first`` those of a node with its neighbour of most candidates; (u, null, false) for a node in a crowd.

    Pairs of two nodes of a crowd are left out but for the first ones.
    """
    nodes, found = _sides(a, b, pairs, lambda nodes, i, j: True)
    key, held, size = nodes["key"], [], 0
    degree = np.zeros(len(key), np.int64)
    for i, j in found():
        degree += np.bincount(i, minlength=len(key)) + np.bincount(j, minlength=len(key))
        size += len(i)
        if size <= HELD_PAIRS:
            held.append((i, j))
    again = (lambda: iter(held)) if size <= HELD_PAIRS else found
    # of the neighbours with most candidates the one of the least key
    rank = np.empty(len(key), np.int64)
    rank[np.lexsort((-key, degree))] = np.arange(len(key))
    hub, us, vs = np.full(len(key), -1, np.int64), [], []
    by_rank = np.argsort(rank)
    for i, j in again():
        np.maximum.at(hub, i, rank[j])
        np.maximum.at(hub, j, rank[i])
        sparse = np.minimum(degree[i], degree[j]) <= CROWD
        us.append(key[i[sparse]])
        vs.append(key[j[sparse]])
    own = np.flatnonzero(hub >= 0)
    crowd = key[degree > CROWD]
    first = _ordered(key[own], key[by_rank[hub[own]]])
    rest = _ordered(np.concatenate(us), np.concatenate(vs)) if us else (key[:0], key[:0])
    flags = np.repeat([True, False], [len(first[0]), len(rest[0]) + len(crowd)])
    v = pa.concat_arrays([pa.array(first[1], pa.int64()), pa.array(rest[1], pa.int64()), pa.nulls(len(crowd), pa.int64())])
    return pa.table({"u": pa.array(np.concatenate([first[0], rest[0], crowd]), pa.int64()), "v": v, "first": pa.array(flags)})


def _meet_across(a: dict, b: dict | None, pairs) -> pa.Table:
    """(u, v): the candidates of a unit between nodes of different roots, without those that are not alike by their bitmaps."""
    nodes, found = _sides(a, b, pairs, lambda nodes, i, j: nodes["root"][i] != nodes["root"][j])
    key, n = nodes["key"], nodes["n"]
    bits = np.stack([nodes[f"bits{k}"] for k in range(BITMAP)], axis=1).view(np.uint64)
    made = []
    for i, j in found():
        for at in range(0, len(i), PIECE):
            x, y = i[at : at + PIECE], j[at : at + PIECE]
            apart = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
            near = (OF + ALIKE) * apart <= (OF - ALIKE) * (n[x] + n[y])
            made.append(_ordered(key[x[near]], key[y[near]]))
    u, v = (np.concatenate([x[k] for x in made]) if made else key[:0] for k in (0, 1))
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _joined(classes: DataFrame, work, schema: str) -> DataFrame:
    most = max(NODE_LEAST, min(NODE_MOST, -(-classes.count() // NODES)))
    return join_units(classes, PRINTS, BUDGET, most, work, schema)


def _of_sets(docs: DataFrame, texts: DataFrame, keys: DataFrame, made, columns: str) -> DataFrame:
    """key and ``columns``, which ``made`` gives for a list of sets; the sets are made again, for one text of each key in ``keys``."""
    names = ["key", *(c.split()[0] for c in columns.split(", "))]

    def make(batches):
        unheld()
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                sets = [shingle_set(t) for t in whole.column(0).slice(i, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.int64()), *made(sets)], names)

    wanted = materialize(texts.join(keys, "key", "left_semi").select(F.col("text_id").alias("of_text")).distinct(), "wanted-texts")
    rows = docs.select(F.col("text").cast("string").alias("text"), text_id(F.col("text")).alias("own_text"))
    rows = rows.join(wanted, F.col("own_text") == F.col("of_text"), "left_semi").select("text")
    return rows.mapInArrow(make, f"key long, {columns}").dropDuplicates(["key"])


def _checked(docs: DataFrame, texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (u, v) whose whole sets are alike; sets are made again, for one text of each key in a pair."""

    def check(batches):
        for b in batches:
            each = zip(b.column(2), b.column(3), strict=True)
            good = [alike(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in each]
            yield pa.RecordBatch.from_arrays([b.column(k).filter(pa.array(good, pa.bool_())) for k in range(2)], ["u", "v"])

    ends = pairs.select(F.col("u").alias("key")).unionAll(pairs.select(F.col("v").alias("key"))).distinct()
    made = lambda sets: [pa.array([s.tobytes() for s in sets], pa.binary())]
    sets = materialize(_of_sets(docs, texts, ends, made, "members binary"), "paired-sets")
    half = materialize(pairs.join(sets.toDF("ku", "mu"), F.col("u") == F.col("ku")).select("u", "v", "mu"), "half-pairs")
    both = half.join(sets.toDF("kv", "mv"), F.col("v") == F.col("kv")).select("u", "v", "mu", "mv")
    good = materialize(both.mapInArrow(check, "u long, v long"), "alike")
    for x in (sets, half):
        discard(x)
    return good


def _with_roots(nodes: DataFrame, rooted: DataFrame) -> DataFrame:
    return nodes.join(rooted.toDF("of_node", "of_root"), F.col("key") == F.col("of_node"), "left").withColumn("root", F.coalesce("of_root", "key")).drop("of_node", "of_root")


def near_text_groups(docs: DataFrame) -> DataFrame:
    """doc_id, text_id (a hash of the text) and component of every row: rows with equal sets of shingles, or alike ones that are candidates, are linked.

    Texts without words have the empty set; repeated rows are kept; an empty table gives an empty table.
    """
    prints = materialize(_prints(docs), "prints")
    fps = [f"fp{k}" for k in range(PRINTS)]
    one = materialize(prints.select(*fps, "key", "n", "text_id").dropDuplicates(["key"]), "classes")  # a key is of one set, whichever text
    classes, texts = one.select(*fps, "key", "n"), one.select("key", "text_id")
    met = materialize(_joined(classes, _meet, "u long, v long, first boolean"), "met")
    pairs = materialize(met.where("v is not null").groupBy("u", "v").agg(F.max("first").alias("first")), "pairs")
    links = _checked(docs, texts, pairs.where("first").select("u", "v"))
    rooted = materialize(components(links), "rooted")
    # what is left: the other pairs, and those of two nodes of a crowd, where the ends are not of one component yet
    left = _with_roots(_with_roots(pairs.where("not first").withColumnRenamed("u", "key"), rooted).withColumnsRenamed({"key": "u", "root": "root_u", "v": "key"}), rooted)
    left = left.where("root <> root_u").select("u", F.col("key").alias("v"))
    crowd = met.where("v is null").select(F.col("u").alias("of_crowd")).distinct()
    crowd = materialize(_with_roots(classes.join(crowd, F.col("key") == F.col("of_crowd"), "left_semi"), rooted), "crowd")
    if not crowd.isEmpty():
        made = lambda sets: [pa.array(x, pa.int64()) for x in np.stack([bitmap(s) for s in sets], axis=1)]
        bitmaps = _of_sets(docs, texts, crowd.select("key"), made, ", ".join(f"bits{k} long" for k in range(BITMAP)))
        left = left.unionAll(_joined(materialize(crowd.join(bitmaps, "key"), "crowd"), _meet_across, "u long, v long")).distinct()
    left = materialize(left.join(pairs.where("first"), ["u", "v"], "left_anti"), "left-pairs")
    if not left.isEmpty():
        rooted = materialize(components(links.unionAll(_checked(docs, texts, left))), "rooted")
    joined = prints.select("doc_id", "text_id", "key").join(rooted, F.col("key") == F.col("node"), "left")
    return joined.select("doc_id", "text_id", F.coalesce("root", "key").alias("component"))


def keep_one(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each component of ``groups`` the least (doc_id, text_id), once; a null doc_id comes last.

    A row is named by its id and text, so of rows that share an id only those go whose own text is in a group with a lesser one.
    """
    named = materialize(groups, "groups")
    first = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_id")).alias("kept"))
    first = materialize(first.select(F.col("kept.doc_id").alias("kept_id"), F.col("kept.text_id").alias("kept_text")), "kept")
    gone = named.select(F.col("doc_id").alias("gone_id"), F.col("text_id").alias("gone_text")).distinct()
    gone = materialize(gone.join(first, F.col("gone_id").eqNullSafe(F.col("kept_id")) & (F.col("gone_text") == F.col("kept_text")), "left_anti"), "dropped")
    rows = boxed(docs, own_id=F.col("doc_id").cast("long"), own_text=text_id(F.col("text")))
    kept = rows.join(gone, F.col("own_id").eqNullSafe(F.col("gone_id")) & (F.col("own_text") == F.col("gone_text")), "left_anti")
    repeated = named.groupBy("doc_id", "text_id").count().where("count > 1").limit(1).count()
    if repeated:
        kept = kept.dropDuplicates(["own_id", "own_text"])
    return unboxed(kept, docs)


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """Of each group of near-duplicate texts the row with the least doc_id, once; rows without an id come after those with one."""
    return keep_one(docs, near_text_groups(docs))
