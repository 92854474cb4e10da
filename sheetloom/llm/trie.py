"""The distributed self-join of the binary tries of 64-bit fingerprints.

A fingerprint stands in one trie for each rotation by a block of its bits. Two fingerprints within the budget have a rotation in
which every run of leading blocks has no more than its share of the budget apart (start after the block at which the
errors are furthest above their share), so each trie allows only that share at each depth and still no pair is lost. With
a budget below the number of blocks the first block must agree, and a fingerprint is in one unit of work a
rotation, however many fingerprints there are.

The tries' upper nodes are found from counts by prefix: a node with too many fingerprints is split further, so every
node is of bounded size. Pairs of nodes within their share are the units of work; each is one group of rows, in
which the two subtries are traversed together, a level at a time, adding up differing bits and dropping pairs beyond.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, BLOCKS = 64, 4
BLOCK = BITS // BLOCKS
PREFIX_STEP = 12
LEAF, FRONTIER, PAIRS = 16, 1 << 17, 1 << 21


def shares(budget: int) -> list[int]:
    """How many bits may differ in the first d bits, for each d, in the rotation that a pair within ``budget`` meets in."""
    return [budget * -(-d // BLOCK) // BLOCKS for d in range(BITS + 1)]


def _expand(lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of n items from lo: which range each item is of, and the item."""
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + lo[which]


def _products(al: np.ndarray, ah: np.ndarray, bl: np.ndarray, bh: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (i, j) of pairs of ranges, about ``PAIRS`` at a time."""
    k, i = _expand(al, ah - al)
    width = (bh - bl)[k]
    done = np.cumsum(width)
    start = 0
    while start < len(i):
        before = int(done[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(done, before + PAIRS, "right")))
        m, j = _expand(bl[k[start:stop]], width[start:stop])
        yield i[start:stop][m], j
        start = stop


def _changes(root: np.ndarray) -> np.ndarray:
    """A range of leaves has one root if this is equal at its ends."""
    return np.concatenate([[0], np.cumsum(root[1:] != root[:-1])]) if len(root) else np.zeros(0, np.int64)


def trie_links(a: np.ndarray, b: np.ndarray | None, share: list[int], roots: Callable[[], tuple[np.ndarray, np.ndarray]] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Yield arrays (i, j) with a[i] and b[j] (or a[j], i < j) at ``share[BITS]`` differing bits or fewer.

    All such pairs that keep to ``share`` at every depth are among them, each once. ``a`` and ``b`` are sorted uint64 arrays: the
    leaves of two tries. A node is a range of leaves. Where only components matter, ``roots`` tells the roots of the leaves so far: pairs of
    nodes that are whole in one component are dropped, so a dense group costs little more than the links that join it.
    """
    same, b = b is None, a if b is None else b
    one = np.ones(1, np.int64)
    stack = [(0, one * 0, one * len(a), one * 0, one * len(b), one * 0)]
    while stack:
        depth, al, ah, bl, bh, diff = stack.pop()
        if len(al) > FRONTIER:
            half = len(al) // 2
            stack.append((depth, *(x[half:] for x in (al, ah, bl, bh, diff))))
            stack.append((depth, *(x[:half] for x in (al, ah, bl, bh, diff))))
            continue
        if roots is not None:
            ra, rb = roots()
            ca, cb = _changes(ra), _changes(rb)
            joined = (ca[al] == ca[ah - 1]) & (cb[bl] == cb[bh - 1]) & (ra[al] == rb[bl])
            joined &= (ah - al > 1) | (bh - bl > 1)  # a pair of leaves costs as much as to ask
            if joined.any():
                al, ah, bl, bh, diff = (x[~joined] for x in (al, ah, bl, bh, diff))
                if not len(al):
                    continue
        small = ((ah - al) * (bh - bl) <= LEAF) | (depth == BITS)
        if small.any():
            for i, j in _products(al[small], ah[small], bl[small], bh[small]):
                near = np.bitwise_count(a[i] ^ b[j]) <= share[BITS]
                if same:
                    near &= i < j
                if near.any():
                    yield i[near], j[near]
        wide = ~small
        if not wide.any():
            continue
        al, ah, bl, bh, diff = (x[wide] for x in (al, ah, bl, bh, diff))
        bit = np.uint64(1 << (BITS - 1 - depth))
        upper = np.uint64(((1 << depth) - 1) << (BITS - depth))
        am = np.searchsorted(a, (a[al] & upper) | bit)
        bm = np.searchsorted(b, (b[bl] & upper) | bit)
        own = (al == bl) & (ah == bh) if same else np.zeros(len(al), bool)
        good, more = np.ones(len(al), bool), diff < share[depth + 1]
        good = diff <= share[depth + 1]
        kept = []
        for x, y, u, v, d, ok in ((al, am, bl, bm, 0, good), (am, ah, bm, bh, 0, good), (al, am, bm, bh, 1, more), (am, ah, bl, bm, 1, more & ~own)):
            left = ok & (y > x) & (v > u)
            kept.append([x[left], y[left], u[left], v[left], diff[left] + d])
        following = tuple(np.concatenate(x) for x in zip(*kept, strict=True))
        if len(following[0]):
            stack.append((depth + 1, *following))


def _rotated(fp: Column, turn: int) -> Column:
    return F.shiftleft(fp, BLOCK * turn).bitwiseOR(F.shiftrightunsigned(fp, BITS - BLOCK * turn)) if turn else fp


def split_nodes(keys: DataFrame, views: int, most: int) -> list[list[tuple[int, int, int]]]:
    """For each view the nodes (prefix, bits, fingerprints) of its trie in order, none of more than ``most`` unless all bits are used.

    ``keys`` has (view, key); only counts come to the driver, 2**12 a node that is split.
    """
    done: list[list[tuple[int, int, int]]] = [[] for _ in range(views)]
    ask, bits = [(v, 0) for v in range(views)], 0
    while ask:
        step = min(PREFIX_STEP, BITS - bits)
        rows = keys
        if bits:
            above = F.shiftrightunsigned("key", BITS - bits)
            rows = keys.where(reduce(Column.__or__, [(F.col("view") == v) & above.isin([p for w, p in ask if w == v]) for v in sorted({v for v, _ in ask})]))
        got = rows.groupBy("view", F.shiftrightunsigned("key", BITS - bits - step).alias("p")).agg(F.count("*").alias("n")).collect()
        counts = {(r.view, r.p & ((1 << bits + step) - 1), step): r.n for r in got}
        for k in range(step, 0, -1):
            for (v, p, _), n in [x for x in counts.items() if x[0][2] == k]:
                counts[v, p >> 1, k - 1] = counts.get((v, p >> 1, k - 1), 0) + n
        deeper = []

        def walk(v, p, k, counts=counts, step=step, deeper=deeper, bits=bits):
            n = counts.get((v, p, k), 0)
            if n <= most or bits + k == BITS:
                done[v].append((p, bits + k, n))
            elif k == step:
                deeper.append((v, p))
            else:
                walk(v, 2 * p, k + 1)
                walk(v, 2 * p + 1, k + 1)

        for v, p in ask:
            walk(v, p, 0)
        ask, bits = deeper, bits + step
    return [sorted(x, key=lambda n: n[0] << (BITS - n[1])) for x in done]


def _units(nodes: list[tuple[int, int, int]], share: list[int], first: int) -> tuple[tuple[np.ndarray, ...], int]:
    """(starts, sizes, offsets, unit, second): for each node its units from ``offsets`` on, and on which side of them it is; the next unit's number.

    Nodes cover different prefixes, so two of them meet only beyond the leading bits that must agree: a node is compared with those after it in its own stretch of these.
    """
    prefix, bits, count = (np.array([n[k] for n in nodes], t) for k, t in ((0, np.uint64), (1, np.int64), (2, np.int64)))
    share_of, owner, unit, second = np.array(share), [], [], []
    agreed = max(m for m in range(len(share)) if not any(share[: m + 1]))
    lead = np.array([p >> (n - agreed) if n > agreed else -1 - k for k, (p, n, _) in enumerate(nodes)], object)
    ends = np.append(np.flatnonzero(lead[1:] != lead[:-1]) + 1, len(nodes)) if len(nodes) else np.zeros(0, np.int64)
    for k in np.flatnonzero(count).tolist():
        own = slice(k, int(ends[np.searchsorted(ends, k, "right")]))
        m = np.minimum(bits[k], bits[own])
        mine = np.where(m > 0, prefix[k] >> (bits[k] - m).astype(np.uint64), 0).astype(np.uint64)
        theirs = np.where(m > 0, prefix[own] >> (bits[own] - m).astype(np.uint64), 0).astype(np.uint64)
        other = k + np.flatnonzero((np.bitwise_count(mine ^ theirs) <= share_of[m]) & (count[own] > 0))
        number = first + np.arange(len(other))
        first += len(other)
        owner += [np.full(len(other), k), other[1:]]  # the first is the node itself
        unit += [number, number[1:]]
        second += [np.zeros(len(other), bool), np.ones(len(other) - 1, bool)]
    if owner:
        owner, unit, second = np.concatenate(owner), np.concatenate(unit), np.concatenate(second)
        order = np.argsort(owner, kind="stable")
        owner, unit, second = owner[order], unit[order], second[order]
    else:
        owner, unit, second = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    starts = np.array([p << (BITS - n) for p, n, _ in nodes], np.uint64)
    sizes = np.bincount(owner, minlength=len(nodes))
    return (starts, sizes, np.cumsum(sizes) - sizes, unit, second), first


def join_units(rows: DataFrame, prints: int, budget: int, most: int, work: Callable, schema: str) -> DataFrame:
    """The rows (``schema``) that ``work(a, b, pairs)`` gives for each unit of the tries of ``rows``.

    ``rows`` has long columns: ``prints`` fingerprints fp0, fp1, ... and others, which ``a`` and ``b`` (None where a
    unit is a node with itself) hold as numpy arrays by name, sorted by the fingerprint ``fp`` (uint64, rotated). ``pairs()`` yields arrays (i, j)
    of rows of ``a`` and of ``b`` (or of ``a``, i < j) within the budget. Each pair within the budget in any fingerprint is
    in at least one unit; it may be in several.
    """
    share, views = shares(budget), [(f, t) for f in range(prints) for t in range(BLOCKS)]
    others = [c for c in rows.columns if not c.startswith("fp")]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("view"), _rotated(F.col(f"fp{f}"), t).alias("key")) for k, (f, t) in enumerate(views)]))
    first, tables = 0, []
    for nodes in split_nodes(rows.select(each.alias("x")).select("x.*"), len(views), most):
        table, first = _units(nodes, share, first)
        tables.append(table)
    # bounded by the nodes: one for about ``most`` / 2 fingerprints, and its neighbours
    held = rows.sparkSession.sparkContext.broadcast(tables)

    def deal(batches):
        for b in batches:
            fps = [b.column(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in range(prints)]
            for (f, t), (starts, sizes, offsets, unit, second) in zip(views, held.value, strict=True):
                key = fps[f] << np.uint64(BLOCK * t) | fps[f] >> np.uint64(BITS - BLOCK * t) if t else fps[f]
                node = np.searchsorted(starts, key, "right") - 1
                row, at = _expand(offsets[node], sizes[node])
                for i in range(0, len(row), 1 << 17):
                    r, u = row[i : i + (1 << 17)], at[i : i + (1 << 17)]
                    taken = pa.array(r)
                    columns = [pa.array(unit[u]), pa.array(second[u]), pa.array(key[r].view(np.int64)), *(b.column(prints + k).take(taken) for k in range(len(others)))]
                    yield pa.RecordBatch.from_arrays(columns, ["unit", "second", "fp", *others])

    def run(table):
        second = table.column("second").to_numpy()
        columns = {c: table.column(c).to_numpy() for c in ("fp", *others)}
        columns["fp"] = columns["fp"].view(np.uint64)
        sides = []
        for side in (~second, second):
            part = {c: x[side] for c, x in columns.items()}
            order = np.argsort(part["fp"], kind="stable")
            sides.append({c: x[order] for c, x in part.items()})
        a, b = sides[0], sides[1] if second.any() else None
        return work(a, b, lambda roots=None: trie_links(a["fp"], None if b is None else b["fp"], share, roots))

    dealt = rows.select(*[f"fp{f}" for f in range(prints)], *others).mapInArrow(deal, "unit long, second boolean, fp long, " + ", ".join(f"{c} long" for c in others))
    return dealt.groupBy("unit").applyInArrow(run, schema)
