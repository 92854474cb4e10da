"""Units of trie nodes against a comparison of all nodes, and ids of any size."""

from __future__ import annotations

import numpy as np
import pytest

from sheetloom.llm import simhash, trie


def leaves(rng, depth):
    """Prefixes that cover all fingerprints once: (prefix, bits, count)."""
    found, open_ = [], [(0, 0)]
    while open_:
        p, n = open_.pop()
        if n >= depth or n > 10 and rng.random() < 0.6:
            found.append((p, n, int(rng.integers(0, 3))))
        else:
            open_ += [(2 * p, n + 1), (2 * p + 1, n + 1)] if n < 14 or rng.random() < 0.3 else [(2 * p, n + 1)]
            if n >= 14 and len(open_) and open_[-1] == (2 * p, n + 1):
                found.append((2 * p + 1, n + 1, 1))
    return sorted(found, key=lambda x: x[0] << (64 - x[1]))


@pytest.mark.parametrize("budget", [0, 3, 4, 11])
def test_units_equal_those_of_all_pairs_of_nodes(budget):
    nodes, share = leaves(np.random.default_rng(budget), 19)[:1500], trie.shares(budget)
    (starts, sizes, offsets, unit, second), _ = trie._units(nodes, share, 0)
    by_unit = {}
    for k in range(len(nodes)):
        for u, s in zip(unit[offsets[k] : offsets[k] + sizes[k]].tolist(), second[offsets[k] : offsets[k] + sizes[k]].tolist(), strict=True):
            by_unit.setdefault(u, []).append((s, k))
    got = {tuple(k for _, k in sorted(x)) for x in by_unit.values()}
    want = set()
    for i, (p, n, c) in enumerate(nodes):
        for j in range(i, len(nodes)):
            q, m, d = nodes[j]
            least = min(n, m)
            if c and d and ((p >> (n - least)) ^ (q >> (m - least))).bit_count() <= share[least]:
                want.add((i,) if i == j else (i, j))
    assert got == want


def test_ids_of_any_size_keep_their_component(spark):
    big = (1 << 62) + 5
    text = "one two three four five six seven eight nine ten"
    rows = [(big, text), ((1 << 63) - 1, text), (big + 1, "quite another text that no other row has at all"), (-(1 << 63), "a third text with words of its own and more of them"), (None, "nobody knows the id of this row of words"), (None, text)]
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(big, big), ((1 << 63) - 1, big), (None, big), (big + 1, big + 1), (-(1 << 63), -(1 << 63)), (None, None)}
