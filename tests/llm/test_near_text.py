"""The pipeline's near-duplicate stage against all pairs of whole shingle sets."""

from __future__ import annotations

import numpy as np
import pytest

import corpus_pipeline
from sheetloom.llm import near_text


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def least_of_groups(rows):
    """Ids that stay, by comparing all pairs of (id, text)."""
    rows = sorted(rows)
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {rows[k][0] for k in range(len(rows)) if find(k) == k}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_stage_links_four_fifths_of_five_word_shingles(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    got = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, None).select("doc_id").collect()]
    assert sorted(got) == sorted(least_of_groups((r.doc_id, r.text) for r in docs.collect()))


def test_crowds_and_short_texts(spark, monkeypatch):
    """A passage in many texts, a chain of near copies whose ends differ, and edges of the similarity."""
    monkeypatch.setattr(near_text, "CROWD", 3)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join([*words[:20], *[f"own{i}-{k}" for k in range(i)]]) for i in range(12)]
    texts += [" ".join([*[f"c{i}-{k}" for k in range(2 * i)], *words[2 * i :]]) for i in range(12)]
    texts += [" ".join(f"x{k}" for k in range(n)) for n in range(12)] + ["A b c", "a B  c", "a b d", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.doc_id for r in near_text.one_of_each_group(docs).collect()]
    assert sorted(got) == sorted(least_of_groups((i, t or "") for i, t in enumerate(texts)))


@pytest.mark.parametrize("changed", [0.01, 0.03])
def test_recall_of_near_copies(spark, changed):
    """Of planted pairs with a similarity of four fifths nine in ten are linked, and none of less."""
    rng = np.random.default_rng(int(1000 * changed) + 1)
    rows, want = [], set()
    for k in range(300):
        words = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(60, 600)))]
        other = [f"new{k}-{i}" if rng.random() < changed else w for i, w in enumerate(words)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        a, b = shingles(rows[-2][1]), shingles(rows[-1][1])
        if 5 * len(a & b) >= 4 * len(a | b):
            want.add(2 * k + 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    gone = {r[0] for r in rows} - {r.doc_id for r in near_text.one_of_each_group(docs).collect()}
    assert want and gone <= want and len(gone) >= 0.9 * len(want)


def test_dense_group_is_whole(spark):
    """Many copies of one text, each with its own change: all fall to the least, though few pairs of them are checked."""
    words = [f"w{k}" for k in range(400)]
    rows = [(i, " ".join([*words[: 3 * i], f"own{i}", *words[3 * i + 1 :]])) for i in range(120)] + [(500, "quite another text " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near_text.one_of_each_group(docs).collect()) == [0, 500]


def test_repeated_ids_with_different_texts(spark):
    """A row whose id is also that of a near copy stays, if its own text is in another group."""
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    docs = spark.createDataFrame([(1, a), (2, a), (2, b), (2, b)], "doc_id long, text string")
    left = near_text.keep_one(docs, near_text.near_text_groups(docs)).collect()
    assert sorted((r.doc_id, r.text) for r in left) == [(1, a), (2, b)]


def test_rows_without_an_id(spark):
    """They are of a group like others, and come after those with an id."""
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    docs = spark.createDataFrame([(None, a), (7, a), (None, b), (None, b), (None, None), (None, "")], "doc_id long, text string")
    left = near_text.one_of_each_group(docs).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in left) == [("7", a), ("None", ""), ("None", b)]
