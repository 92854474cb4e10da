"""Merkle manifest, importance resampling and winnowing against plain versions, on the smallest tables and on edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetloom.llm import merkle, ranking, resample, winnow


def rows_of(df):
    return [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]


# places and k-th keys


@pytest.mark.parametrize("group", [None, "g"])
def test_numbered_gives_places_and_counts(spark, group):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.6 else f"g{rng.randrange(9)}", rng.randrange(-50, 50) if rng.random() < 0.95 else None, k) for k in range(700)]
    df = spark.createDataFrame(rows, "g string, v int, k int").repartition(5)
    got = ranking.numbered(df, [F.desc("v"), F.asc("k")], group).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[2])):
        by.setdefault(r[0] if group else "", []).append(r[2])
    assert {(r.g if group else "", r.i, r.k, r.n) for r in got} == {(g, i, k, len(ks)) for g, ks in by.items() for i, k in enumerate(ks)}


def test_numbered_of_nothing(spark):
    assert ranking.numbered(spark.createDataFrame([], "v int"), [F.col("v")]).collect() == []


@pytest.mark.parametrize("spread", [1, 3, 1 << 13, 1 << 62])
def test_least_keys_are_the_first_of_a_sort(spark, spread):
    rng = random.Random(spread)
    rows = [(rng.randrange(-spread, spread), rng.randrange(-9, 1 << 40) if k % 3 else 7) for k in range(500)] + [(0, 7)] * 40
    df = spark.createDataFrame(rows, "a long, b long").cache()
    ordered = sorted(rows)
    for k in (0, 1, 2, 250, 499, 539, 540, 900):
        got = sorted(map(tuple, df.where(ranking.least_keys(df, [F.col("a"), F.col("b")], k)).collect()))
        want = ordered[:k] if k == 0 or k >= len(ordered) else [r for r in ordered if r <= ordered[k - 1]]
        assert got == want, k


# manifest


def plain_manifest(rows, fanout=3):
    def h(*parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def leaf(row):
        return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])

    def tree(digests):
        levels = [digests]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][a : a + fanout]) for a in range(0, len(levels[-1]), fanout)])
        return levels

    def path(levels, at):
        for level in levels[:-1]:
            a = at // fanout * fanout
            yield level[a:at], level[at + 1 : a + fanout]
            at //= fanout

    by = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))):
        by.setdefault(r[1], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([leaf(r) for r in by[s]]) for s in sources}
    top = tree([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for at, r in enumerate(by[s]):
            steps = [*path(trees[s], at), *path(top, k)]
            text = r[4]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded = leaf((*r[:4], text))
            for left, right in steps:
                folded = h(*left, folded, *right)
            root = top[-1][0]
            out.append((r[0], leaf(r), trees[s][-1][0], root, h(*[x for left, right in steps for x in left + right]), folded, folded == root))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_manifest_equals_the_plain_one(small, levels):
    got = merkle.manifest(small["documents"], levels).collect()
    assert ordered(got) == ordered(plain_manifest(rows_of(small["documents"])))
    assert 0 < sum(r.verified for r in got) < len(got)


@pytest.mark.parametrize("fanout, levels", [(2, 3), (5, 2)])
def test_manifest_of_a_hot_source_and_many_small_ones(spark, fanout, levels):
    rng = random.Random(9)
    rows = [(k, "hot" if k % 3 == 0 else f"s{rng.randrange(70)}é", "en", k, f"text\n{k}") for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(7)
    assert ordered(merkle.manifest(df, levels, fanout).collect()) == ordered(plain_manifest(rows, fanout))


def test_manifest_of_edge_documents(edge_documents, no_documents):
    got = merkle.manifest(edge_documents, 1).collect()
    assert ordered(got) == ordered(plain_manifest(rows_of(edge_documents)))
    assert merkle.manifest(no_documents).collect() == []


def test_any_change_of_a_row_breaks_its_proof(spark, small):
    rows, root = merkle.with_proofs(small["documents"], merkle.digest([F.col(c) for c in merkle.FIELDS]), merkle.group_key(F.col("source")), [F.col("doc_id")], {"doc_id": F.col("doc_id"), "lang": F.col("lang")})
    fold = lambda leaf: merkle.fold(leaf, F.col("proof"), F.col("place")) == F.lit(root)
    r = rows.agg(F.min(fold(F.col("leaf"))).alias("whole"), F.max(fold(F.sha2(F.concat("leaf", F.lit("x")), 256))).alias("forged")).first()
    assert r.whole and not r.forged


# resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, most=1):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]


def plain_resample(rows, target, percent=10, least=20, most=1, buckets=10_000, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode("utf-8", "surrogatepass")) % buckets
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(bucket, features(text, most)[1]))
    for text in target:
        t.update(map(bucket, features(text, most)[1]))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    out = []
    for doc_id, text in rows:
        words, found = features(text, most)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, -r[3], r[2]))
    drawn = Counter()
    ranks = {}
    for k, r in enumerate(able[: percent * len(able) // 100]):
        ranks.setdefault(r, []).append(k + 1)
    full = []
    for r in out:
        mine = ranks.get(r, []) if r[1] >= least else []
        full.append((*r, mine[drawn[r]] if drawn[r] < len(mine) else None))
        drawn[r] += 1
    return full


@pytest.mark.parametrize("percent, most, buckets", [(10, 1, 10_000), (50, 2, 257), (100, 3, 10_000), (0, 1, 10)])
def test_resampling_equals_the_plain_one(small, percent, most, buckets):
    got = resample.resampled(small["documents"], small["benchmark"], percent, 20, most, buckets).collect()
    rows = [tuple(r) for r in small["documents"].select("doc_id", "text").collect()]
    assert ordered(got) == ordered(plain_resample(rows, [r.text for r in small["benchmark"].collect()], percent, 20, most, buckets))


def test_resampling_of_edge_documents(spark, edge_documents, no_documents):
    target = spark.createDataFrame([(None,), ("line of text and words",)], "text string")
    got = resample.resampled(edge_documents, target, 50, 1).collect()
    assert ordered(got) == ordered(plain_resample([tuple(r) for r in edge_documents.select("doc_id", "text").collect()], [None, "line of text and words"], 50, 1))
    assert resample.resampled(no_documents, target).collect() == []
    got = resample.resampled(edge_documents, target.limit(0), 50, 1).collect()
    assert ordered(got) == ordered(plain_resample([tuple(r) for r in edge_documents.select("doc_id", "text").collect()], [], 50, 1))


def test_stretches_change_nothing(monkeypatch):
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abé中9_A") for _ in range(rng.randrange(1, 30))) for _ in range(300))
    whole = [list(resample.runs(resample.words(text), n)) for n in (1, 3)]
    monkeypatch.setattr(resample, "STRETCH", 17)
    parts = [list(resample.runs(resample.words(text), n)) for n in (1, 3)]
    for a, b in zip(whole, parts, strict=True):
        assert Counter(x for p in a for x in p) == Counter(x for p in b for x in p)
    assert [w.decode() for p in resample.words(text) for w in p] == features(text)[0]


def test_a_draw_leans_to_the_target(spark):
    rng = random.Random(2)
    like, other = [f"alpha{k}" for k in range(50)], [f"beta{k}" for k in range(50)]
    docs = spark.createDataFrame([(k, " ".join(rng.choices(like if k % 4 == 0 else other, k=40))) for k in range(800)], "doc_id long, text string")
    target = spark.createDataFrame([(" ".join(rng.choices(like, k=500)),)], "text string")
    drawn = [r.doc_id for r in resample.resampled(docs, target).where("rank is not null").collect()]
    assert len(drawn) == 80 and sum(k % 4 == 0 for k in drawn) > 70


# fingerprints


def plain_picks(text, k=winnow.GRAM, w=winnow.WINDOW):
    from xxhash import xxh64_intdigest as xx

    signed = lambda v: v - (1 << 64) if v >> 63 else v
    words = [xx(x.encode(), 42) for x in re.findall(winnow.WORD.replace(r"\x{20000}-\x{3FFFF}", "\U00020000-\U0003ffff"), text.lower())]
    grams = []
    for i in range(len(words) - k + 1):
        h = 42
        for v in words[i : i + k]:
            h = xx(struct.pack("<Q", v), h)
        grams.append(signed(h))
    if words and len(words) < k:
        h = 42
        for v in words:
            h = xx(struct.pack("<Q", v), xx(struct.pack("<Q", h), 42))
        grams = [signed(h)]
    found = []
    for i in range(max(1, len(grams) - w + 1) if grams else 0):
        at = min(range(i, min(len(grams), i + w)), key=lambda j: (grams[j], -j))
        if not found or found[-1] != at:
            found.append(at)
    return [(grams[at], at) for at in found]


def plain_edited(rows):
    told = lambda p: " ".join(f"{h & (1 << 64) - 1:016x}:{at}" for h, at in p)
    rows = [(r[0], r[1] or "") for r in rows]
    out = []
    for k, (doc_id, text) in enumerate(rows):
        other = rows[(k + 1) % len(rows)][1]
        head = len(text) // 4
        edited = text[: len(text) - head] + other[:head]
        own, changed, following = plain_picks(text), plain_picks(edited), plain_picks(other)
        sets = [{h for h, _ in p} for p in (own, changed, following)]
        near = [1.0 if not sets[0] and not x else len(sets[0] & x) / len(sets[0] | x) for x in sets[1:]]
        out.append((doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), told(own), told(changed), *near))
    return out


def test_edited_fingerprints_equal_the_plain_ones(small):
    rows = [tuple(r) for r in small["documents"].select("doc_id", "text").orderBy("doc_id").collect()]
    got = winnow.edited_fingerprints(small["documents"]).collect()
    assert ordered(got) == ordered(plain_edited(rows))
    long_enough = [r for r in got if r.n_chars > 400]
    assert np.median([r.near_edited for r in long_enough]) > 0.5 and np.median([r.near_next for r in long_enough]) < 0.05


@pytest.mark.parametrize("gram, window", [(1, 1), (1, 2), (2, 3), (3, 7), (5, 8), (4, 16)])
def test_picks_equal_the_plain_ones(spark, gram, window):
    rng = random.Random(gram * 100 + window)
    # few different words, so equal hashes and ties are frequent
    texts = [" ".join(rng.choices("abc", k=n)) for n in (0, 1, 2, 3, 4, 5, 7, 12, 13, 40, 200, 300)] + ["中文字 and 中文 " * 9, "Ab ab AB\tab\nab"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in winnow.fingerprints(df, gram, window).collect():
        assert [(x.h, x["at"]) for x in r.picks] == plain_picks(texts[r.doc_id], gram, window), texts[r.doc_id]


def test_a_shared_passage_of_guaranteed_length_shares_a_pick(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    rows = []
    for k in range(60):
        passage = [word() for _ in range(winnow.GRAM + winnow.WINDOW - 1)]
        for side in range(2):
            rows.append((2 * k + side, " ".join([word() for _ in range(rng.randrange(80))] + passage + [word() for _ in range(rng.randrange(80))])))
    prints = winnow.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
    met = {}
    for r in winnow.shared_passages(prints).collect():
        met.setdefault(r.h, set()).add(r.doc_id)
    assert {frozenset(x) for x in met.values()} == {frozenset((2 * k, 2 * k + 1)) for k in range(60)}


def test_edited_fingerprints_of_edge_documents(spark, edge_documents, no_documents):
    got = winnow.edited_fingerprints(edge_documents).collect()
    assert len(got) == edge_documents.count()
    rows = [tuple(r) for r in edge_documents.select("doc_id", "text").collect()]
    assert Counter((r.doc_id, r.n_chars) for r in got) == Counter((d, len(t or "")) for d, t in rows)
    by_text = {}
    for r in got:
        by_text.setdefault((r.doc_id, r.n_chars), set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert winnow.edited_fingerprints(no_documents).collect() == []
    # rows that repeat: each copy but the last is followed by its own copy
    rows = [(1, "a b c d e f g h"), (1, "a b c d e f g h"), (1, "a b c d e f g h"), (2, "z")]
    got = winnow.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert ordered(got) == ordered(plain_edited(rows))
    one = winnow.edited_fingerprints(spark.createDataFrame([(5, "only one text in the table")], "doc_id long, text string")).collect()
    assert ordered(one) == ordered(plain_edited([(5, "only one text in the table")]))
