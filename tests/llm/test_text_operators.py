"""Packed ids, packing and sharding against plain versions, on the smallest tables and on edge cases."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from brute import best_fit_bins
from tokenizers import Tokenizer

from sheetloom.llm import idfile, packing, sharding, tokens
from sheetloom.llm.shared import fresh_path


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.vocabulary_path())


def ids_of(library, text, end):
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def key(r):
    return (r[0] is not None, r[0] or 0, *r[1:])


def test_encoder_gives_the_librarys_ids(library):
    random.seed(5)
    pool = [*"abzAZéÉßÿ×ªº²İıſK'’\"!?.,;:-_|<>#&%$*()@/\\ \t\n\r\x0b\x1c\x85\xa0　́中한👍🏽0٣", "'s", "'re", "<|endoftext|>", "  "]
    mine = tokens.ChunkEncoder(tokens.vocabulary_path())
    assert mine.by_chunk
    for _ in range(3000):
        text = "".join(random.choice(pool) for _ in range(random.randint(0, 12)))
        assert mine.encode(text) == ids_of(library, text, 0)[:-1].tobytes()


@pytest.mark.parametrize("bits", [1, 3, 13, 16, 17, 31])
@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000])
def test_pack_round_trip(bits, n):
    ids = np.random.default_rng(n).integers(0, 1 << bits, n).astype(np.uint32)
    data = idfile.pack(ids, bits)
    assert len(data) == -(-n // 64) * 8 * bits
    assert (idfile.unpack(data, n, bits) == ids).all()


def test_random_access(tmp_path):
    rng, path = np.random.default_rng(1), str(tmp_path / "a.bin")
    docs = [(k if k else None, rng.integers(0, 50_000, n).astype(np.uint32)) for k, n in enumerate([5, 0, 100_000, 3, 700_000, 1])]
    out = idfile.IdFileWriter(path, 16)
    for d in docs:
        out.add(*d)
    out.close()
    got = idfile.IdFile(path)
    everything = np.concatenate([d[1] for d in docs])
    for a, b in [(0, 5), (4, 9), (8191, 8193), (99_000, 300_000), (len(everything) - 1, len(everything)), (7, 7)]:
        assert (got.ids(a, b) == everything[a:b]).all()
    for (doc_id, ids), (have, _, back) in zip(docs, got.documents(1000), strict=True):
        assert doc_id == have and (ids == back).all()


@pytest.mark.parametrize("table", ["small", "edge_documents", "no_documents"])
def test_token_id_round_trip(table, request, library, spark):
    docs = request.getfixturevalue(table)
    docs = docs["documents"] if table == "small" else docs
    rows = [(r.doc_id, ids_of(library, r.text, 2)) for r in docs.collect()]
    got = sorted((tuple(r) for r in idfile.token_id_round_trip(docs).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    assert Counter((r[0], r[2], r[3]) for r in got) == Counter((d, len(i), zlib.crc32(i.tobytes())) for d, i in rows)
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got]).tolist()][: len(got)]


def test_files_hold_the_ids(spark, small, library):
    manifest = idfile.write_ids(small["documents"], fresh_path(spark, "test-ids"))
    want = {r.doc_id: ids_of(library, r.text, 2).tobytes() for r in small["documents"].collect()}
    assert {r.doc_id: bytes(r.ids) for r in idfile.read_ids(manifest, with_ids=True).collect()} == want


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 64, 4096])
    lengths = [rng.randint(1, capacity) for _ in range(rng.choice([1, 50, 3000]))]
    counts, used, seen = Counter(lengths), Counter(), Counter()
    for length, first, n, each, sequence, offset in packing.best_fit_plan(counts, capacity):
        assert seen[length] == first
        seen[length] += n
        for k in range(n):
            at = sequence + k // each
            assert used[at] == offset + k % each * length  # gapless, in order
            used[at] += length
    assert seen == counts and max(used.values()) <= capacity
    assert len(used) == best_fit_bins(lengths, capacity)


def test_packing_by_joined_runs(small, monkeypatch):
    """Beyond the bound of the broadcast plan the runs are joined, by bins of ranks, and give the same sequences."""
    docs = small["documents"].unionAll(small["documents"])
    monkeypatch.setattr(packing, "RANK_BIN", 4)
    held = {(r.sequence_id, r.offset, r.length) for r in packing.pack_documents(docs).collect()}
    monkeypatch.setattr(packing, "PLAN_BROADCAST_ROWS", 0)
    rows = packing.pack_documents(docs).collect()
    assert len(rows) == len(held) and {(r.sequence_id, r.offset, r.length) for r in rows} == held


@pytest.mark.parametrize("table", ["small", "edge_documents", "no_documents"])
def test_packing(table, request, library):
    docs = request.getfixturevalue(table)
    docs = docs["documents"] if table == "small" else docs
    pieces = Counter()
    for r in docs.collect():
        ids = ids_of(library, r.text, 1)
        for k in range(0, len(ids), 4096):
            pieces[r.doc_id, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())] += 1
    packed = packing.pack_documents(docs, with_ids=True)
    rows = packed.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == pieces
    made = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert made.get(r.sequence_id, 0) == r.offset
        made[r.sequence_id] = r.offset + r.length
    assert all(n <= 4096 for n in made.values())
    assert len(made) == best_fit_bins([p[3] for p, n in pieces.items() for _ in range(n)], 4096)
    for s in packing.sequences(packed).collect():
        assert len(s.ids) == 4 * made[s.sequence_id]


@pytest.mark.parametrize("table", ["small", "edge_documents", "no_documents"])
def test_sharding(table, request):
    docs = request.getfixturevalue(table)
    docs = docs["documents"] if table == "small" else docs
    rows = sharding.shard_documents(docs).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
        assert 0 <= s < 24
    if table == "small":
        sizes = Counter()
        for r in rows:
            sizes[r.shard] += r["size"]
        ideal, largest = sum(sizes.values()) / 24, max(r["size"] for r in rows)
        assert all(abs(n - ideal) <= largest + 2 * sharding.TOLERANCE * ideal for n in sizes.values())


def test_splitters_by_small_steps(spark, monkeypatch):
    """Where a round may bring few counts only, it takes more rounds and finds the same splitters' tolerance."""
    rows = [(i, f"text {i * 7919 % 3000} " * (i % 9 + 1)) for i in range(3000)]
    keys = sharding.sort_keys(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("d", F.col("doc_id")).cache()
    total = sum(r["size"] for r in keys.select("size").collect())
    targets = [(total * k / 8, total / 800) for k in range(1, 8)]
    monkeypatch.setattr(sharding, "MOST_COUNTS", 16)
    ordered = sorted((r.h, r.d, r["size"]) for r in keys.collect())
    for (target, slack), (h, d) in zip(targets, sharding.find_splitters(keys, targets, 12), strict=True):
        assert abs(sum(n for a, b, n in ordered if (a, b) < (h, d)) - target) <= slack + max(n for _, _, n in ordered)


def test_sharding_splits_a_hot_group(spark):
    """A third of all rows has one text: the group is split, the sizes stay equal."""
    rows = [(i, "hot text" if i % 3 == 0 else f"text {i} " * (i % 5 + 1)) for i in range(6000)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r["size"]
    ideal = sum(sizes.values()) / 8
    assert len(sizes) == 8 and all(abs(n - ideal) <= 0.03 * ideal for n in sizes.values())
    by_text = {}
    for r in got:
        by_text.setdefault(r.text_crc32, set()).add(r.shard)
    assert sum(len(s) > 1 for s in by_text.values()) <= 1
