"""The remaining operators against plain versions, on the smallest tables and on edge cases."""

from __future__ import annotations

import gzip
import hashlib
import re
import time
import zlib

import numpy as np
import pytest
from brute import archive, base_spans, fingerprint, groups, text_stats

from sheetloom.llm import components, decontam, html_extract, pii, quality, rules, simhash, trie, warc
from sheetloom.llm.shared import fresh_path


def table_of(name, request, which="documents"):
    docs = request.getfixturevalue(name)
    return docs[which] if name == "small" else docs


TABLES = pytest.mark.parametrize("table", ["small", "edge_documents", "no_documents"])


# SimHash


def turned(x, k):
    return x << np.uint64(16 * k) | x >> np.uint64(64 - 16 * k) if k else x


@pytest.mark.parametrize("budget", [3, 11])
def test_trie_self_join_finds_all_links(budget):
    """In one rotation or another every pair within the budget keeps to its shares; a plain budget finds all at once."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 1500, dtype=np.uint64)
    near = [int(v) ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for v, k in zip(base[:400], [1, 2, 3, 4, 9, 10, 11, 12] * 50, strict=True)]
    a = np.unique(np.concatenate([base, np.array(near, np.uint64), base[:5], np.array([0, 1, 3, (1 << 64) - 1], np.uint64)]))
    want = {(int(a[i]), int(a[i + 1 + j])) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a[i] ^ a[i + 1 :]) <= budget).tolist()}
    flat = [(int(a[i]), int(a[j])) for x, y in trie.trie_links(a, None, [budget] * 65) for i, j in zip(x.tolist(), y.tolist(), strict=True)]
    assert len(flat) == len(want) and set(flat) == want
    got = set()
    for k in range(trie.BLOCKS):
        b = np.sort(turned(a, k))
        back = turned(b, (trie.BLOCKS - k) % trie.BLOCKS)
        for x, y in trie.trie_links(b, None, trie.shares(budget)):
            got |= {(min(u, v), max(u, v)) for u, v in zip(back[x].tolist(), back[y].tolist(), strict=True)}
    assert got == want
    x, y = a[::2], a[1::2]
    got = {(i, j) for p, q in trie.trie_links(x, y, [budget] * 65) for i, j in zip(p.tolist(), q.tolist(), strict=True)}
    assert got == {(i, j) for i in range(len(x)) for j in np.flatnonzero(np.bitwise_count(x[i] ^ y) <= budget).tolist()}
    same = np.zeros(50, np.uint64)
    assert sum(len(i) for i, _ in trie.trie_links(same, None, trie.shares(budget))) == 50 * 49 // 2


def test_dense_groups_cost_few_pairs(monkeypatch):
    """Components are the same with and without the pruning by components, and a dense group gives far fewer pairs than it has."""
    monkeypatch.setattr(trie, "FRONTIER", 64)
    monkeypatch.setattr(trie, "PAIRS", 256)
    rng = np.random.default_rng(9)
    centre = int(rng.integers(0, 1 << 63))
    crowd = {centre ^ (1 << int(x)) ^ (1 << int(y)) for x, y in rng.integers(0, 64, (900, 2))} | {centre}
    a = np.array(sorted(crowd | {int(v) for v in rng.integers(0, 1 << 63, 300)}), np.uint64)

    def components_of(prune):
        parent, count = np.arange(len(a)), 0

        def roots():
            found = simhash._roots(parent, np.arange(len(a)))
            return found, found

        for i, j in trie.trie_links(a, None, [3] * 65, roots if prune else None):
            count += len(i)
            simhash.merge_links(parent, i, j)
        return simhash._roots(parent, np.arange(len(a))).tolist(), count

    (want, every), (got, few) = components_of(False), components_of(True)
    assert got == want and few < every / 3


def test_fingerprints_link_across_all_units(spark, monkeypatch):
    """Small trie nodes, so that links run between units of different depth."""
    monkeypatch.setattr(simhash, "NODE_LEAST", 8)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = [int(v) ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for v, k in zip(base[:150], [1, 2, 3, 4, 5] * 30, strict=True)]
    crowd = [int(base[0]) ^ (1 << k) for k in range(64)]
    values = sorted({*base.tolist(), *near, *crowd})
    rows = [(int(np.uint64(v).view(np.int64)), i) for i, v in enumerate(values)]
    links = simhash.link_fingerprints(spark.createDataFrame(rows, "fp long, node long"))
    roots = {r.node: r.root for r in components.components(links).collect()}
    assert {i: roots.get(i, i) for i in range(len(values))} == groups(list(enumerate(values)))


@TABLES
def test_near_duplicate_groups(table, request):
    docs = table_of(table, request)
    rows = docs.collect()
    got = simhash.near_duplicate_groups(docs).collect()
    assert sorted((str(r.doc_id), r.fingerprint) for r in got) == sorted((str(r.doc_id), format(fingerprint(r.text), "016x")) for r in rows)
    named = groups(sorted({(r.doc_id, fingerprint(r.text)) for r in rows if r.doc_id is not None}))
    for r in got:
        if r.doc_id is not None:
            assert r.component_id == named[r.doc_id]


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(1, 2), (2, 1), (3, 2)], [(i, i + 1) for i in range(200)], [(0, i) for i in range(1, 100)] + [(500, 99), (501, 502)]])
def test_components(spark, edges):
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {}
    for u, v in edges:
        if u != v:
            for x in (u, v):
                parent.setdefault(x, x)
    for _ in range(len(parent)):
        for u, v in edges:
            if u != v:
                parent[u] = parent[v] = min(parent[u], parent[v])
    assert got == parent


# quality rules


@TABLES
def test_text_statistics(table, request):
    docs = table_of(table, request)
    got = rules.quality_verdicts(docs)
    want = sorted((str(r.doc_id), *text_stats(r.text)) for r in docs.collect())
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got.collect()) == want


def test_bad_hosts_go_and_small_ones_are_shrunk(spark):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(i, good, "good") for i in range(200)] + [(200 + i, "#### " + good if i % 10 else good, "odd") for i in range(20)]
    rows += [(300 + i, good.replace(" ", "*** "), "bad") for i in range(200)] + [(600, good.replace(" ", " ## "), "tiny"), (601, good, None)]
    got = {r.doc_id: r.kept for r in rules.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i] for i in range(220)) and got[601]
    assert not any(got[300 + i] for i in range(200))
    left = rules.kept_documents(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert {r.doc_id for r in left.collect()} == {i for i, k in got.items() if k}


def test_hosts_are_held_to_the_others(spark):
    """Of thirty hosts those go that surely fail far more often; where all fail as often, none does; documents fail by themselves as before."""
    good = " ".join(f"word{i}" for i in range(40))
    bad = good.replace(" ", "*** ")
    rows = [(1000 * h + i, bad if i < share else good, f"h{h}") for h, share in [*((h, 5) for h in range(28)), (28, 60), (29, 12)] for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.base_failed, r.kept) for r in rules.quality_verdicts(docs).collect()}
    assert all(kept == (i // 1000 != 28) and not failed for i, (failed, kept) in got.items())
    even = spark.createDataFrame([(i, bad if i // 30 % 5 < 2 else good, f"h{i % 30}") for i in range(3000)], "doc_id long, text string, source string")
    assert rules.quality_verdicts(even).where("kept").count() == 3000
    few = spark.createDataFrame([*rows, (1, bad, "one"), (2, bad, "two"), (3, bad, "two")], "doc_id long, text string, source string")
    assert rules.quality_verdicts(few).where("doc_id in (1, 2, 3) and kept").count() >= 3


def test_kept_documents_keeps_columns(edge_documents):
    left = rules.kept_documents(edge_documents)
    assert left.schema == edge_documents.schema
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(r.doc_id) for r in rules.quality_verdicts(edge_documents).where("kept").collect())


# WARC


def test_archives_hold_pages(spark, small):
    pages = [(r.page_id, r.html) for r in small["pages"].collect()]
    html = max((p[1] for p in pages), key=len) * 3
    rows = [(i, "http://x/é y", h) for i, h in pages] + [(9000 + k, None, html) for k in range(3)] + [(9100, "u", ""), (9101, "u", None), (9102, "u", "short"), (9103, "u", "short")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    want = archive([(r[0], r[2]) for r in rows])
    got = [tuple(r) for r in warc.archive_round_trip(table).collect()]
    assert sorted(got) == sorted(want)
    # small chunks: the payloads come back whole, in order, with running digests
    manifest = warc.write_archives(table, fresh_path(spark, "test-warc"), size=1000)
    back = {}
    for r in warc.read_archives(manifest, size=777).orderBy("record_id", "chunk_no").collect():
        if r.record_type == "response":
            data = back.get(r.record_id, b"") + bytes(r.data)
            assert r.n_bytes == len(data) and r.sha1 == hashlib.sha1(data).hexdigest()
            back[r.record_id] = data
    assert back == {warc.record_uri(i): (h or "").encode() for i, _, h in rows if not any(w[0] == i and w[3] == "revisit" for w in want)}


def test_archive_edge_cases(spark):
    rows = [(None, None, "x" * 2000), (1, None, "x" * 2000), (2, "u", "x" * 2000), (2, "u", "x" * 2000), (None, "u", None)]
    got = warc.archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in got) == sorted([("None", "revisit", 2), ("1", "revisit", 2), ("2", "response", None), ("2", "response", None), ("None", "response", None)], key=str)
    assert warc.archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_damaged_archive_raises(tmp_path):
    out = warc.WarcWriter(str(tmp_path / "a.warc.gz"))
    out.begin(1, "u", 5, hashlib.sha1(b"other").hexdigest(), None, False)
    out.chunk(b"hello")
    out.end()
    out.close()
    with pytest.raises(ValueError, match="digest"):
        list(warc.read_chunks(str(tmp_path / "a.warc.gz")))


def test_foreign_archives_are_read(tmp_path):
    """Fields without a space, repeated HTTP fields, records without HTTP content or digest, hexadecimal digests, plain files."""
    http = b"HTTP/1.1 200 OK\r\nSet-Cookie:a=1\r\nSet-Cookie: b=2\r\nX:y\r\n\r\n"
    record = lambda kind, name, block, more="": (
        f"WARC/1.0\r\nWARC-Type:{kind}\r\nWARC-Record-ID: <urn:uuid:{name}>\r\n{more}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    )
    web = "Content-Type:application/http; msgtype=response\r\n"
    parts = [
        record("warcinfo", "i", b"software: x\r\n", "Content-Type: application/warc-fields\r\n"), record("request", "q", b"GET / HTTP/1.1\r\nHost: x\r\n\r\n", "Content-Type: application/http; msgtype=request\r\n"),
        record("response", "r", http + b"body" * 9, web + f"WARC-Payload-Digest: sha1:{hashlib.sha1(b'body' * 9).hexdigest()}\r\n"), record("response", "n", http, web + "WARC-Payload-Digest: md5:00\r\n"),
        record("revisit", "v", b"", "WARC-Refers-To: <urn:uuid:r>\r\n"), record("resource", "e", b""),
    ]
    for name, data in (("a.warc", b"".join(parts)), ("a.warc.gz", b"".join(gzip.compress(p) for p in parts))):
        (tmp_path / name).write_bytes(data)
        got = [(r[0][10:-1], r[5], bytes(r[7])) for r in warc.read_chunks(str(tmp_path / name), 20)]
        assert got == [("i", "warcinfo", b"software: x\r\n"), ("q", "request", b""), ("r", "response", b"body" * 5), ("r", "response", b"body" * 4), ("n", "response", b""), ("v", "revisit", b""), ("e", "resource", b"")]


# decontamination


def test_planted_items_are_found(spark, small):
    items = {r.item_id: r.text for r in small["benchmark"].collect()}
    docs = [(r.doc_id, r.text) for r in small["documents"].collect()]
    other = "plain filler words that stand around " * 30
    changed = {i: " ".join(w if k % 15 else "zzz" for k, w in enumerate(t.split())) for i, t in items.items()}
    docs += [(5000 + i, f"{other} {t} {other}") for i, t in items.items()] + [(6000 + i, f"{other} {t.upper()} {other}") for i, t in changed.items() if len(t.split()) > 25]
    docs += [(7000 + i, " ".join(t.split()[: len(t.split()) // 2]) + other) for i, t in items.items()] + [(8000, other * 300), (8001, None), (8002, "")]
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), small["benchmark"]).collect()}
    assert {(d, i) for d, t in docs for i, x in items.items() if x in (t or "")} <= got
    assert all((6000 + i, i) in got for i, t in changed.items() if len(t.split()) > 25)
    assert not any(d >= 7000 for d, _ in got)


def test_search_equals_plain_scores():
    rng = np.random.default_rng(0)
    items = [(i, " ".join(f"w{k}" for k in rng.zipf(1.4, rng.integers(5, 40)) % 300)) for i in range(100)]
    index = decontam.ItemIndex(items)
    for _ in range(50):
        terms = sorted({int(t) for t in rng.integers(1, len(index.postings), 60)})
        for threshold in (0.1, 0.3):
            got = {(k, round(s, 9)) for b in range(index.blocks) for k, s in index.search(terms, threshold, b)}
            scores = {}
            for t in terms:
                for k, x in index.postings[t]:
                    scores[k] = scores.get(k, 0) + x
            assert got == {(k, round(s, 9)) for k, s in scores.items() if s >= threshold - 1e-9}


def test_slices_and_stretches_change_nothing(spark, small, monkeypatch):
    """Not the pairs, and not their scores: also of passages that hold a part of an item's words."""
    rng = np.random.default_rng(4)
    parts = [(10_000 + 10 * k + j, " ".join(w for w in r.text.split() if rng.random() > 0.06 * j)) for k, r in enumerate(small["benchmark"].collect()) for j in range(4)]
    docs = small["documents"].select("doc_id", "text").unionAll(spark.createDataFrame(parts, "doc_id long, text string"))
    rows = lambda n: sorted((r.doc_id, r.item_id, round(r.score, 9), round(r.question_overlap, 9), round(r.answer_overlap, 9), r.first_word) for r in decontam.contaminated(docs, small["benchmark"], slice_bytes=n).collect())
    want = rows(1 << 30)
    assert len({r[2] for r in want}) > 50
    assert rows(2000) == want
    monkeypatch.setattr(decontam, "DOCS_CHARS", 1 << 12)
    assert rows(9000) == want


@pytest.mark.parametrize("blocks", [1, 64])
def test_matches_equal_those_of_all_windows_and_items(small, monkeypatch, blocks):
    """The whole query without its index: every item is scored in every window, and held to the same overlaps."""
    monkeypatch.setattr(decontam, "BLOCKS", blocks)
    items = [(r.item_id, r.text) for r in small["benchmark"].collect()]
    index = decontam.ItemIndex(items)
    matcher = decontam.Matcher(index, 0.3, 0.4)
    impacts = [{} for _ in index.item_ids]
    for t, found in enumerate(index.postings):
        for k, x in found:
            impacts[k][t] = x
    rng = np.random.default_rng(6)
    words = [w for _, t in items for w in t.split()]
    texts = [r.text or "" for r in small["documents"].collect()][::4]
    texts += [" ".join(items[k][1].split()[: int(rng.integers(5, 60))] + [words[i] for i in rng.integers(0, len(words), 200)] + items[-k][1].split()) for k in range(1, 12)]
    hits = 0
    for text in texts:
        terms = [index.vocabulary.get(w, 0) for w in decontam.words_of(text)]
        cells, best = -(-len(terms) // index.cell), {}
        for c in range(cells):
            first = max(0, c - decontam.CELLS + 1) * index.cell
            window = np.array(terms[first : (c + 1) * index.cell], np.int32)
            present = set(window.tolist()) - {0}
            for k, own in enumerate(impacts):
                score = sum(own[t] for t in sorted(present) if t in own)
                if score >= 0.3:
                    q, a, i = decontam.coverage(window, index.questions[k], index.answers[k])
                    n, m = len(index.questions[k]), len(index.answers[k])
                    if q * n + a * m >= 0.4 * (n + m) and min(q, a) >= decontam.PART_OVERLAP:
                        best[k] = max(best.get(k, (0.0,)), (round(q + a, 9),))
        got = {m[0]: (round(m[2] + m[3], 9),) for m in matcher.match(text)}
        assert got == best
        hits += len(got)
    assert hits > 10


def test_short_items_and_scripts_without_spaces(spark):
    items = spark.createDataFrame([(1, "Capital of France? Paris."), (2, "Yes"), (3, "法国的首都是哪里？法国的首都是巴黎。"), (4, "...")], "item_id long, text string")
    rows = [(1, "One line.\nCapital of France? Paris.\nmore"), (2, "the capital of France, Paris, is"), (3, "Is it? Yes. Or no"), (4, "yes and no"), (5, "前文文字。法国的首都是哪里？法国的首都是巴黎。后文"), (6, "法国很大，巴黎很远。"), (None, "capital of france paris")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(1, 1), (3, 2), (5, 3), (None, 1)}
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()} == want
    assert {r.doc_id for r in decontam.without_contaminated(docs, items).collect()} == {2, 4, 6}
    again = spark.createDataFrame([(1, "yes"), (1, "another text"), (None, "Yes!"), (None, "no")], "doc_id long, text string")
    assert {(r.doc_id, r.text) for r in decontam.without_contaminated(again, items).collect()} == {(1, "another text"), (None, "no")}


def test_decontamination_edge_cases(edge_documents, no_documents, small, spark):
    assert decontam.contaminated(edge_documents, small["benchmark"]).count() == 0
    assert decontam.contaminated(no_documents, small["benchmark"]).count() == 0
    empty = spark.createDataFrame([(None, None), (1, ""), (2, "x")], "item_id long, text string")
    short = [(r.doc_id, r.item_id) for r in decontam.contaminated(edge_documents, empty).collect()]  # an item of one word is held by texts of just that word
    assert sorted(short) == sorted((r.doc_id, 2) for r in edge_documents.collect() if r.text == "x") and short
    assert decontam.contaminated(edge_documents, empty.where("item_id is null or item_id = 1")).count() == 0
    assert decontam.contaminated(edge_documents, empty.limit(0)).count() == 0
    assert decontam.without_contaminated(edge_documents, small["benchmark"]).count() == edge_documents.count()


# personal data


@TABLES
def test_base_spans(table, request):
    docs = table_of(table, request)
    got = sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.personal_data(docs).collect())
    want = []
    for r in docs.collect():
        spans = base_spans(r.text)
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        want.append((str(r.doc_id), *(sum(s[0] == k for s in spans) for k in pii.BASE_KINDS), hashlib.sha256(told.encode()).hexdigest()))
    assert got == sorted(want)


TRICKY = [
    "a.b@c.d.e x_y@z.w_q@e.f a@b@c.d @x.y a@b", "1.2.3.4.5.6.7.8 255.255.255.256 001.2.3.004 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1111-4111 4111111111111111", "+1 (523) 555-1055+44 20 7946 0958 +1 +12345678 +1234567",
    "👍 a@b.co 👍 +1 (523) 555-1055", "1" * 30_000, "1 " * 15_000, "a" * 30_000, "a@b" + ".c" * 15_000, "+1" + "-" * 30_000,
]


def test_tricky_spans(spark):
    rows = list(enumerate(TRICKY))
    got = {r.doc_id: r.base_sha256 for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        spans = [] if t in (TRICKY[5], TRICKY[7]) else base_spans(t)  # what plain patterns take minutes for
        assert got[i] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest(), t[:50]


def plain_spans(text):
    """(kind, start, stop, further) of all base spans and of the further candidates that overlap none of them."""
    base = base_spans(text)
    found = [(k, a, b, False) for k, a, b in base]
    for k, p in pii.FURTHER.items():
        if re.search(pii.NEEDS[k][1], text):
            found += [(k, m.start(), m.end(), True) for m in re.finditer(p, text) if not any(a < m.end() and m.start() < b for _, a, b in base)]
    return sorted(found)


def test_all_spans_against_a_plain_version(spark, small, monkeypatch):
    """Positions, gaps and overlaps of base spans and further candidates, in blocks of three."""
    monkeypatch.setattr(pii, "BLOCK", 3)
    rng = np.random.default_rng(8)
    bits = ["a.b@c.de", "jo[at]mail.org", "523-555-1000", "+1 (523) 555-1055", "4111 1111 1111 1111", "7111111111111111", "1234567890123456 4111111111111111", "10.0.0.1", "fe80::1:2", "key=9b0b3c6a43eb78aa99cbd7049c572391524f37a8", " ", "x", "👍", "\n", "é"]
    texts = ["".join(bits[k] + ("" if rng.random() < 0.2 else " ") for k in rng.integers(0, len(bits), 40)) for _ in range(60)]
    texts += [r.text or "" for r in small["documents"].collect()]
    got = pii.with_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert any(x.further for r in got for x in r.spans)
    for r in got:
        assert sorted((pii.KINDS[x.kind], x.start, x.stop, x.further) for x in r.spans) == plain_spans(r.text), r.text
        assert all(len(x.votes) == pii.LABELERS and len(x.marks) == len(pii.MARKS) for x in r.spans)


def test_classifier_adds_likely_spans_only(spark):
    rows = [(i, f"Please call (523) 555-{1000 + i} or mail: jo{i}[at]mail.org, card 4111 1111 1111 1111, or +1 (523) 555-1055.") for i in range(60)]
    rows += [(100 + i, f"order=\"523-555-{1000 + i}x version 523.555.{2000 + i}/2") for i in range(60)]
    got = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("phone:12:26" in got[i] and "email:" in got[i] for i in range(60))
    assert not any(got[100 + i] for i in range(60))


def test_precision_and_recall_of_planted_further_spans(spark):
    """Among the documents of the test data: secrets and cards in longer chains are found, digests, numbers and slugs are not."""
    rng = np.random.default_rng(4)
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()]
    hexed = lambda n: "".join("0123456789abcdef"[k] for k in rng.integers(0, 16, n))
    good = [f'api_key = "{hexed(40)}"', f"password: {hexed(32)}", "mail jo.doe [at] example [dot] org", "phone (523) 555-1055", f"token {hexed(40)}"]
    bad = [f"commit {hexed(40)}", "order 523.555.1055/2", f"sha256 {hexed(64)}", "src=the-page-of-some-words-12"]
    want = {}
    for i in range(len(texts)):
        if i % 5 == 0:
            planted = (good if i % 10 else bad)[i // 10 % 4]
            want[i] = (len(texts[i]) + 1, len(texts[i]) + 1 + len(planted), i % 10 != 0)
            texts[i] += " " + planted
    got = pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    hits = {True: 0, False: 0}
    for r in got:
        if r.doc_id in want:
            a, b, is_good = want[r.doc_id]
            hits[is_good] += any(int(x.split(":")[1]) >= a - 1 and int(x.split(":")[2]) <= b for x in r.spans.split(",") if x)
    n = sum(x[2] for x in want.values())
    assert hits[True] >= 0.9 * n and hits[False] <= 0.1 * (len(want) - n)
    assert sum(r.n_further for r in got) > hits[True]  # those of the test data itself


def test_texts_with_many_matches_are_searched_in_linear_time(spark):
    text = " ".join(f"{k % 1000} a{k}@b.co" for k in range(20_000)) + " " + "9" * 16 + " 4111 1111 1111 1111"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    (r,) = pii.personal_data(docs).collect()
    (left,) = pii.redacted(docs).collect()
    assert r.n_email == 20_000 and r.n_card == 0 and left.text.count("<EMAIL>") == 20_000 and "@" not in left.text
    assert time.time() - began < 60


def test_reliabilities_follow_the_votes():
    patterns = {(0, 1, 1, 1, -1, 1): 500, (0, 0, 1, 1, -1, 1): 80, (0, 0, 0, -1, 0, 0): 300, (0, 1, 0, -1, 0, 0): 5}
    belief = pii.estimate_reliabilities(patterns)
    assert belief[0, 1, 1, 1, -1, 1] > 0.9 and belief[0, 0, 1, 1, -1, 1] > 0.5 > belief[0, 0, 0, -1, 0, 0]


def test_redaction(spark, edge_documents):
    rows = [(1, "a@b.co, 10.0.0.1 x", 18, "k"), (2, None, None, "k"), (3, "none here", 9, None), (None, "+1 (523) 555-1055", 17, "k")]
    got = {r.doc_id: (r.text, r.n_chars) for r in pii.redacted(spark.createDataFrame(rows, "doc_id long, text string, n_chars long, row string")).collect()}
    assert got == {1: ("<EMAIL>, <IP> x", 15), 2: (None, None), 3: ("none here", 9), None: ("<PHONE>", 7)}
    many = " ".join(f"a{k}@b.co,x{k}" for k in range(300))
    (r,) = pii.redacted(spark.createDataFrame([(1, many)], "doc_id long, text string")).collect()
    assert r.text == " ".join(f"<EMAIL>,x{k}" for k in range(300))
    out = pii.redacted(edge_documents)
    assert out.schema == edge_documents.schema and out.count() == edge_documents.count()


# quality classifier


@pytest.mark.parametrize(("repeats", "least"), [(True, 0.97), (False, 0.93)])
def test_held_out_accuracy(spark, repeats, least):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality.score_documents(docs, labels, repeats).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got.values())
    told = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert len(told) > 80 and sum(p == q for p, q in told) >= least * len(told)


def plain_features(text, repeats):
    """Bucket to weight, a token at a time: words as means of their subwords, then pairs of neighbours."""
    words, made = text.split(), {}
    tokens = [[quality.subwords([w])[0].tolist()] for w in words]
    for a, b in zip(words, words[1:]):
        tokens.append([quality.bigram_buckets(quality.word_codes([a, b]), repeats).tolist()])
    for (ids,) in tokens:
        for i in ids:
            made[i] = made.get(i, 0.0) + 1 / len(ids) / len(tokens)
    return made


def test_descent_and_folded_scores_against_a_plain_softmax(monkeypatch):
    """The trained vectors equal those of a loop over buckets, and a folded score the softmax over the mean vector."""
    monkeypatch.setattr(quality, "BUCKETS", 997)
    texts = ["a good text of some words", "bad bad bad bad words", "another good one of them", "bad things bad things", ""]
    labels = [1, 0, 1, 0, 1]
    vectors, out, bias = quality.fit_vectors(texts, labels, epochs=2)
    rng = np.random.default_rng(quality.SEED)
    mine = ((rng.random((997, quality.DIM), dtype=np.float32) - 0.5) / quality.DIM).astype(np.float64)
    o, c = np.zeros((2, quality.DIM)), np.log([2 / 5, 3 / 5])
    for step, k in enumerate(int(k) for _ in range(2) for k in rng.permutation(5)):
        f = plain_features(texts[k], True) if texts[k] else {quality.TWICE: 0.0}
        x = sum((w * mine[i] for i, w in f.items()), np.zeros(quality.DIM))
        p = np.exp(o @ x + c) / np.exp(o @ x + c).sum()
        error, now = p - np.eye(2)[labels[k]], quality.RATE * (1 - step / 10)
        norm = max(sum(w * w for w in f.values()), 1e-6) ** 0.5
        back = o.T @ error
        o, c = o - now * np.outer(error, x), c - 0.02 * now * error
        for i, w in f.items():
            mine[i] -= now * w / norm * back
    assert np.allclose(vectors, mine, atol=1e-4) and np.allclose(out, o, atol=1e-4) and np.allclose(bias, c, atol=1e-4)
    table, shift = quality.fold(vectors, out, bias)
    for text, score in zip(texts, quality.Scorer(table, shift).scores(texts), strict=True):
        f = plain_features(text, True) if text else {}
        x = sum((w * vectors[i] for i, w in f.items()), np.zeros(quality.DIM))
        logits = out @ x + bias
        assert score == pytest.approx(np.exp(logits[1]) / np.exp(logits).sum(), abs=1e-5)


def test_classifier_learns_and_ignores_held_out_labels(spark):
    good = "the calm river ran past old stones and quiet fields until evening came"
    rows = [(i, good + f" {i}" if i % 2 else f"BUY!! NOW!! CHEAP!! {i} " + "spam " * (i % 7 + 2)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = [(i, i % 2) for i in range(600)]
    scores = {r.doc_id: (r.held_out, r.score) for r in quality.score_documents(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    told = [(i, s) for i, (held, s) in scores.items() if held]
    assert sum((s >= 0.5) == (i % 2 == 1) for i, s in told) > 0.98 * len(told)
    flipped = [(i, q if zlib.crc32(str(i).encode()) % 3 != 1 else 1 - q) for i, q in labels]
    again = {r.doc_id: (r.held_out, r.score) for r in quality.score_documents(docs, spark.createDataFrame(flipped, "doc_id long, quality int")).collect()}
    assert again == scores


def test_quality_edge_cases(edge_documents, no_documents, small, spark):
    assert quality.score_documents(edge_documents, small["labels"]).count() == edge_documents.count()
    assert quality.score_documents(no_documents, small["labels"]).count() == 0
    none = spark.createDataFrame([(None, 1), (2, None)], "doc_id long, quality int")
    assert {r.score for r in quality.score_documents(edge_documents, none).collect()} == {0.5}


# HTML


P = "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do. "


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("<script>var x='<p>no</p>'</script>", ""), ("<!-- never closed <p>x</p>", ""), ("<p>unclosed <b>bo</b>ld<br>two", "unclosed bold two"),
        (f"<body><header><h1>Site</h1></header><nav><a href=x>Home</a></nav><div id=content><h1>Title</h1><p>{P}</p><div class='ad'>Buy this now</div><p>{P}</p></div><div class=sidebar>Side words</div>"
         f"<section class=comments><p>{P}</p></section><footer>foot</footer></body>", f"Title {P}{P}".strip()),
        (f"<main><article><header><h1>Tit&eacute;</h1></header><p>a &lt; b x<b>y</b>z</p><form><label>Name</label></form><aside>aside</aside><p>{P}</p><section id=comments><article class=comment><p>{P * 5}</p></article></section>"
         "</article></main><footer>(c)</footer>", f"Tité a < b xyz {P}".strip()),
        ("<article><p>a b \n\t c</p></article><a href=\"" * 1, "a b c"),
    ],
)
def test_main_text(page, text):
    assert html_extract.main_text(page, html_extract.Weights([])) == text


@pytest.mark.parametrize("page", ["<" * 50_000, "<div>" * 30_000 + "x" + "</div>" * 30_000, '<a href="' * 30_000, "<!--" * 30_000, "</b>" * 50_000, "<p>x" * 30_000, "<script>" * 30_000])
def test_odd_pages_take_linear_time(page):
    html_extract.main_text(page, html_extract.Weights([]))


def test_best_region():
    rng = np.random.default_rng(4)
    for _ in range(200):
        x = rng.integers(-5, 5, rng.integers(0, 12)).tolist()
        a, b = html_extract.best_region(x)
        assert sum(x[a:b]) == max([0, *(sum(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1))])


def test_regions_of_whole_pages_equal_the_best_of_all(small):
    pages = [r.html for r in small["pages"].collect()]
    weights = html_extract.Weights(pages[::2])
    for page in pages[:60]:
        scores = html_extract.block_scores(html_extract.parse(page), weights)
        sums = np.concatenate([[0.0], np.cumsum(scores)])
        best = max((sums[b] - sums[a] for a in range(len(sums)) for b in range(a, len(sums))), default=0.0)
        a, b = html_extract.best_region(scores)
        assert sums[b] - sums[a] == pytest.approx(best)


def test_scan_finds_the_text_of_pages_without_marks(spark):
    """Elements, classes and roles that tell content or furniture are taken away; without the scan all text would stay."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    weights = html_extract.Weights(pages[::2])
    whole = 0
    for page in pages[1::2]:
        want = html_extract.main_text(page, weights)
        bare = re.sub(r"<(/?)(article|main|nav|header|footer|aside|section|form)\b", r"<\1div", page)
        bare = re.sub(r"(<[a-z0-9]+)\s+(?:(?:class|id|role)\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)\s*)+", r"\1 ", bare)
        blocks = html_extract.parse(bare)
        assert not html_extract.marked_scope(blocks)
        assert html_extract.main_text(bare, weights) == want
        whole += " ".join(" ".join("".join(b.pieces).split()) for b in blocks if b.n_words and not b.furniture) == want
    assert whole < len(pages) // 20


def test_pages(spark, small):
    got = html_extract.extract(small["pages"]).collect()
    assert len(got) == small["pages"].count() and all(r.n_chars == len(r.text) for r in got)
    rows = {r.page_id: r.html for r in small["pages"].collect()}
    for r in got:
        assert "track(" not in r.text and "&copy;" not in r.text and r.text
        assert r.text.split()[-1] in rows[r.page_id].split("</article>")[0].replace("&amp;", "&")
    odd = spark.createDataFrame([(None, None, None), (1, "u", ""), (1, "u", "")], "page_id long, url string, html string")
    assert [r.text for r in html_extract.extract(odd).collect()] == ["", "", ""]
    assert html_extract.extract(odd.limit(0)).count() == 0
