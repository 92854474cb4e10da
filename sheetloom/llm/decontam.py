"""Benchmark decontamination: a BM25 inverted index of test items, searched with block-max WAND by every passage.

Impacts are divided by the score an item gives itself, so a passage that holds a whole item scores 1 and one
threshold serves items of all lengths. Every window of every document is a query. Vectorised sums of
block maxima tell which (window, block of items) can reach the threshold at all; block-max WAND then finds all
items above it in those blocks, and a hit counts only if the words of the item's question and those of its answer are both there.
"""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import open_fs
from .shared import boxed, fresh_path, held, materialize, unboxed

K1, B = 1.2, 0.75
THRESHOLD = 0.6
OVERLAP = 0.8  # of all words of an item
PART_OVERLAP = 0.5  # of the question's words, and of the answer's
ANSWER_WORDS = 4  # an answer reaches back over sentences until it has so many
BLOCK_ITEMS = 8
BLOCKS = 64
STRETCH_NUMBERS = 1 << 21  # bounds held at a time: cells of a text times blocks
LEAST_CELL = 16
CELLS = 5  # a window is so many cells, one more than the longest item needs
LEAST_WORDS = 5
SLICE_BYTES = 4 << 20
CACHE_ENTRIES = 80_000
DOCS_CHARS = 1 << 25  # of the documents that a worker holds while it goes through several slices
#: Scripts that are written without spaces: each of their characters is a word.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
WORD, UNSPACED_SIGN = re.compile(rf"[{UNSPACED}]|(?:(?![{UNSPACED}])\w)+"), re.compile(f"[{UNSPACED}]")
SENTENCE = re.compile(r"(?<=[.?!:])\s+|(?<=[。！？：])|\n")
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~"  # no letters, digits or underscores


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """An item's words before its last sentence, and those of the last sentence.

    A last sentence of fewer than ``ANSWER_WORDS`` words reaches back; of one sentence, the later half is the answer.
    """
    parts = [w for s in SENTENCE.split(text) if (w := words_of(s))]
    words, k = [w for p in parts for w in p], len(parts) - 1
    while k > 0 and sum(map(len, parts[k:])) < ANSWER_WORDS:
        k -= 1
    cut = sum(map(len, parts[:k])) if k > 0 else (len(words) + 1) // 2
    return words[:cut], words[cut:]


class Corpus(NamedTuple):
    """Of all items with at least ``LEAST_WORDS`` words: how many they are, their words, the longest one's words, and in how many each word is."""

    items: int
    words: int
    longest: int
    holding: dict[str, int]


class ItemIndex:
    """Inverted index with impacts, and their maxima over blocks of items: at least ``BLOCK_ITEMS`` each, at most ``BLOCKS`` blocks.

    Items of fewer than ``LEAST_WORDS`` words are no part of it; they are kept by their words, for whole sentences of a text. ``corpus`` has what all items of a benchmark
    hold of which these are a part, so a part gives its items the scores and windows that the whole does.
    """

    def __init__(self, items: list[tuple[int, str]], corpus: Corpus | None = None):
        split = [(i, *question_and_answer(t)) for i, t in items]
        parts = [(i, q, a) for i, q, a in split if len(q) + len(a) >= LEAST_WORDS]
        short = [(i, tuple(q + a)) for i, q, a in split if 0 < len(q) + len(a) < LEAST_WORDS]
        self.item_ids = [p[0] for p in parts] + [p[0] for p in short]
        self.short: dict[tuple[str, ...], list[int]] = {}
        for k, (_, w) in enumerate(short):
            self.short.setdefault(w, []).append(len(parts) + k)
        self.vocabulary: dict[str, int] = {}
        words = [[self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in q + a] for _, q, a in parts]
        self.questions = [w[: len(p[1])] for w, p in zip(words, parts, strict=True)]
        self.answers = [w[len(p[1]) :] for w, p in zip(words, parts, strict=True)]
        if corpus is None:
            corpus = Corpus(len(words), sum(map(len, words)), max(map(len, words), default=0), Counter(x for _, q, a in parts for x in set(q + a)))
        self.cell = max(LEAST_CELL, -(-corpus.longest // (CELLS - 1)))
        n, mean = corpus.items, corpus.words / max(1, corpus.items)
        df = {t: corpus.holding[w] for w, t in self.vocabulary.items()}
        self.postings: list[list[tuple[int, float]]] = [[] for _ in range(len(self.vocabulary) + 1)]
        for k, w in enumerate(words):
            counts = Counter(w)
            raw = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(w) / mean)) for t, c in counts.items()}
            own = sum(raw.values())
            for t, x in raw.items():
                self.postings[t].append((k, x / own))
        self.block_items = max(BLOCK_ITEMS, -(-len(words) // BLOCKS))
        self.blocks = -(-len(words) // self.block_items)
        self.block_max = np.zeros((len(self.postings), max(1, self.blocks)), np.float32)
        for t, found in enumerate(self.postings):
            for k, x in found:
                # rounded up, so that a bound never falls below an exact score
                self.block_max[t, k // self.block_items] = max(self.block_max[t, k // self.block_items], np.nextafter(np.float32(x), np.float32(2)))

    def search(self, terms: list[int], threshold: float, block: int) -> list[tuple[int, float]]:
        """All items of a block whose score for ``terms`` reaches the threshold, by WAND with the block's maxima."""
        first, last = block * self.block_items, (block + 1) * self.block_items
        lists = []
        for t in terms:
            if self.block_max[t, block]:
                found = self.postings[t]
                a, b = bisect_left(found, (first,)), bisect_left(found, (last,))
                lists.append([found[a:b], 0, float(self.block_max[t, block])])
        hits = []
        while lists:
            lists.sort(key=lambda x: x[0][x[1]][0])
            bound, pivot = 0.0, None
            for at, top in ((x[0][x[1]][0], x[2]) for x in lists):
                bound += top
                if bound >= threshold:
                    pivot = at
                    break
            if pivot is None:
                break
            if lists[0][0][lists[0][1]][0] == pivot:
                score = 0.0
                for x in lists:
                    if x[0][x[1]][0] == pivot:
                        score += x[0][x[1]][1]
                        x[1] += 1
                if score >= threshold - 1e-9:
                    hits.append((pivot, score))
            else:
                for x in lists:
                    while x[1] < len(x[0]) and x[0][x[1]][0] < pivot:
                        x[1] += 1
            lists = [x for x in lists if x[1] < len(x[0])]
        return hits


class TermChunks(dict):
    """Term numbers of the words in a chunk of text between spaces, as 32-bit bytes; 0 is no word of the index."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, chunk: str) -> bytes:
        word = chunk.strip(SIGNS).lower()
        if word.isalnum() and (word.isascii() or not UNSPACED_SIGN.search(word)):  # one word, as nearly all chunks are
            got = self.vocabulary.get(word, 0).to_bytes(4, "little")
        else:
            got = array("i", [self.vocabulary.get(w, 0) for w in words_of(chunk)]).tobytes()
        if len(self) < CACHE_ENTRIES and len(chunk) <= 64:
            self[chunk] = got
        return got


def coverage(window: np.ndarray, question: list[int], answer: list[int], slack: float = 0.25) -> tuple[float, float, int]:
    """The largest share of an item's words that one stretch of the window holds, as (question's, answer's, start).

    The stretch has the item's length and ``slack`` more; words count as often as they come.
    """
    need = Counter(question) + Counter(answer)
    size = len(question) + len(answer)
    width = min(len(window), math.ceil(size * (1 + slack)))
    terms = window.tolist()
    best, at, have, got = -1, 0, Counter(), 0
    for i, t in enumerate(terms):
        have[t] += 1
        got += have[t] <= need[t]
        if i >= width:
            old = terms[i - width]
            got -= have[old] <= need[old]
            have[old] -= 1
        if i >= width - 1 and got > best:
            best, at = got, i - width + 1
    held = Counter(terms[at : at + width])
    parts = [sum((held & Counter(p)).values()) / len(p) if p else 1.0 for p in (question, answer)]
    return parts[0], parts[1], at


class Matcher:
    def __init__(self, index: ItemIndex, threshold: float = THRESHOLD, overlap: float = OVERLAP):
        self.index, self.threshold, self.overlap = index, threshold, overlap
        self.chunks = TermChunks(index.vocabulary)

    def _candidates(self, cell: np.ndarray, term: np.ndarray, edges: np.ndarray) -> Iterator[tuple[int, int]]:
        """(last cell of a window, block) where the block's maxima reach the threshold, a stretch of the text at a time."""
        step = max(CELLS, STRETCH_NUMBERS // self.index.blocks)
        for low in range(0, len(edges) - 1, step):
            high, first = min(low + step, len(edges) - 1), max(0, low - CELLS + 1)
            a, b = edges[first], edges[high]
            if a == b:
                continue
            # row c: sums over the windows that end with cell first + c - CELLS; a term counts once for each cell, so they bound the scores
            starts = np.flatnonzero(np.append(True, cell[a + 1 : b] != cell[a : b - 1]))
            bound = np.zeros((high - first + CELLS, self.index.blocks), np.float64)
            bound[cell[a:b][starts] - first + CELLS] = np.add.reduceat(self.index.block_max[term[a:b]], starts, axis=0, dtype=np.float64)
            np.cumsum(bound, axis=0, out=bound)
            for c, block in np.argwhere(bound[CELLS + low - first :] - bound[low - first : -CELLS] >= self.threshold - 1e-6).tolist():
                yield low + c, block

    def match(self, text: str | None) -> list[tuple[int, float, float, float, int]]:
        """Items in a text: (item number, score, question overlap, answer overlap, first word), the best of each item."""
        if not text:
            return []
        return (self._match_long(text) if self.index.blocks else []) + (self._match_short(text) if self.index.short else [])

    def _match_short(self, text: str) -> list[tuple[int, float, float, float, int]]:
        """Short items that are one whole sentence or line of the text, or some in a row; the first place of each."""
        sentences, first, best = [words_of(s) for s in SENTENCE.split(text)], 0, {}
        for i, sentence in enumerate(sentences):
            key: tuple[str, ...] = ()
            for other in sentences[i : i + 2 * LEAST_WORDS] if sentence else ():
                if len(key) + len(other) >= LEAST_WORDS:
                    break
                key += tuple(other)
                for item in self.index.short.get(key, ()) if other else ():
                    best.setdefault(item, (item, 1.0, 1.0, 1.0, first))
            first += len(sentence)
        return [best[k] for k in sorted(best)]

    def _match_long(self, text: str) -> list[tuple[int, float, float, float, int]]:
        index = self.index
        terms = np.frombuffer(b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" "))), np.int32)
        at = np.flatnonzero(terms)
        if not len(at):
            return []
        cells, width = at // index.cell, len(index.postings)
        own = np.unique(cells * width + terms[at])
        cell, term = own // width, own % width
        edges = np.append(np.searchsorted(cell, np.arange(int(cell[-1]) + 1)), len(cell))
        best: dict[int, tuple[int, float, float, float, int]] = {}
        held_at, held, window = -1, None, None
        for c, block in self._candidates(cell, term, edges):
            first = max(0, c - CELLS + 1)
            if c != held_at:
                held_at, held = c, np.unique(term[edges[first] : edges[c + 1]])
                window = terms[first * index.cell : (c + 1) * index.cell]
            if index.block_max[held, block].sum(dtype=np.float64) < self.threshold - 1e-6:
                continue
            for item, score in index.search(held.tolist(), self.threshold, block):
                q, a, i = coverage(window, index.questions[item], index.answers[item])
                n, m = len(index.questions[item]), len(index.answers[item])
                if q * n + a * m >= self.overlap * (n + m) and min(q, a) >= PART_OVERLAP:
                    got = (item, score, q, a, first * index.cell + i)
                    if item not in best or (q + a, score, -got[4]) > (best[item][2] + best[item][3], best[item][1], -best[item][4]):
                        best[item] = got
        return [best[k] for k in sorted(best)]


class Slice(NamedTuple):
    """A part of the items: the folder of its rows, that of its words' counts over all items (None if it is the whole), and the other totals."""

    items: str
    words: str | None
    totals: tuple[int, int, int]


def item_slices(benchmark: DataFrame, slice_bytes: int) -> list[Slice]:
    """Slices in the shared folder of about ``slice_bytes`` of item text each; null and empty texts are left out.

    Items are dealt by their hash. Where there are several slices, all items' words are counted once, and a slice keeps the counts of its own words.
    """
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").alias("t")).where(F.length("t") > 0)
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-size // slice_bytes)
    if n <= 1:
        return [Slice(materialize(items.coalesce(1), "items").inputFiles()[0].rsplit("/", 1)[0], None, (0, 0, 0))] if n else []
    paths = fresh_path(spark, "items"), fresh_path(spark, "item-words")
    items.withColumn("slice", F.pmod(F.xxhash64("i", "t"), F.lit(n)).cast("int")).repartition(n, "slice").write.partitionBy("slice").parquet(paths[0])

    def count(batches):
        for b in batches:
            slices, words, lengths = [], [], []
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = [w for part in question_and_answer(text) for w in part]
                if len(found) >= LEAST_WORDS:
                    own = [None, *set(found)]
                    slices += [k] * len(own)
                    words += own
                    lengths += [len(found)] + [0] * (len(own) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(slices, pa.int32()), pa.array(words, pa.string()), pa.array(lengths, pa.int64())], ["slice", "word", "length"])

    told = materialize(spark.read.parquet(paths[0]).select(F.col("slice").cast("int").alias("slice"), "t").mapInArrow(count, "slice int, word string, length long"), "item-counts")
    whole = told.where("word is null").agg(F.count("*").alias("n"), F.sum("length").alias("words"), F.max("length").alias("longest")).first()
    holding = told.where("word is not null").groupBy(F.col("word").alias("of_word")).agg(F.count("*").alias("holding"))
    own = told.where("word is not null").select("slice", "word").distinct().join(holding, F.col("word") == F.col("of_word"))
    own.select("slice", "word", "holding").repartition(n, "slice").write.partitionBy("slice").parquet(paths[1])
    there = [r[0] for r in spark.read.parquet(paths[0]).select("slice").distinct().orderBy("slice").collect()]
    return [Slice(f"{paths[0]}/slice={k}", f"{paths[1]}/slice={k}", (whole.n, whole.words or 0, whole.longest or 0)) for k in there]


def _columns(folder: str, *names: str) -> list[list]:
    from pyarrow.fs import FileSelector

    files, inner = open_fs(folder)
    found = []
    for f in sorted(x.path for x in files.get_file_info(FileSelector(inner, allow_not_found=True)) if x.path.endswith(".parquet")):
        with files.open_input_file(f) as file:
            found.append(pq.read_table(file, columns=list(names)))
    return [[x for t in found for x in t.column(c).to_pylist()] for c in names]


def _index_of(part: Slice) -> ItemIndex:
    items = sorted(zip(*_columns(part.items, "i", "t"), strict=True), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    if part.words is None:
        return ItemIndex(items)
    return ItemIndex(items, Corpus(*part.totals, dict(zip(*_columns(part.words, "word", "holding"), strict=True))))


def _stretches(batches, chars: int):
    """Lists of batches of about ``chars`` characters of text."""
    got, size = [], 0
    for b in batches:
        got.append(b)
        size += pc.sum(pc.binary_length(b.column(2))).as_py() or 0
        if size >= chars:
            yield got
            got, size = [], 0
    if got:
        yield got


def _search(rows: DataFrame, benchmark: DataFrame, threshold: float, overlap: float, slice_bytes: int) -> DataFrame:
    """doc_id and text_id of ``rows`` (doc_id, text_id, text) with the items that they hold, in one pass over the rows.

    A worker holds the index of one slice at a time; where there are several it goes through all of them for each stretch of documents.
    """
    paths = item_slices(benchmark, slice_bytes)
    names, kinds = ["doc_id", "text_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"], [pa.int64()] * 3 + [pa.float64()] * 3 + [pa.int64()]

    def search(batches):
        for stretch in _stretches(batches, DOCS_CHARS if len(paths) > 1 else 0):
            for path in paths:
                matcher = held(("matcher", path, threshold, overlap), lambda path=path: Matcher(_index_of(path), threshold, overlap))
                for b in stretch:
                    out = []
                    for doc_id, text_id, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                        out += [(doc_id, text_id, matcher.index.item_ids[m[0]], *m[1:]) for m in matcher.match(text)]
                    columns = list(zip(*out, strict=True)) or [[]] * 7
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return rows.mapInArrow(search, "doc_id long, text_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long")


def _named(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_id"), text.alias("text"))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """The documents that hold test items: doc_id, item_id, score, question_overlap, answer_overlap, first_word.

    One row for each document and item it holds; clean documents have none. Whole texts are searched, in windows
    that overlap by the longest item. Null or empty texts hold nothing, and items with a null or empty text match nothing; an item of fewer than
    ``LEAST_WORDS`` words, which windows can't tell from ordinary prose, is held where it stands as a whole sentence or line, or some in a
    row. In scripts without spaces each character is a word. Of repeated items or documents each gives its rows; null ids are kept.
    """
    return _search(_named(docs), benchmark, threshold, overlap, slice_bytes).drop("text_id")


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no test item, with their columns as they are; a row is named by its id, which may be null, and its text."""
    hits = _search(_named(docs), benchmark, THRESHOLD, OVERLAP, SLICE_BYTES)
    hits = materialize(hits.select(F.col("doc_id").alias("hit_id"), F.col("text_id").alias("hit_text")).distinct(), "hits")
    rows = boxed(docs, own_id=F.col("doc_id").cast("long"), own_text=F.xxhash64(F.col("text").cast("string")))
    kept = rows.join(hits, F.col("own_id").eqNullSafe(F.col("hit_id")) & (F.col("own_text") == F.col("hit_text")), "left_anti")
    return unboxed(kept, docs)
