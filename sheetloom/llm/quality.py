"""Quality classifier: supervised subword embeddings, averaged per document, with a softmax output.

A token is a word or a word bigram. A word's vector is the mean of the learned vectors of its hashed subwords, the word itself and its
character n-grams; a bigram has one hashed vector. A document is the mean of its tokens. All of it is trained together by
numpy stochastic gradient descent on a bounded sample of labelled rows. The output is linear in the mean, so a trained model needs one
number a bucket, and scoring adds one number a token.

One choice of the hashing is an option: with ``repeats`` the bigrams of a word with itself share a bucket, whatever the word.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import hash_share, held

BUCKETS, DIM = 1 << 18, 16
NGRAMS = (3, 4)
PIECE = 1 << 16  # characters of a longer word are scored by pieces
KEPT = 256  # longer words are not kept in the cache
EPOCHS, RATE, SEED = 3, 2.0, 17
#: The bound of the training sample: labelled rows, and characters of one of them.
SAMPLE_ROWS, SAMPLE_CHARS = 6000, 200_000
CACHE_ENTRIES = 300_000
REPEATS = True
TWICE = 0  # the bucket of bigrams of a word with itself, where they share one; of an empty text too


def _gram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-grams of the characters."""
    keys = np.full(max(0, len(codes) - n + 1), n, np.uint64)
    for k in range(n):
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + len(keys)]
    keys ^= keys >> np.uint64(29)
    return keys * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return 1 + (hashes % np.uint64(BUCKETS - 1)).astype(np.int64)


def word_codes(words: list[str]) -> np.ndarray:
    """A 64-bit hash of each word."""
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 7) for w in words], np.uint64)


def bigram_buckets(codes: np.ndarray, repeats: bool) -> np.ndarray:
    """The bucket of each pair of neighbouring words, given by their hashes."""
    first, second = codes[:-1], codes[1:]
    keys = (first * np.uint64(0x9E3779B97F4A7C15) ^ second) * np.uint64(0xC2B2AE3D27D4EB4F)
    found = _buckets(keys >> np.uint64(32))
    return np.where(first == second, TWICE, found) if repeats else found


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, index of its word) of all subwords of the words: each word itself and its character n-grams."""
    whole, owners = [word_codes(words) >> np.uint64(32)], [np.arange(len(words))]
    codes = _codes("".join([f"<{w}>" for w in words]))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner, left = np.repeat(np.arange(len(words)), lengths), np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))
    for n in NGRAMS:
        keys = _gram_hashes(codes, n)
        inside = left[: len(keys)] >= n
        whole.append(keys[inside])
        owners.append(owner[: len(keys)][inside])
    return _buckets(np.concatenate(whole)), np.concatenate(owners)


def long_word_score(word: str, table: np.ndarray) -> float:
    """The mean over all subwords of one word, whose n-grams are made a piece at a time."""
    total, count = float(table[_buckets(word_codes([word]) >> np.uint64(32))[0]]), 1
    spelt = f"<{word}>"
    for i in range(0, len(spelt), PIECE):
        for n in NGRAMS:
            got = table[_buckets(_gram_hashes(_codes(spelt[i : i + PIECE + n - 1]), n))]
            total, count = total + float(got.sum(dtype=np.float64)), count + len(got)
    return total / count


def features(text: str | None, repeats: bool = REPEATS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their weights in its mean."""
    words = (text or "").split()
    if not words:
        return np.array([TWICE]), np.zeros(1, np.float32)
    total = 2 * len(words) - 1
    counts = Counter(words)
    distinct = list(counts)
    ids, owner = subwords(distinct)
    share = np.fromiter(counts.values(), np.float64, len(counts)) / total / np.bincount(owner)
    place_of = dict(zip(distinct, word_codes(distinct).tolist(), strict=True))
    pairs = bigram_buckets(np.fromiter(map(place_of.__getitem__, words), np.uint64, len(words)), repeats)
    unique, place = np.unique(np.concatenate([ids, pairs]), return_inverse=True)
    return unique, np.bincount(place, np.concatenate([share[owner], np.full(len(pairs), 1 / total)])).astype(np.float32)


def fit_vectors(texts: list[str | None], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED, repeats: bool = REPEATS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vector of each bucket, output vectors of the two classes, their biases) by stochastic gradient descent on the softmax loss."""
    rng = np.random.default_rng(seed)
    vectors = ((rng.random((BUCKETS, DIM), dtype=np.float32) - 0.5) / DIM).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    rows = [features(t, repeats) for t in texts]
    share = np.bincount(np.array(labels, np.int64), minlength=2) / max(1, len(labels))
    bias += np.log(np.maximum(share, 1e-3)).astype(np.float32)
    step, steps = 0, max(1, epochs * len(rows))
    for _ in range(epochs):
        for k in rng.permutation(len(rows)).tolist():
            ids, w = rows[k]
            at = vectors[ids]
            x = w @ at
            logits = out @ x + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[k]] -= 1
            now = rate * (1 - step / steps)
            back = out.T @ p
            out -= now * np.outer(p, x)
            bias -= 0.02 * now * p
            # every row of a mean of n vectors moves by its share; dividing by the norm of the shares keeps the step's scale
            vectors[ids] = at - (now * w / max(float(np.square(w).sum()), 1e-6) ** 0.5)[:, None] * back
            step += 1
    return vectors, out, bias


def fold(vectors: np.ndarray, out: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, float]:
    """(score of each bucket, bias): the difference of the two classes' logits, which is linear in the mean."""
    return vectors @ (out[1] - out[0]), float(bias[1] - bias[0])


def train(texts: list[str | None], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED, repeats: bool = REPEATS) -> tuple[np.ndarray, float]:
    """(score of each bucket, bias) of the trained model."""
    return fold(*fit_vectors(texts, labels, epochs, rate, seed, repeats))


class Scorer:
    """Scores of texts, with a cache of words (their hashes and scores) that is emptied when full."""

    def __init__(self, table: np.ndarray, bias: float, repeats: bool = REPEATS):
        self.table, self.bias, self.repeats = table, bias, repeats
        self._empty()

    def _empty(self) -> None:
        self.known: dict[str, int] = {}
        self.used = 0
        self.scored, self.codes = np.zeros(1 << 12), np.zeros(1 << 12, np.uint64)

    def _learn(self, words: set[str]) -> None:
        fresh = list(words - self.known.keys())
        if self.used + len(fresh) > CACHE_ENTRIES:
            self._empty()
            fresh = list(words)
        first = self.used
        if first + len(fresh) > len(self.scored):
            size = 2 * (first + len(fresh))
            self.scored, self.codes = (np.concatenate([x[:first], np.zeros(size - first, x.dtype)]) for x in (self.scored, self.codes))
        long = [w for w in fresh if len(w) > PIECE]
        for part in [[w] for w in long] + list(by_size([w for w in fresh if len(w) <= PIECE], 1 << 17)):
            at = self.used
            self.used += len(part)
            if len(part[0]) > PIECE:
                self.scored[at] = long_word_score(part[0], self.table)
            else:
                ids, owner = subwords(part)
                self.scored[at : at + len(part)] = np.bincount(owner, self.table[ids]) / np.bincount(owner)
            self.codes[at : at + len(part)] = word_codes(part)
            self.known.update(zip(part, range(at, at + len(part)), strict=True))

    def scores(self, texts: list[str | None]) -> list[float]:
        split, seen, made = [(t or "").split() for t in texts], set(), []
        for words in split:
            seen.update(words)
        self._learn(seen)
        for words in split:
            x = self.bias
            if words:
                at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
                pairs = self.table[bigram_buckets(self.codes[at], self.repeats)]
                x += (float(self.scored[at].sum()) + float(pairs.sum(dtype=np.float64))) / (2 * len(words) - 1)
            made.append(1 / (1 + math.exp(-max(-60.0, min(60.0, x)))))
        for w in [w for w in seen if len(w) > KEPT]:
            del self.known[w]
        return made


def by_size(texts: list[str | None], most: int = 1 << 20):
    """The texts in runs of about ``most`` characters."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t or "")
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> tuple[list[str], list[int]]:
    """Texts and labels of at most ``rows`` labelled documents outside the held-out third, by a hash of their ids."""
    known = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id")))
    one = known.groupBy(F.col("doc_id").alias("labelled_id")).agg(F.max("quality").alias("quality"))
    chosen = hash_share(one, F.col("labelled_id"), rows).orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.length("text") <= chars)
    found = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled_id"))  # at most SAMPLE_ROWS ids
    got = sorted((r.doc_id, r.text, r.quality) for r in found.select("doc_id", "text", "quality").collect())
    once = {r[0]: r for r in reversed(got)}  # a repeated row trains once
    return [once[k][1] for k in sorted(once)], [once[k][2] for k in sorted(once)]


def score_documents(docs: DataFrame, labels: DataFrame, repeats: bool = REPEATS) -> DataFrame:
    """doc_id, held_out, score (of label 1) and predicted for the whole text of every row.

    A null or empty text gets the score of no evidence, the share of label 1 as the model has learned it. Null labels are not
    learned from; without any labelled row every score is 0.5. Repeated rows and null ids are kept (a null id is not held out);
    other columns are not looked at.
    """
    texts, known = training_sample(docs, labels)
    table, bias = train(texts, known, repeats=repeats) if known else (np.zeros(BUCKETS, np.float32), 0.0)
    model = docs.sparkSession.sparkContext.broadcast(table.astype(np.float32).tobytes())

    name = uuid.uuid4().hex

    def score(batches):
        scorer = held(("scorer", name), lambda: Scorer(np.frombuffer(model.value, np.float32), bias, repeats))
        for b in batches:
            made = [x for run in by_size(b.column(2).to_pylist()) for x in scorer.scores(run)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.float64()), pa.array([int(x >= 0.5) for x in made], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce(held_out(doc_id), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
