"""Importance resampling towards a target: documents drawn in proportion to how much likelier the target's words are than the corpus's.

Words and runs of words are hashed to buckets. One pass counts them over the whole corpus and the target, in arrays a task long as the buckets are many;
the logarithm of the ratio of a bucket's two shares is its gain, one array that every task can hold. A second pass scores each document
by the mean of its gains, adds Gumbel noise from its id, and the documents with the highest sums are a draw without
replacement. Which they are is found by radix selection on the digits of (score, id); only those drawn are sorted.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import least_keys, numbered
from .shared import held, materialize

RUNS, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
#: Of UTF-8 bytes: all characters beyond ASCII are word characters, and lower() of bytes touches A-Z only.
WORD, GAP = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9a-z\x80-\xff]")
STRETCH = 1 << 20
REMEMBERED = 1 << 18


def words(text: str | None) -> Iterator[list[bytes]]:
    """The words of a whole text, in stretches of about a megabyte that end between words."""
    data, at = (text or "").encode("utf-8", "surrogatepass").lower(), 0
    while at < len(data):
        gap = GAP.search(data, at + STRETCH)
        end = gap.start() if gap else len(data)
        yield WORD.findall(data, at, end)
        at = end


def runs(parts: Iterator[list[bytes]], most: int) -> Iterator[list[bytes]]:
    """All runs of 1 to ``most`` consecutive words, joined by one space; runs go across stretches."""
    last: list[bytes] = []
    for part in parts:
        yield part
        for n in range(2, most + 1):
            whole = last[max(0, len(last) - n + 1) :] + part
            yield [b" ".join(whole[i : i + n]) for i in range(len(whole) - n + 1)]
        last = (last + part)[-(most - 1) :] if most > 1 else []


class _Buckets(dict):
    """The bucket of each feature; a worker remembers a bounded number of them."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        bucket = zlib.crc32(feature) % self.buckets
        if len(self) < REMEMBERED:
            self[feature] = bucket
        return bucket


def _bucketed(text: str | None, most: int, buckets: int) -> Iterator[np.ndarray]:
    known = held(("feature buckets", buckets), lambda: _Buckets(buckets))
    for part in runs(words(text), most):
        yield np.fromiter(map(known.__getitem__, part), np.int64, len(part))


def bucket_counts(texts: DataFrame, most: int = RUNS, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket's features stand in all texts; a task hands on one count a bucket."""

    def count(batches):
        n = np.zeros(buckets, np.int64)
        for b in batches:
            for text in b.column(0):
                for part in _bucketed(text.as_py(), most, buckets):
                    n += np.bincount(part, minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["bucket", "n"])

    counted = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(buckets, np.int64)
    for r in counted.collect():  # at most a row a bucket
        total[r.bucket] = r.n
    return total


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain in thousandths: the logarithm of its share in the target by that in the corpus, both with one count more a bucket."""
    s_all, t_all, k = float(corpus.sum()), float(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + k) / ((s + 1) * (t_all + k)))) for s, t in zip(corpus.astype(float).tolist(), target.astype(float).tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise in thousandths, from the id alone."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gains: np.ndarray, most: int = RUNS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row."""
    buckets = len(gains)

    def score(batches):
        for b in batches:
            ids, rows = b.column(0).to_pylist(), []
            for doc_id, text in zip(ids, b.column(1), strict=True):
                n, total, n_words = 0, 0, 0
                for k, part in enumerate(_bucketed(text.as_py(), most, buckets)):
                    n, total, n_words = n + len(part), total + int(gains[part].sum()), n_words + (len(part) if k % most == 0 else 0)
                weight = total // n if n else 0
                rows.append((n_words, n, weight, weight + noise(doc_id, seed)))
            made = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([b.column(0), *made], ["doc_id", "n_words", "n_features", "weight", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(score, "doc_id long, n_words long, n_features long, weight long, score long")


def resampled(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, most: int = RUNS, buckets: int = BUCKETS, seed: int = SEED
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of ``docs``; rank is null where a row isn't drawn.

    Of the rows with at least ``least_words`` words, ``percent`` of a hundred are drawn, rounded down: the highest scores, of equal ones those with the least
    doc_id, a null id last. A null text has no words and weight 0; a null id has the noise of an empty one. Repeated rows are rows of their own; of
    rows that agree in score and id the ones with the higher weight, then with fewer features, come first. Both tables may be empty.
    """
    gains = bucket_gains(bucket_counts(docs, most, buckets), bucket_counts(target, most, buckets))
    rows = materialize(scored(docs, gains, most, seed), "scores")
    able = F.col("n_words") >= least_words
    k = percent * rows.where(able).count() // 100
    key = [-F.col("score"), F.col("doc_id").isNull().cast("long"), F.coalesce("doc_id", F.lit(0))]
    drawn = able & least_keys(rows.where(able), key, k)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("weight"), F.asc("n_features")]
    ranked = numbered(rows.where(drawn), order, name="drawn").select(*rows.columns, F.when(F.col("i") < k, F.col("i") + 1).alias("rank"))
    return ranked.unionAll(rows.where(~drawn).withColumn("rank", F.lit(None).cast("long")))
