"""Quality rules judged by host: rule failures by domain, shrunk by an empirical beta prior, joined back to documents.

A document fails of its own accord where it has too few words or repeats itself. Beyond that the method rejects
hosts, not documents: for each rule, a host's failure rate is drawn towards the rate of all hosts by a beta prior fitted
to them, so a host with few documents is not judged by one of them. A host is rejected under a rule, with all its documents, if
its rate is surely far above that of hosts at large: if the rate, less twice its posterior standard deviation, is above ``LEAST_RATE``, and its
odds above ``TIMES`` those of the prior's mean.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import boxed, materialize, unboxed, unheld

LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 8
TIMES, LEAST_RATE = 3.0, 0.25
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
#: Document-level rules whose failures are counted by host.
RULES = ("few_words", "repetition", "symbols", "repeated_lines")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of ``WINDOW`` words found twice or more, its first place included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    keys = hashes[:n].copy()
    for k in range(1, WINDOW):
        keys *= _MULTIPLIER
        keys += hashes[k : k + n]
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(keys, np.unique(twice)))
    cover = np.zeros(len(words) + 1, np.int64)
    cover[at] += 1
    np.subtract.at(cover, at + WINDOW, 1)
    return int((np.cumsum(cover) > 0).sum())


def text_stats(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines of a whole text; lines are those with a word."""
    if not text:
        return (0,) * 6
    words = text.encode("utf-8", "surrogatepass").split()  # of bytes: splits at ASCII white space only
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines)


def with_stats(boxes: DataFrame) -> DataFrame:
    """The given columns and the statistics of column ``text``, which goes."""
    names = [c for c in boxes.columns if c != "text"]
    stats = [x.split()[0] for x in STATS.split(", ")]

    def measure(batches):
        unheld()
        for b in batches:
            made = np.array([text_stats(t) for t in b.column(b.schema.get_field_index("text")).to_pylist()], np.int64).reshape(-1, len(stats))
            kept = [b.column(b.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(made[:, k]) for k in range(len(stats)))], [*names, *stats])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in boxes.schema if f.name != "text")
    return boxes.mapInArrow(measure, f"{schema}, {STATS}")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def _failures() -> dict[str, Column]:
    return {
        "few_words": F.col("n_words") < LEAST_WORDS,
        "repetition": 100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"),
        "symbols": 10 * F.col("n_symbols") > F.col("n_words"),
        "repeated_lines": 3 * F.col("n_dup_lines") > F.col("n_lines"),
    }


def beta_prior(hosts: int, mean: float | None, variance: float | None, noise: float | None) -> tuple[float, float]:
    """Beta prior of host rates by the method of moments; ``noise`` is the variance that sampling alone gives.

    With one host, or rates no more scattered than by chance, the prior is as strong as the limit ``1e6`` allows.
    """
    if not hosts or mean is None or not 0 < mean < 1:
        return (0.5, 0.5) if not hosts or mean is None else (1e-3 + mean, 1e-3 + 1 - mean)
    between = max((variance or 0.0) - (noise or 0.0), 1e-12)
    strength = min(max(mean * (1 - mean) / between - 1, 1.0), 1e6 if hosts > 1 else 1.0)
    return mean * strength, (1 - mean) * strength


def host_verdicts(stats: DataFrame, times: float = TIMES, least: float = LEAST_RATE) -> DataFrame:
    """One row a host: its documents, each rule's shrunk failure rate and what it surely is above, and ``rejected``.

    Counts cover all documents and are added up before the shuffle, so a host with a third of them costs no
    more than another; the prior's moments are sums over all hosts.
    """
    counts = materialize(
        stats.groupBy("host").agg(F.count("*").alias("n"), *[F.count_if(c).alias(r) for r, c in _failures().items()]), "hosts"
    )
    moments = []
    for r in RULES:
        rate = F.col(r) / F.col("n")
        moments += [F.avg(rate).alias(f"{r}_mean"), F.var_pop(rate).alias(f"{r}_var"), F.avg(rate * (1 - rate) / F.col("n")).alias(f"{r}_noise")]
    m = counts.agg(F.count("*").alias("hosts"), *moments).first()
    shrunk, bad = [], F.lit(False)
    for r in RULES:
        a, b = beta_prior(m.hosts, m[f"{r}_mean"], m[f"{r}_var"], m[f"{r}_noise"])
        rate = (F.col(r) + a) / (F.col("n") + a + b)
        surely = rate - 2 * F.sqrt(rate * (1 - rate) / (F.col("n") + a + b + 1))
        shrunk += [rate.alias(f"{r}_rate"), surely.alias(f"{r}_surely")]
        bad = bad | (surely > max(least, times * a / (times * a + b)))
    return counts.select("host", "n", *shrunk, bad.alias("rejected"))


def _judged(stats: DataFrame, verdicts: DataFrame) -> DataFrame:
    hosts = materialize(verdicts.where("rejected").select(F.col("host").alias("bad_host"), "rejected"), "bad-hosts")
    return (
        stats.join(hosts, F.col("host").eqNullSafe(F.col("bad_host")), "left")
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & F.col("rejected").isNull())
        .drop("bad_host", "rejected")
    )


def quality_verdicts(docs: DataFrame, times: float = TIMES, least: float = LEAST_RATE) -> DataFrame:
    """doc_id, the statistics, base_failed and kept for every row of ``docs``; the host is column ``source``.

    A null or empty text has no words and fails. A null source is a host of its own. Repeated rows count as often as
    they come, null ids are kept, an empty table gives an empty table, other columns are not looked at.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("host"), F.col("text").cast("string").alias("text"))
    stats = materialize(with_stats(rows), "text-stats")
    return _judged(stats, host_verdicts(stats, times, least))


def kept_documents(docs: DataFrame, times: float = TIMES, least: float = LEAST_RATE) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns as they are.

    The texts are measured twice, for the hosts and for the documents, rather than moved or stored.
    """
    host, text = F.col("source").cast("string").alias("host"), F.col("text").cast("string").alias("text")
    verdicts = host_verdicts(materialize(with_stats(docs.select(host, text)), "text-stats"), times, least)
    judged = _judged(with_stats(boxed(docs, host=host, text=text)), verdicts)
    return unboxed(judged.where("kept"), docs)
