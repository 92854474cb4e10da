"""Histogram sort: exact byte counts below candidate boundaries, refined until the splitters fit, then one exchange.

Rows are ordered by (hash of the text, id), so equal texts lie side by side. Each round counts exact rows and bytes
in the bins between the probes still in question, over all partitions, and only bins that hold a splitter
out of tolerance are probed more finely: first by further bits of the hash, and within one hash by bits of
the id, so a group of equal texts is split only where neither of its ends would do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, shuffle_width

SHARDS = 24
TOLERANCE = 0.01
FIRST_BITS, MORE_BITS = 12, 8
MOST_COUNTS = 1 << 18  # that a round brings to the driver
LEAST, END = -(1 << 63), (1 << 63) - 1


def sort_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes and 8), text_crc32, and the sort key: hash and id as ``h`` and ``raw``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
    )


def find_splitters(keys: DataFrame, targets: list[tuple[float, float]], id_bits: int) -> list[tuple[int, int]]:
    """A key for each (target bytes, tolerance): rows below it hold the target's bytes, within the tolerance.

    Where equal keys alone make up more, the nearer end is taken. ``keys`` has h, d (below 2**id_bits) and size.
    Each round brings at most 2**MORE_BITS counts for each target to the driver, and ``MOST_COUNTS`` in all (two for each target at least):
    with many targets the rounds take smaller steps.
    """
    found: list[tuple[int, int]] = [(LEAST, 0)] * len(targets)  # of an empty table, the first key will do
    # of each target in question: hash prefix, its bits, id prefix, its bits, bytes before this bin
    in_question = {i: (0, 0, 0, 0, 0) for i in range(len(targets))}
    while in_question:
        level = min((hb, db) for _, hb, _, db, _ in in_question.values())
        now = {i: v for i, v in in_question.items() if (v[1], v[3]) == level}
        h_bits, d_bits = level
        by_id = h_bits == 64
        step = min(MORE_BITS, id_bits - d_bits) if by_id else min(MORE_BITS if h_bits else FIRST_BITS, 64 - h_bits)
        step = max(1, min(step, (MOST_COUNTS // len({(v[0], v[2]) for v in now.values()})).bit_length() - 1))
        shift = id_bits - d_bits - step if by_id else 64 - h_bits - step
        p = _prefix("h", 64, h_bits)
        q = _prefix("d", id_bits, d_bits)
        rows = keys.where(p.isin(sorted({v[0] for v in now.values()}))) if h_bits else keys
        rows = rows.where(q.isin(sorted({v[2] for v in now.values()}))) if d_bits else rows
        counts = rows.groupBy(p.alias("p"), q.alias("q"), F.shiftright("d" if by_id else "h", shift).alias("bin"))
        bins: dict[tuple[int, int], list[tuple[int, int, int, int]]] = {}
        for r in counts.agg(F.sum("size").alias("bytes"), F.min("h").alias("lo"), F.max("h").alias("hi")).collect():
            bins.setdefault((r.p, r.q), []).append((r.bin, r.bytes, r.lo, r.hi))
        for i, (p_at, _, q_at, _, at) in now.items():
            target, slack = targets[i]
            del in_question[i]
            for bin_, n, lo, hi in sorted(bins.get((p_at, q_at), [])):
                start, end = ((p_at, b << shift) if by_id else (b << shift, 0) for b in (bin_, bin_ + 1))
                found[i] = end
                if at + n >= target:
                    if min(target - at, at + n - target) <= slack or by_id and not shift:
                        found[i] = start if target - at <= at + n - target else end
                    elif by_id:
                        in_question[i] = (p_at, 64, bin_, d_bits + step, at)
                    elif lo == hi:
                        in_question[i] = (lo, 64, 0, 0, at)
                    else:
                        in_question[i] = (bin_, h_bits + step, 0, 0, at)
                    break
                at += n
    return found


def _prefix(column: str, width: int, bits: int) -> Column:
    """The first ``bits`` of a column of ``width`` bits."""
    return F.shiftright(column, width - bits) if bits else F.lit(0).cast("long")


def shard_by_bytes(keys: DataFrame, n_shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """Shards of near-equal bytes: adds law, shard, slot, grown_shard to the rows of ``keys`` (see :func:`sort_keys`).

    Every splitter lies within ``tolerance`` of a shard's ideal bytes from its exact place, unless one row or
    rows with equal keys are larger. Slots follow the key. A null text has no bytes, null ids come first, repeated
    rows are kept, rows with equal text and id may stand in any order; an empty table gives an empty table.
    """
    spark = keys.sparkSession
    stats = keys.agg(F.sum("size").alias("size"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    total, lo, hi = stats.size or 0, stats.lo or 0, stats.hi or 0
    cut = max(0, (hi - lo).bit_length() - 61)
    id_bits = max(1, ((hi >> cut) - (lo >> cut) + 1).bit_length())
    d = F.coalesce(F.shiftright("doc_id", cut) - F.lit(lo >> cut) + 1, F.lit(0)).cast("long")
    keyed = keys.withColumn("d", d)
    fine = max(1, -(-2 * shuffle_width(spark) // n_shards))  # parts of a shard that one task sorts
    ideal = total / n_shards
    targets = [(ideal * j / fine, tolerance * ideal if j % fine == 0 else ideal / fine / 2) for j in range(1, n_shards * fine)]
    splitters = find_splitters(keyed, targets, id_bits)
    parts = sorted((key, (j + 1) % fine == 0) for j, key in enumerate(splitters))
    bins = _parts_by_prefix(parts, n_shards)
    schema = "prefix long, part_base int, shard_base int, cuts array<struct<h:long,d:long,shard:int>>"
    table = F.broadcast(spark.createDataFrame(bins, schema))  # 2**FIRST_BITS rows and the cuts: bounded by the shuffle width
    below = F.filter("cuts", lambda c: (c["h"] < F.col("h")) | ((c["h"] == F.col("h")) & (c["d"] <= F.col("d"))))
    placed = (
        keyed.join(table, F.shiftright("h", 64 - FIRST_BITS) == F.col("prefix"))
        .withColumn("below", below)
        .withColumn("part", F.col("part_base") + F.size("below"))
        .withColumn("shard", F.col("shard_base") + F.aggregate("below", F.lit(0), lambda n, c: n + c["shard"]))
        .select(*keys.columns, "d", "part", "shard")
    )
    counts = materialize(placed.groupBy("shard", "part").agg(F.count("*").alias("n")), "shard-parts")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = F.broadcast(counts.select(F.col("part").alias("of_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))  # a row a part
    own = Window.partitionBy("part").orderBy("h", "d", "doc_id", "text_crc32")
    return (
        placed.withColumn("own", F.row_number().over(own) - 1)
        .join(bases, F.col("part") == F.col("of_part"))
        .select(
            *keys.columns, F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
            (F.col("base") + F.col("own")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def _parts_by_prefix(parts: list[tuple[tuple[int, int], bool]], n_shards: int) -> list[tuple]:
    """For each prefix of the hash: the parts and shards that begin below it, and the cuts within it."""
    inside: dict[int, list] = {}
    for (h, d), is_shard in parts:
        if h <= END:
            inside.setdefault(h >> (64 - FIRST_BITS), []).append((h, d, int(is_shard)))
    rows, n_parts, n_before = [], 0, 0
    for prefix in range(-(1 << FIRST_BITS - 1), 1 << FIRST_BITS - 1):
        cuts = inside.get(prefix, [])
        rows.append((prefix, n_parts, n_before, cuts))
        n_parts += len(cuts)
        n_before += sum(c[2] for c in cuts)
    return rows


def shard_documents(docs: DataFrame, n_shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """All documents in shards of near-equal bytes, from their sort keys; see :func:`shard_by_bytes`."""
    return shard_by_bytes(materialize(sort_keys(docs), "shard-keys"), n_shards, tolerance)
