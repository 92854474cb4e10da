"""Best-fit-decreasing packing of token pieces into sequences of fixed capacity.

Which bin a piece goes to depends on its length alone, and there are at most ``capacity`` lengths.
So the plan is made from the count of pieces of each length: a segment tree over remaining
capacities finds the tightest open bin in logarithmic time, and bins of equal history move through
it as runs. The plan equals best-fit decreasing over all pieces one by one; its size follows the number
of lengths, never the number of documents. Pieces then look their place up by (length, rank).
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .shared import materialize, shuffle_width

CAPACITY = 4096
PLAN_BROADCAST_ROWS = 500_000  # 28 MB
RANK_BIN = 1 << 10


class CapacityTree:
    """Segment tree whose leaves are remaining capacities: which of them have open bins."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = np.zeros(2 * self.size, bool).tolist()

    def set(self, capacity: int, is_open: bool) -> None:
        i = self.size + capacity
        self.open[i] = is_open
        while i > 1:
            i //= 2
            is_open = self.open[2 * i] or self.open[2 * i + 1]
            if self.open[i] == is_open:
                return
            self.open[i] = is_open

    def tightest(self, length: int) -> int | None:
        """The least open capacity of at least ``length``."""
        i = self.size + length
        if self.open[i]:
            return length
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                break
            i //= 2
        else:
            return None
        while i < self.size:
            i = 2 * i if self.open[2 * i] else 2 * i + 1
        return i - self.size


def best_fit_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over ``counts`` pieces of each length.

    Returns runs (length, first rank, pieces, pieces a bin, first sequence, first offset): of the pieces of
    that length, the one with rank ``first rank + k`` goes to sequence ``first sequence + k // pieces a bin``
    at ``first offset + k % pieces a bin * length``.
    """
    tree, bins, made, plan = CapacityTree(capacity), [deque() for _ in range(capacity + 1)], 0, []

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if bins[room] and sum(bins[room][-1]) == first:
                bins[room][-1] = (bins[room][-1][0], bins[room][-1][1] + n)
            else:
                bins[room].append((first, n))
            tree.set(room, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, n = capacity, made, -(-left // (capacity // length))
                made += n
            else:
                first, n = bins[room].popleft()
            each = room // length
            used = min(n, -(-left // each))
            if used < n:
                bins[room].appendleft((first + used, n - used))
            elif not bins[room]:
                tree.set(room, False)
            placed = min(left, used * each)
            plan.append((length, rank, placed, each, first, capacity - room))
            whole, rest = divmod(placed, each)
            put(room - each * length, first, whole)
            put(room - rest * length, first + whole, 1 if rest else 0)
            rank, left = rank + placed, left - placed
    return plan


def token_pieces(
    docs: DataFrame, vocabulary: str | None = None, end_id: int = 1, capacity: int = CAPACITY, with_ids: bool = False,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Token pieces of whole texts: doc_id, piece, start, length, ids_crc32, and the ids (uint32 bytes) if asked for."""
    path = vocabulary or tokens.vocabulary_path()
    end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    names = [c.split()[0] for c in schema.split(", ")]

    def cut(batches):
        get = tokens.encoder(path).encode
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = get(text) + end
                for k, i in enumerate(range(0, len(ids), step)):
                    part = ids[i : i + step]
                    rows.append((doc_id, k, i // 4, len(part) // 4, zlib.crc32(part), part)[: 5 + with_ids])
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(cut, schema)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces with a ``length`` of 1 to ``capacity``, one row a piece.

    Pieces are ranked within their length in two steps: within (length, salt), then by the counts of the
    salts before, so that one frequent length is dealt over many tasks. Of pieces with equal keys any may
    come first; each gets a place of its own. An empty table gives an empty table.
    """
    spark, salts = pieces.sparkSession, shuffle_width(pieces.sparkSession)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    counts = materialize(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "lengths")
    plan = best_fit_plan({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(F.col("length").alias("of_length"), F.col("salt").alias("of_salt"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # merged, never broadcast: a row for each length and salt; the ranked side is sorted by them already
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        salted.withColumn("own", F.row_number().over(own) - 1)
        .join(bases.hint("merge"), (F.col("length") == F.col("of_length")) & (F.col("salt") == F.col("of_salt")))
        .withColumn("rank", F.col("base") + F.col("own"))
        .select(*pieces.columns, "rank")
    )
    names = ("at_length", "first_rank", "n", "each", "first_sequence", "first_offset")
    if len(plan) > PLAN_BROADCAST_ROWS:
        # a run and a piece meet in one of the run's bins of ranks, so a frequent length meets few of its runs
        runs = spark.createDataFrame(plan, ", ".join(f"{c} long" for c in names))
        bins = F.sequence(F.floor(F.col("first_rank") / RANK_BIN), F.floor((F.col("first_rank") + F.col("n") - 1) / RANK_BIN))
        runs = materialize(runs.select("*", F.explode(bins).alias("at_bin")), "runs")
        k = F.col("rank") - F.col("first_rank")
        return (
            ranked.join(runs, (F.col("length") == F.col("at_length")) & (F.floor(F.col("rank") / RANK_BIN) == F.col("at_bin")) & (k >= 0) & (k < F.col("n")))
            .withColumn("sequence_id", F.col("first_sequence") + F.floor(k / F.col("each")))
            .withColumn("offset", F.col("first_offset") + k % F.col("each") * F.col("length"))
            .select(*pieces.columns, "sequence_id", "offset")
        )
    # a run's key is length * 2^44 + first rank; ranks stay below 2^44
    table = np.array(sorted(plan), np.int64).reshape(-1, 6)
    held = spark.sparkContext.broadcast((table[:, 0] * (1 << 44) + table[:, 1], table))

    def place(batches):
        keys, runs = held.value
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            run = runs[np.searchsorted(keys, length * (1 << 44) + rank, "right") - 1] if len(length) else runs[:0]
            k = rank - run[:, 1]
            places = [pa.array(run[:, 4] + k // run[:, 3] if len(k) else k), pa.array(run[:, 5] + k % run[:, 3] * length if len(k) else k)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *places], [*b.schema.names[:-1], "sequence_id", "offset"])

    schema = pieces.schema.simpleString()[7:-1].replace(":", " ") + ",sequence_id bigint,offset bigint"
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, vocabulary: str | None = None, end_id: int = 1, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pack the whole texts of ``docs`` into sequences of at most ``capacity`` tokens.

    A null text is empty and takes one token, its end id. Only longer documents are cut. Repeated rows are
    packed as often as they come, null ids among them; other columns are not looked at.
    """
    pieces = materialize(token_pieces(docs, vocabulary, end_id, capacity, with_ids), "pieces")
    return pack_pieces(pieces, capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, their pieces in order, and their ids (uint32 bytes).

    Needs the ``ids`` of :func:`pack_documents`; a group is one sequence, so at most ``capacity`` tokens.
    """
    part = F.struct("offset", "doc_id", "piece", "length", "ids")
    ordered = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    ids = F.aggregate("parts", F.lit(b"").cast("binary"), lambda got, x: F.concat(got, x["ids"]))
    return ordered.select("sequence_id", F.transform("parts", lambda x: x.dropFields("ids")).alias("pieces"), ids.alias("ids"))
