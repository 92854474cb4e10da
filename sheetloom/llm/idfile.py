"""Token ids in files of fixed-width bit-packed blocks.

File layout, all numbers little-endian:

    header   8 bytes magic, uint32 bits an id, uint32 ids a block
    blocks   each block holds the same number of ids (the last fewer), every 64 ids in ``bits``
             64-bit words; id k of such a group takes bits k*bits .. (k+1)*bits-1 of the words
    offsets  uint64 byte offset of every block
    index    for each document: int64 doc_id, uint64 first id, uint8 "doc_id is null"
    footer   uint64 offset of offsets, uint64 offset of index, uint64 documents, uint64 ids, 8 bytes magic

The width is fixed, so any range of ids is unpacked with a few vectorised numpy operations, and
the block offsets and the index give random access to any document.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from ..shared import open_fs
from .shared import fresh_path, materialize, shuffle_width

MAGIC = b"LOOMIDS1"
BLOCK_IDS = 8192


def bits_for(vocabulary: int) -> int:
    """The least bits that tell ``vocabulary`` ids apart."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    groups = -(-len(ids) // 64)
    padded = np.zeros(groups * 64, np.uint64)
    padded[: len(ids)] = ids
    lanes, words = padded.reshape(groups, 64), np.zeros((groups, bits), np.uint64)
    for k in range(64):
        word, shift = divmod(k * bits, 64)
        words[:, word] |= lanes[:, k] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= lanes[:, k] >> np.uint64(64 - shift)
    return words.astype("<u8").tobytes()


def unpack(data: bytes, count: int, bits: int) -> np.ndarray:
    words = np.frombuffer(data, "<u8").reshape(-1, bits)
    lanes, mask = np.empty((len(words), 64), np.uint32), np.uint64((1 << bits) - 1)
    for k in range(64):
        word, shift = divmod(k * bits, 64)
        lane = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            lane = lane | (words[:, word + 1] << np.uint64(64 - shift))
        lanes[:, k] = lane & mask
    return lanes.reshape(-1)[:count]


class IdFileWriter:
    """Streams documents into a file; only one block and the index are held. The file appears whole, by a rename."""

    def __init__(self, path: str, bits: int):
        self.fs, self.path = open_fs(path)
        self.part, self.bits = f"{self.path}.{uuid.uuid4().hex}", bits
        self.out = self.fs.open_output_stream(self.part)
        self.out.write(MAGIC + struct.pack("<II", bits, BLOCK_IDS))
        self.at, self.offsets, self.held, self.n_held, self.n_ids = 16, [], [], 0, 0
        self.doc_ids, self.starts, self.nulls = [], [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.starts.append(self.n_ids)
        self.n_ids += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= 64 * BLOCK_IDS:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        held = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        whole = len(held) if last else len(held) // BLOCK_IDS * BLOCK_IDS
        for i in range(0, whole, BLOCK_IDS):
            self.offsets.append(self.at)
            data = pack(held[i : min(i + BLOCK_IDS, whole)], self.bits)
            self.out.write(data)
            self.at += len(data)
        self.held = [held[whole:]]
        self.n_held = len(held) - whole

    def close(self) -> None:
        self._flush(True)
        index = self.at + 8 * len(self.offsets)
        self.out.write(np.array(self.offsets, "<u8").tobytes())
        for x, kind in ((self.doc_ids, "<i8"), (self.starts, "<u8"), (self.nulls, "u1")):
            self.out.write(np.array(x, kind).tobytes())
        self.out.write(struct.pack("<QQQQ", self.at, index, len(self.doc_ids), self.n_ids) + MAGIC)
        self.out.close()
        self.fs.move(self.part, self.path)


class IdFile:
    """Random access to a file of packed ids."""

    def __init__(self, path: str):
        fs, path = open_fs(path)
        self.file = fs.open_input_file(path)
        magic, self.bits, self.block_ids = struct.unpack("<8sII", self._read(0, 16))
        at, index, n, self.n_ids, end = struct.unpack("<QQQQ8s", self._read(self.file.size() - 40, 40))
        if magic != MAGIC or end != MAGIC:
            raise ValueError(f"{path} is no whole file of packed ids")
        self.offsets = np.frombuffer(self._read(at, index - at), "<u8")
        self.doc_ids = np.frombuffer(self._read(index, 8 * n), "<i8")
        self.starts = np.append(np.frombuffer(self._read(index + 8 * n, 8 * n), "<u8").astype(np.int64), self.n_ids)
        self.nulls = np.frombuffer(self._read(index + 16 * n, n), "u1")

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        count = min(self.n_ids, (last + 1) * self.block_ids) - first * self.block_ids
        data = self._read(int(self.offsets[first]), -(-count // 64) * 8 * self.bits)
        return unpack(data, count, self.bits)[start - first * self.block_ids : stop - first * self.block_ids]

    def documents(self, span: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Every document as (doc_id, first id, ids); about ``span`` ids are unpacked at a time."""
        i, n = 0, len(self.doc_ids)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + span, "right")) - 1)
            j = min(j, n)
            base = int(self.starts[i])
            held = self.ids(base, int(self.starts[j]))
            for k in range(i, j):
                a, b = int(self.starts[k]), int(self.starts[k + 1])
                yield None if self.nulls[k] else int(self.doc_ids[k]), a, held[a - base : b - base]
            i = j


def write_ids(
    docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encode whole texts and write their ids, in ascending ``id_col``, as packed files in ``folder``.

    Returns the manifest: file_no, path, n_docs, n_ids; file k holds smaller ids than file k+1.
    A null text is empty, a null id comes first, rows with equal ids are ordered by their ids' bytes, an
    empty table makes no file, columns other than the two are not looked at. Every task writes its files under
    names of its own and renames them, so a repeated task leaves the same files.
    """
    path = vocabulary or tokens.vocabulary_path()
    spark = docs.sparkSession
    wide = max(tokens.vocabulary_size(path), end_id + 1)
    bits, kind = bits_for(wide), "<u2" if wide <= 1 << 16 else "<u4"
    n = shuffle_width(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    cuts = rows.agg(F.percentile_approx("id", [k / n for k in range(1, n)] or [0.5], 10_000)).first()[0] or []
    cuts = np.unique(np.array(cuts, np.int64))

    def encode(batches):
        get, end = tokens.encoder(path).encode, np.array([end_id], "<u4").tobytes()
        for b in batches:
            ids, made = b.column(0), [np.frombuffer(get(t) + end, "<u4").astype(kind).tobytes() for t in b.column(1).to_pylist()]
            files = np.searchsorted(cuts, ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(files), ids, pa.array(made, pa.binary())], ["file_no", "id", "ids"])

    def write(batches):
        out, at, counts = None, None, {}
        for b in batches:
            for no, doc_id, data in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if no != at:
                    if out:
                        out.close()
                    out, at = IdFileWriter(f"{folder}/ids-{no:06d}.bin", bits), no
                out.add(doc_id, np.frombuffer(data, kind))
                counts[no] = (len(out.doc_ids), out.n_ids)
        if out:
            out.close()
        names = [f"{folder}/ids-{no:06d}.bin" for no in counts]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.int32()), pa.array(names, pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())],
            ["file_no", "path", "n_docs", "n_ids"],
        )

    fs, inner = open_fs(folder)
    fs.create_dir(inner, recursive=True)
    encoded = rows.mapInArrow(encode, "file_no int, id long, ids binary")
    dealt = encoded.repartitionById(n, F.col("file_no")).sortWithinPartitions("file_no", F.col("id").asc_nulls_first(), "ids")
    return materialize(dealt.mapInArrow(write, "file_no int, path string, n_docs long, n_ids long"), "idfiles")


def read_ids(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Read packed files back: doc_id, start, n_tokens, ids_crc32, and the ids (uint32 bytes) if asked for.

    ``start`` counts the ids of all documents before, over all files. The manifest has one row a file.
    """
    spark = manifest.sparkSession
    files = sorted((r.file_no, r.path, r.n_ids) for r in manifest.collect())
    before = [0, *accumulate(f[2] for f in files)]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def read(batches):
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows, held = [], 0
                for doc_id, start, ids in IdFile(path).documents():
                    data = ids.astype("<u4").tobytes()
                    rows.append((doc_id, base + start, len(ids), zlib.crc32(data), data)[: 4 + with_ids])
                    held += len(data) * with_ids + 32
                    if held > 1 << 24:
                        yield as_batch(rows)
                        rows, held = [], 0
                yield as_batch(rows)

    def as_batch(rows):
        kinds = [pa.int64()] * 4 + [pa.binary()] * with_ids
        columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(kinds)])

    table = spark.createDataFrame([(p, b) for (_, p, _), b in zip(files, before, strict=False)], "path string, base long")
    return table.repartition(max(1, len(files))).mapInArrow(read, schema)


def token_id_round_trip(docs: DataFrame, vocabulary: str | None = None, end_id: int = 2) -> DataFrame:
    """Write all documents' ids to packed files in the shared folder and read them back."""
    folder = fresh_path(docs.sparkSession, "packed-ids")
    return read_ids(write_ids(docs, folder, vocabulary, end_id))
