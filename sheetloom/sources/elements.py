"""One large JSON document read by several tasks: a data source that splits it by its elements.

A byte range does not know whether it starts inside a string or how deep it is. So each range is first summed up for both cases: whether its quotes are odd, and by how much its
brackets change the depth if it starts outside a string and if it starts inside one. These few numbers a range, added up in order, give each range's true
start; then every range can tell the commas between elements from all others, and takes the elements that begin in it, to their ends.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..shared import open_fs

CHUNK = 64 << 20
QUOTE, ESCAPE, COMMA, COLON = (ord(c) for c in '"\\,:')
LOOK_BACK = 1 << 16  # bytes before a colon that may hold its key


@dataclass
class Scan:
    """A stretch of a document whose first byte is outside a string (or inside one) and at a known depth."""

    data: np.ndarray
    outside: np.ndarray  # no string covers the byte; closing quotes count as covered
    depth: np.ndarray  # after the byte
    quotes: int


def _open(path: str):
    """The file system of a path and the path in it; without a scheme it is a local path as it stands."""
    from pyarrow import fs

    return (fs.LocalFileSystem(), path) if "://" not in path and not path.startswith("file:") else open_fs(path)


def escaped_before(f, start: int) -> bool:
    """Whether an odd number of backslashes stands right before ``start``."""
    n, step = 0, 64
    while start - n > 0:
        at = max(0, start - n - step)
        f.seek(at)
        part = f.read(start - n - at)
        run = len(part) - len(part.rstrip(b"\\"))
        n += run
        if run < len(part):
            break
        step *= 2
    return n % 2 == 1


def scan(data: bytes, escaped: bool = False, inside: bool = False, depth: int = 0) -> Scan:
    """Strings and depth of each byte. ``escaped``: the first byte belongs to a backslash before it."""
    b = np.frombuffer(data, np.uint8)
    at = np.arange(len(b))
    plain = np.maximum.accumulate(np.where(b != ESCAPE, at, -1)) if len(b) else at
    before = np.concatenate([[-1], plain[:-1]])[: len(b)]
    run = at - 1 - before  # backslashes right before each byte, from the start on
    odd = (run + ((before < 0) & escaped)) % 2 == 1
    quote = (b == QUOTE) & ~odd
    count = np.cumsum(quote) + int(inside)
    outside = (count % 2 == 0) & ~quote
    step = np.where(outside, np.isin(b, (123, 91)).astype(np.int64) - np.isin(b, (125, 93)), 0)
    return Scan(b, outside, depth + np.cumsum(step), int(quote.sum()))


def _read(f, start: int, size: int) -> bytes:
    f.seek(start)
    return f.read(size)


def _ranges(size: int, chunk: int) -> list[tuple[int, int]]:
    return [(s, min(size, s + chunk)) for s in range(0, size, chunk)]


def index(spark: SparkSession, path: str, chunk: int = CHUNK) -> list[tuple[int, int, bool, bool, int]]:
    """start, end, escaped, inside and depth of every byte range: a row a range comes to the driver."""
    fs, at = _open(path)
    size = fs.get_file_info(at).size

    def sums(batches):
        fs, at = _open(path)
        with fs.open_input_file(at) as f:
            for b in batches:
                for s, e in zip(b["s"].tolist(), b["e"].tolist(), strict=True):
                    data, escaped = _read(f, s, e - s), escaped_before(f, s)
                    out, in_ = (scan(data, escaped, inside) for inside in (False, True))
                    yield pd.DataFrame({"s": [s], "e": [e], "escaped": [escaped], "odd": [out.quotes % 2 == 1], "out": [int(out.depth[-1])], "in_": [int(in_.depth[-1])]})

    ranges = _ranges(size, chunk)
    if not ranges:
        return []
    asked = spark.createDataFrame(ranges, "s long, e long").repartition(min(len(ranges), 4 * spark.sparkContext.defaultParallelism))
    found, inside, depth = [], False, 0
    for r in sorted(asked.mapInPandas(sums, "s long, e long, escaped boolean, odd boolean, out long, in_ long").collect()):
        found.append((r.s, r.e, r.escaped, inside, depth))
        depth += r.in_ if inside else r.out
        inside ^= r.odd
    return found


def _span_of(spark: SparkSession, path: str, ranges: list, key: str) -> tuple[int, int] | None:
    """Where the list under a top-level key opens and closes; None if there is none."""

    def look(batches):
        fs, at = _open(path)
        with fs.open_input_file(at) as f:
            for b in batches:
                for s, e, escaped, inside, depth in b.itertuples(index=False):
                    x = scan(_read(f, s, e - s), escaped, inside, depth)
                    for k in np.flatnonzero(x.outside & (x.data == COLON) & (x.depth == 1)).tolist():
                        text = _read(f, max(0, s + k - LOOK_BACK), min(s + k, LOOK_BACK)).rstrip()
                        told = json.dumps(key).encode()
                        if (text.endswith(told) or text.endswith(json.dumps(key, ensure_ascii=False).encode())) and text:
                            yield pd.DataFrame({"at": [s + k], "opens": [True]})
                    for k in np.flatnonzero(x.outside & (x.data == 93) & (x.depth == 1)).tolist():
                        yield pd.DataFrame({"at": [s + k], "opens": [False]})

    asked = spark.createDataFrame(ranges, "s long, e long, escaped boolean, inside boolean, depth long").repartition(min(len(ranges), 4 * spark.sparkContext.defaultParallelism))
    marks = sorted(asked.mapInPandas(look, "at long, opens boolean").collect())  # some for each top-level key
    start = next((m["at"] for m in marks if m.opens), None)
    if start is None:
        return None
    fs, at = _open(path)
    with fs.open_input_file(at) as f:
        k = start + 1
        while (c := _read(f, k, 1)).isspace():
            k += 1
    end = next((m["at"] for m in marks if not m.opens and m["at"] > k), None)
    return (k, end) if c == b"[" and end is not None else None


@dataclass
class ByteRange(InputPartition):
    start: int
    end: int
    escaped: bool
    inside: bool
    depth: int


class ElementsReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.level, self.entries = options["path"], int(options["level"]), options["entries"] == "true"
        self.lo, self.hi = int(options["lo"]), int(options["hi"])
        self.ranges = json.loads(options["index"])

    def partitions(self):
        return [ByteRange(*r) for r in self.ranges if r[0] <= self.hi and r[1] > self.lo]

    def read(self, part: ByteRange) -> Iterator[tuple]:
        fs, at = _open(self.path)
        with fs.open_input_file(at) as f:
            data = _read(f, part.start, part.end - part.start)
            x = scan(data, part.escaped, part.inside, part.depth)
            place = part.start + np.arange(len(data))
            opening = (place == self.lo) | ((x.data == COMMA) & x.outside & (x.depth == self.level))
            closing = np.isin(x.data, (125, 93)) & x.outside & (x.depth == self.level - 1)
            within = (place >= self.lo) & (place <= self.hi)
            marks = np.flatnonzero(within & (opening | closing))
            begins = [k for k in marks.tolist() if opening[k]]
            ends = [k for k in marks.tolist() if k > (begins[0] if begins else len(data))]
            for k, end in zip(begins, [*ends, None], strict=False):
                text = data[k + 1 : end] if end is not None else data[k + 1 :] + self._rest(f, part, x)
                if text.strip():
                    yield self._row(part.start + k + 1, text)

    def _rest(self, f, part: ByteRange, x: Scan) -> bytes:
        """What the last element of a range still has in the ranges after it."""
        at, inside, depth, size, found = part.end, part.inside ^ (x.quotes % 2 == 1), int(x.depth[-1]), 1 << 16, []
        while data := _read(f, at, size):
            y = scan(data, escaped_before(f, at), inside, depth)
            stop = y.outside & (((y.data == COMMA) & (y.depth == self.level)) | (np.isin(y.data, (125, 93)) & (y.depth == self.level - 1)))
            k = int(np.argmax(stop)) if stop.any() else len(data)
            found.append(data[:k])
            if k < len(data):
                break
            at, inside, depth, size = at + len(data), inside ^ (y.quotes % 2 == 1), int(y.depth[-1]), min(2 * size, CHUNK)
        return b"".join(found)

    def _row(self, at: int, text: bytes) -> tuple:
        value = text.decode("utf-8")
        if not self.entries:
            return None, at, value.strip()
        value = value.lstrip()
        key, end = json.JSONDecoder().raw_decode(value)
        return key, at, value[end:].lstrip()[1:].strip()


class Elements(DataSource):
    """key (of an object's entries), at (the byte where an element begins) and value, its JSON."""

    @classmethod
    def name(cls) -> str:
        return "json_elements"

    def schema(self) -> str:
        return "key string, at long, value string"

    def reader(self, schema):
        return ElementsReader(self.options)


def elements(spark: SparkSession, path: str, within: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """The elements of one JSON document: of the list under the top-level key ``within``, or the entries or items of the document itself.

    ``path`` is one file; a task reads ``chunk`` bytes and what its last element has beyond. An element keeps its text, so large numbers and repeated keys stay as they are; a
    document without elements, or without the key, has no rows.
    """
    spark.dataSource.register(Elements)
    ranges = index(spark, path, chunk)
    fs, at = _open(path)
    span, entries = None, False
    if ranges:
        with fs.open_input_file(at) as f:
            head = f.read(1 << 16).lstrip(b"\xef\xbb\xbf \t\r\n")[:1]
            first = next((k for k, c in enumerate(_read(f, 0, 1 << 16)) if c in b"{["), None)
        entries = head == b"{" and within is None
        span = _span_of(spark, path, ranges, within) if within is not None else (first, ranges[-1][1]) if first is not None and head in (b"{", b"[") else None
    if span is None:
        return spark.createDataFrame([], "key string, at long, value string")
    level = 2 if within is not None else 1
    options = {"path": path, "level": level, "entries": str(entries).lower(), "lo": span[0], "hi": span[1], "index": json.dumps(ranges)}
    return spark.read.format("json_elements").options(**{k: str(v) for k, v in options.items()}).load()
