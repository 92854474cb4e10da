"""WARC archives through a table of record chunks.

A payload moves as rows (record id, chunk number, bytes) both ways. On writing Spark cuts it into chunk rows before any Python sees it, and a task
appends them to its archive, one gzip member a record, with a running digest that must end at the record's; on reading each chunk row
carries the digest of the payload up to it, so the last one's is the payload's. Python never holds more than a batch of chunks. A record whose payload
another holds already is a revisit without payload.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import open_fs
from .shared import fresh_path, materialize

CHUNK = 1 << 16
LEAST_REVISIT = 1000
ROWS_BYTES = 1 << 22
DATE = "2024-01-01T00:00:00Z"
CHUNK_SCHEMA = "record_id string, chunk_no int, last boolean, n_bytes long, sha1 string, record_type string, refers_to string, data binary"


def record_uri(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def uri_page(uri: str | None) -> int | None:
    name = (uri or "").removeprefix("<urn:page:").removesuffix(">")
    return int(name) if name.lstrip("-").isdigit() else None


def _target(url: str | None) -> str:
    return "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url or "")


class WarcWriter:
    """Writes records of known length from their chunks; the file appears whole, by a rename."""

    def __init__(self, path: str):
        self.fs, self.path = open_fs(path)
        self.part = f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.part, compression=None)

    def begin(self, page_id: int | None, url: str | None, n_bytes: int, sha1: str, refers_to: int | None, is_revisit: bool) -> None:
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
        head = [
            "WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {record_uri(page_id)}", f"WARC-Date: {DATE}",
            *([f"WARC-Target-URI: {_target(url)}"] if url else []), "Content-Type: application/http; msgtype=response",
            f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}",
        ]
        if is_revisit:
            head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_uri(refers_to)}"]
        head.append(f"Content-Length: {len(http) + (0 if is_revisit else n_bytes)}")
        self.pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        self.out.write(self.pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + http))

    def chunk(self, data) -> None:
        self.out.write(self.pack.compress(data))

    def end(self) -> None:
        self.out.write(self.pack.compress(b"\r\n\r\n") + self.pack.flush())

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.part, self.path)


class _Inflated:
    """The bytes of a file of gzip members, or of a plain one, read a little at a time."""

    def __init__(self, path: str, size: int = CHUNK):
        fs, path = open_fs(path)
        self.file, self.size, self.held = fs.open_input_stream(path, compression=None), size, b""
        self.raw = self.file.read(2)
        self.plain = self.raw != b"\x1f\x8b"
        self.member = zlib.decompressobj(31)

    def _more(self) -> bool:
        while True:
            if self.member.eof:
                self.raw, self.member = self.member.unused_data, zlib.decompressobj(31)
            raw = self.raw or self.member.unconsumed_tail or self.file.read(self.size)
            self.raw = b""
            if not raw:
                return False
            made = raw if self.plain else self.member.decompress(raw, self.size)
            if made:
                self.held += made
                return True

    def read(self, n: int) -> bytes:
        """Up to n bytes, none at the end."""
        if not self.held and not self._more():
            return b""
        made, self.held = self.held[:n], self.held[n:]
        return made

    def line(self) -> tuple[bytes, int]:
        """A line without its end, and how many bytes it took."""
        while b"\n" not in self.held:
            if not self._more():
                raise EOFError("a record ends before its header does")
        made, _, self.held = self.held.partition(b"\n")
        return made.removesuffix(b"\r"), len(made) + 1

    def headers(self, most: int | None = None) -> tuple[dict[str, str], int]:
        """Fields by name in lower case, of repeated ones the first, up to an empty line or ``most`` bytes; and the bytes they took."""
        found, used = {}, 0
        while most is None or used < most:
            line, n = self.line()
            used += n
            if not line:
                break
            name, _, value = line.decode("utf-8", "replace").partition(":")
            found.setdefault(name.strip().lower(), value.strip())
        return found, used

    def at_end(self) -> bool:
        return not self.held and not self._more()


def told_digest(field: str | None) -> str | None:
    """The SHA-1 that a digest field tells, in hexadecimal; None for other digests or none."""
    kind, _, value = (field or "").partition(":")
    if kind.lower() not in ("sha1", "sha-1"):
        return None
    return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()


def read_chunks(path: str, size: int = CHUNK) -> Iterator[tuple]:
    """Rows of the chunk table, without building a payload up; a payload that doesn't fit its digest raises.

    The payload of a record with HTTP content is what follows the HTTP header, of others (such as warcinfo) the whole block. A digest that is
    missing or no SHA-1 is not checked. A revisit has one row, with the length that its HTTP header tells (0 if none).
    """
    source = _Inflated(path, size)
    while not source.at_end():
        if not source.line()[0].startswith(b"WARC/"):
            raise ValueError(f"{path}: a record doesn't begin with its version")
        head, _ = source.headers()
        kind, left, name, http = head["warc-type"], int(head["content-length"]), head["warc-record-id"], {}
        if left and head.get("content-type", "").replace(" ", "").lower().startswith("application/http"):
            left -= source.line()[1]  # the status
            http, used = source.headers(left)
            left -= used
        if left < 0:
            raise ValueError(f"{path}: the header of {name} is longer than its block")
        told, digest, no, total = told_digest(head.get("warc-payload-digest")), hashlib.sha1(usedforsecurity=False), 0, left
        if kind == "revisit":
            length = http.get("content-length", "")
            yield name, 0, True, int(length) if length.isdigit() else 0, told, kind, head.get("warc-refers-to"), b""
        while left or not no:
            part, want = b"", min(left, size)
            while len(part) < want:
                if not (got := source.read(want - len(part))):
                    raise EOFError(f"{path}: {name} ends early")
                part += got
            left -= len(part)
            no += 1
            if kind != "revisit":
                digest.update(part)
                if not left and told not in (None, digest.hexdigest()):
                    raise ValueError(f"{path}: the payload of {name} doesn't fit its digest")
                yield name, no - 1, not left, total - left, digest.hexdigest(), kind, None, part
        if source.line()[0] or source.line()[0]:
            raise ValueError(f"{path}: {name} doesn't end where it should")


def decide(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``winner`` for every payload of at least ``least`` bytes that comes more than once: the largest page_id with it."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.sha1(payload).alias("of_sha1"), F.octet_length(payload).alias("n_bytes"), F.col("page_id").cast("long").alias("page_id"))
    groups = rows.where(F.col("n_bytes") >= least).groupBy("of_sha1").agg(F.max("page_id").alias("winner"), F.count("*").alias("n"))
    return materialize(groups.where("n > 1 and winner is not null").select("of_sha1", "winner"), "payloads")


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_REVISIT, size: int = CHUNK) -> DataFrame:
    """Write a record for every row of ``pages`` (page_id, url, html) to archives in ``folder``, one a task; returns path, n_records.

    A null html is an empty payload, a null url leaves the target out. Of rows with equal payloads, one whose page_id is the
    largest is the response, with all rows that have this very id; a group of null ids only is all responses.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha1"))
    is_revisit = F.col("winner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("winner"))
    judged = rows.join(decide(pages, least), F.col("sha1") == F.col("of_sha1"), "left").select("page_id", "url", "payload", "sha1", is_revisit.alias("is_revisit"), "winner")
    n_bytes, last = F.octet_length("payload"), F.when(F.col("is_revisit"), 0).otherwise(F.greatest(F.ceil(F.octet_length("payload") / size) - 1, F.lit(0))).cast("int")
    # a record's chunks follow one another in its task; they are cut one by one, as the rows go to Python
    cut = judged.select("*", F.explode(F.sequence(F.lit(0), last)).alias("no"))
    data = F.when(F.col("is_revisit"), F.lit(b"")).otherwise(F.substring("payload", F.col("no") * size + 1, F.lit(size)))
    rows = cut.select("page_id", "url", n_bytes.cast("long").alias("n_bytes"), "sha1", "is_revisit", "winner", "no", (F.col("no") == last).alias("last"), data.alias("data"))

    def write(batches):
        from pyspark import TaskContext

        path, out, n, digest = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz", None, 0, None
        for b in batches:
            told = zip(*(b.column(c).to_pylist() for c in range(8)), strict=True)
            for (page_id, url, n_bytes, sha1, is_revisit, winner, no, last), data in zip(told, b.column(8), strict=True):
                out = out or WarcWriter(path)
                if no == 0:
                    out.begin(page_id, url, n_bytes, sha1, winner, is_revisit)
                    digest = hashlib.sha1(usedforsecurity=False)
                if not is_revisit:
                    digest.update(data.as_buffer())
                    out.chunk(data.as_buffer())
                if last:
                    if not is_revisit and digest.hexdigest() != sha1:
                        raise ValueError(f"the chunks of page {page_id} don't fit its digest")
                    out.end()
                    n += 1
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "n_records"])

    fs, inner = open_fs(folder)
    fs.create_dir(inner, recursive=True)
    return materialize(rows.mapInArrow(write, "path string, n_records long"), "archives")


def read_archives(manifest: DataFrame, with_data: bool = True, size: int = CHUNK) -> DataFrame:
    """The chunk table of archives: one row a chunk, the data left out unless asked for; revisits have one row."""
    names = [x.split()[0] for x in CHUNK_SCHEMA.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]

    def read(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                rows, held = [], 0
                for r in read_chunks(path, size):
                    rows.append(r if with_data else (*r[:7], None))
                    held += 200 + len(r[7]) * with_data
                    if held > ROWS_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    files = manifest.select("path").repartition(max(1, manifest.count()))
    return files.mapInArrow(read, CHUNK_SCHEMA)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write archives in the shared folder and read them back, one row a record: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Every payload was checked against its digest on reading. An empty table makes no archive and gives an empty table.
    """
    folder = fresh_path(pages.sparkSession, "warc")
    table = read_archives(write_archives(pages, folder), with_data=False).where("last")
    page = lambda c: F.regexp_extract(c, "<urn:page:(-?[0-9]+)>", 1)
    return table.select(
        F.nullif(page("record_id"), F.lit("")).cast("long").alias("page_id"), F.col("n_bytes").alias("payload_bytes"), F.col("sha1").alias("payload_digest"),
        "record_type", F.nullif(page("refers_to"), F.lit("")).cast("long").alias("refers_to"),
    )
