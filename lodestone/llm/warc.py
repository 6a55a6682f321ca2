"""WARC archives written from a page table and read back as a table of payload chunks.

Writers and readers pass a payload on in pieces of ``CHUNK`` bytes: compression, digest
and reading are incremental, and the chunk table has a row for each record identifier and
chunk number, so no task holds a second copy of an oversized record. Archives are written
to the shared folder under a temporary name, renamed when whole, and read by the manifest
that the finished tasks returned, so files of lost or repeated attempts are never read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._shared import qualified, scratch, table

CHUNK = 1 << 16
#: Compressed bytes after which a writer starts its next archive.
ARCHIVE = 1 << 28
#: Equal payloads of at least so many bytes are written once and then revisited.
LEAST = 0
PREFIX = "urn:page:"
CRLF = b"\r\n"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def pieces(data: memoryview) -> Iterator[memoryview]:
    for at in range(0, len(data), CHUNK):
        yield data[at : at + CHUNK]


def open_files(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, given with its scheme, and the path within it."""
    return fs.FileSystem.from_uri(folder)


class Archive:
    """One gzip member a record, as readers of the format expect."""

    def __init__(self, folder: str) -> None:
        self.files, self.folder = open_files(folder)
        self.files.create_dir(self.folder, recursive=True)
        self.name = f"part-{uuid.uuid4().hex}.warc.gz"
        self.stream = self.files.open_output_stream(f"{self.folder}/_{self.name}", compression=None)
        self.written = self.records = 0

    def add(self, page_id, url: str | None, payload: memoryview, refers_to) -> None:
        digest = hashlib.sha1()
        for piece in pieces(payload):
            digest.update(piece)
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        body = len(payload) if refers_to is None else 0
        head = [
            "WARC/1.1",
            f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <{PREFIX}{'' if page_id is None else page_id}>",
            "WARC-Date: 1970-01-01T00:00:00Z",
            f"WARC-Payload-Digest: sha1:{base32(digest.digest())}",
            "Content-Type: application/http; msgtype=response",
            f"Content-Length: {len(http) + body}",
        ]
        if url is not None:
            head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
        if refers_to is not None:
            head += [f"WARC-Refers-To: <{PREFIX}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        packer = zlib.compressobj(1, wbits=31)
        self._put(packer.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + CRLF + CRLF + http))
        for piece in pieces(payload) if refers_to is None else ():
            self._put(packer.compress(piece))
        self._put(packer.compress(CRLF + CRLF) + packer.flush())
        self.records += 1

    def _put(self, data: bytes) -> None:
        if data:
            self.stream.write(data)
            self.written += len(data)

    def close(self) -> tuple[str, int, int]:
        self.stream.close()
        self.files.move(f"{self.folder}/_{self.name}", f"{self.folder}/{self.name}")
        return self.name, self.records, self.written


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, archive = [], None
        for batch in batches:
            payloads = batch.column(2).cast(pa.large_binary())
            for i in range(batch.num_rows):
                if archive is None or archive.written >= ARCHIVE:
                    done += [archive.close()] if archive else []
                    archive = Archive(folder)
                payload = memoryview(payloads[i].as_buffer() or b"").cast("B")
                archive.add(batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), payload, batch.column(3)[i].as_py())
        done += [archive.close()] if archive else []
        names, records, written = zip(*done) if done else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(records, pa.int64()), pa.array(written, pa.int64())], ["name", "records", "bytes"])

    return write


class Unpacked:
    """Buffered reading over the concatenated gzip members of an archive."""

    def __init__(self, stream) -> None:
        self.stream, self.raw, self.data, self.packer, self.at = stream, b"", bytearray(), zlib.decompressobj(31), 0

    def _fill(self) -> bool:
        while True:
            if not self.raw:
                self.raw = self.stream.read(CHUNK)
                if not self.raw:
                    return False
            got = self.packer.decompress(self.raw, CHUNK)
            self.raw = self.packer.unconsumed_tail or self.packer.unused_data
            if self.packer.eof:
                self.packer = zlib.decompressobj(31)
            if got:
                if self.at > CHUNK:
                    del self.data[: self.at]
                    self.at = 0
                self.data += got
                return True

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the archive."""
        while (end := self.data.find(CRLF, self.at)) < 0:
            if not self._fill():
                return None
        found = bytes(self.data[self.at : end])
        self.at = end + 2
        return found

    def take(self, n: int) -> bytes:
        """Up to ``n`` bytes."""
        while len(self.data) - self.at < n and self._fill():
            pass
        found = bytes(self.data[self.at : self.at + n])
        self.at += len(found)
        return found

    def header(self) -> dict[str, str] | None:
        first = self.line()
        if first is None:
            return None
        found = {"": first.decode()}
        while line := self.line():
            key, _, value = line.decode("utf-8", "surrogatepass").partition(":")
            found[key.strip().lower()] = value.strip()
        return found


def records(stream) -> Iterator[tuple[dict, dict, Iterator[bytes]]]:
    """Header, HTTP header and payload pieces of each record. The pieces of one must be used up before the next."""
    source = Unpacked(stream)
    while (head := source.header()) is not None:
        if not head[""].startswith("WARC/"):
            raise ValueError(f"no record starts with {head['']!r}")
        http, length = {}, int(head["content-length"])
        if head.get("content-type", "").startswith("application/http"):
            size = 0
            while (line := source.line()) is not None:
                size += len(line) + 2
                if not line:
                    break
                key, _, value = line.decode("latin-1").partition(":")
                http[key.strip().lower()] = value.strip()
            length -= size

        def payload(left: int = length) -> Iterator[bytes]:
            while left:
                piece = source.take(min(left, CHUNK))
                if not piece:
                    raise ValueError("an archive ends within a record")
                left -= len(piece)
                yield piece

        yield head, http, payload()
        source.take(4)


CHUNKS = "archive string, record_id string, record_type string, refers_to string, target_uri string, chunk_no int, is_last boolean, payload_bytes long, payload_digest string, data binary"


def _reader(folder: str, with_data: bool):
    names = [c.split()[0] for c in CHUNKS.split(", ")]
    kinds = [pa.string()] * 5 + [pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.binary()]

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = open_files(folder)
        rows: list[tuple] = []
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with files.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for head, http, payload in records(stream):
                        ident, kind, refers = head["warc-record-id"], head["warc-type"], head.get("warc-refers-to")
                        digest, seen, no, held = hashlib.sha1(), 0, 0, None
                        for piece in payload:  # each chunk row carries the digest of all bytes so far
                            if held is not None:
                                rows.append((name, ident, kind, refers, head.get("warc-target-uri"), no, False, seen, base32(digest.digest()), held if with_data else None))
                                no += 1
                            digest.update(piece)
                            seen, held = seen + len(piece), piece
                            if len(rows) * (CHUNK if with_data else 256) >= 1 << 24:
                                yield pack(rows)
                                rows = []
                        stated = head["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response" and base32(digest.digest()) != stated:
                            raise ValueError(f"{ident} in {name} doesn't match its digest")
                        length = seen if kind == "response" else int(http["content-length"])
                        rows.append((name, ident, kind, refers, head.get("warc-target-uri"), no, True, length, stated, held if with_data else None))
        if rows:
            yield pack(rows)

    return read


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST, folder: str | None = None) -> tuple[str, DataFrame]:
    """Writes a record for each row; returns the folder and the manifest (``name, records, bytes``).

    Archives stay in ``folder``, if one is given, and otherwise in the shared folder until the application ends.

    Of equal payloads (same bytes, at least ``least``) the smallest id is the response and
    the others revisit it. Null html is an empty payload. Rows that repeat the smallest id
    are responses too; null ids never serve as response for others, and are responses
    among themselves.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    key = F.sha2(F.col("html").cast("binary"), 256)
    first = rows.where(F.octet_length("html") >= least).groupBy(key.alias("same")).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("same", "first")
    first = table(first, "responses")  # so that the join has exchanges of its own, which it can split where a payload is hot
    joined = rows.withColumn("key", key).join(first, F.col("key") == F.col("same"), "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.col("first"))
    folder = qualified(pages.sparkSession, folder) if folder else scratch(pages.sparkSession, "warc")
    manifest = joined.select("id", "url", "html", refers.alias("refers_to")).mapInArrow(_writer(folder), "name string, records long, bytes long")
    return folder, table(manifest, "manifest")


def read_chunks(folder: str, manifest: DataFrame, with_data: bool = True) -> DataFrame:
    """The chunk table (``CHUNKS``) of the archives that ``manifest`` names.

    ``payload_bytes`` and ``payload_digest`` of a chunk hold for all bytes up to its end;
    in the row with ``is_last`` for the whole payload (for a revisit, that of the response
    it refers to). An empty payload has one row. A payload that doesn't match its digest
    stops the job.
    """
    n = max(1, manifest.count())
    return manifest.select("name").repartition(min(n, 100_000), "name").mapInArrow(_reader(folder, with_data), CHUNKS)


def _page(column: str):
    return F.regexp_extract(F.col(column), f"<{PREFIX}(.*)>", 1).try_cast("long")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST) -> DataFrame:
    """Writes and reads back: ``id_col, payload_bytes, payload_digest, record_type, refers_to, target_uri`` for each row of ``pages``.

    Edge cases are those of ``write``: null html is an empty payload, null ids come back null, repeated rows are records of their
    own, payloads of any size pass in chunks, further columns aren't read, and an empty table gives no rows.
    """
    folder, manifest = write(pages, id_col, url_col, html_col, least)
    last = read_chunks(folder, manifest, with_data=False).where("is_last")
    return last.select(_page("record_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", _page("refers_to").alias("refers_to"), "target_uri")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS x FROM p),
f AS (SELECT x, min(page_id) AS first FROM d GROUP BY x)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(d.x, ((i // 4) * 5 + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d JOIN f ON d.x = f.x
"""
