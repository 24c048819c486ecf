"""WARC archives as chunked record tables.

Writing: each task streams its pages into one gzip archive, a member per record. Reading: each task
streams archives and gives rows of (record_id, chunk_no, data), so a payload of any size passes in
chunks, with the digest carried from chunk to chunk and put on the last one. Of equal payloads one is
stored, as a response; the others become revisit records that refer to it.

Archives are opened by ``pyarrow.fs``, so any shared store that it knows will do. A task writes under
a name of its own attempt and renames the file when it is whole; a repeated task replaces it.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.llm.shared import fresh_path, keep

CHUNK = 1 << 18
#: Payloads with copies whose digests are broadcast, at about 100 bytes each.
MOST_BROADCAST = 200_000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CHUNKS = (
    "record_id string, page_id long, record_type string, refers_to string, declared_digest string, declared_bytes long, "
    "chunk_no long, chunk_bytes long, bytes_so_far long, data binary, digest string"
)


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _header(fields: list[tuple[str, str | None]]) -> bytes:
    lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in fields if v is not None]]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def _one_line(text: str | None) -> str | None:
    return None if text is None else " ".join(text.split())


def write_archives(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Write an archive for each partition of the pages to a folder; (archive, records) of each.

    Of payloads that are equal and have min_bytes at least, the one with the largest page_id is the
    response (every row that has this identifier, if it is repeated); the others revisit it. Null
    payloads are empty, null identifiers the smallest. Rows alike in both are one record written more
    than once. Only digests of copies join the pages; payloads of any size pass in chunks, and an empty
    table gives no archive. Columns other than the three named are ignored, whatever their names.
    """
    groups = keep(_copies(pages, id_col, payload_col, min_bytes), "warc-copies")
    if groups.count() <= MOST_BROADCAST:
        groups = F.broadcast(groups)  # payloads stay where they are; more copies are met by a shuffle
    payload = F.coalesce(pages[payload_col].cast("binary"), F.lit(b""))
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    joined = rows.join(groups, ["digest"], "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    stored = F.when(refers.isNull(), F.col("payload"))
    work = joined.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("n_bytes"), refers.alias("refers_to"), stored.alias("payload"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}.warc.gz"
        draft = f"{root}/.{name}.{context.taskAttemptId()}"
        n, out = 0, None
        for batch in batches:
            for row in range(batch.num_rows):
                page, url, digest, size, refers_to, data = (batch.column(k)[row] for k in range(6))
                out = out or store.open_output_stream(draft, compression=None)
                _write_record(out, page.as_py(), url.as_py(), digest.as_py(), size.as_py(), refers_to.as_py(), data.as_buffer(), chunk)
                n += 1
        if out:
            out.close()
            store.move(draft, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([f"{path}/{name}"]), pa.array([n], pa.int64())], ["archive", "records"])

    return work.mapInArrow(task, "archive string, records long")


def _copies(pages: DataFrame, id_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """(digest, first): of payloads that occur more than once, the largest page_id."""
    payload = F.coalesce(pages[payload_col].cast("binary"), F.lit(b""))
    thin = pages.select(pages[id_col].cast("long").alias("page_id"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("n_bytes"))
    groups = thin.where(F.col("n_bytes") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    return groups.where("copies > 1").select("digest", "first")


def _write_record(out, page: int | None, url: str | None, digest: str, size: int, refers_to: int | None, data: pa.Buffer | None, chunk: int) -> None:
    """One record as a gzip member, its payload compressed chunk by chunk."""
    revisit = refers_to is not None
    length = len(data) if data is not None and not revisit else 0
    head = _header(
        [
            ("WARC-Type", "revisit" if revisit else "response"),
            ("WARC-Record-ID", f"<{_urn(page, digest, revisit)}>"),
            ("WARC-Date", DATE),
            ("WARC-Target-URI", _one_line(url)),
            ("WARC-Payload-Digest", "sha1:" + base32_sha1(bytes.fromhex(digest))),
            ("WARC-Profile", PROFILE if revisit else None),
            ("WARC-Refers-To", f"<{_urn(refers_to, digest, False)}>" if revisit else None),
            ("X-Page-ID", None if page is None else str(page)),
            ("X-Refers-To-Page-ID", str(refers_to) if revisit else None),
            ("X-Payload-Length", str(size)),
            ("Content-Type", "text/html"),
            ("Content-Length", str(length)),
        ]
    )
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    out.write(pack.compress(head))
    for at in range(0, length, chunk):
        out.write(pack.compress(memoryview(data)[at : at + chunk]))
    out.write(pack.compress(b"\r\n\r\n") + pack.flush())


def _urn(page: int | None, digest: str, revisit: bool) -> str:
    """A record's identifier follows from its page and payload, so that a repeated task writes the same."""
    h = hashlib.md5(f"{page} {digest} {revisit}".encode(), usedforsecurity=False).hexdigest()
    return f"urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"


class RecordStream:
    """Records of an archive, read member by member; holds a chunk at a time."""

    def __init__(self, file, chunk: int) -> None:
        self.file, self.chunk = file, chunk
        self.left = b""  # compressed bytes that were read and not used
        self.member = None
        self.plain = bytearray()

    def _more(self) -> bool:
        """Add some plain bytes; False at the end of the archive."""
        while True:
            data = self.left or self.file.read(1 << 16)
            if not data:
                return False
            if self.member is None:
                self.member = zlib.decompressobj(31)
            made = self.member.decompress(data, self.chunk)
            self.left = self.member.unconsumed_tail or self.member.unused_data
            if self.member.eof:
                self.member = None
            if made:
                self.plain += made
                return True

    def _until(self, mark: bytes) -> bytes | None:
        at = -1
        while (at := self.plain.find(mark)) < 0:
            if not self._more():
                return None
        found = bytes(self.plain[:at])
        del self.plain[: at + len(mark)]
        return found

    def _take(self, n: int) -> bytes:
        while len(self.plain) < n and self._more():
            pass
        found = bytes(self.plain[:n])
        del self.plain[:n]
        return found

    def chunks(self) -> Iterator[tuple]:
        """(header, chunk number, data, bytes so far, digest or None) for each chunk of each record."""
        while (head := self._until(b"\r\n\r\n")) is not None:
            header = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
            length, done, n, sha = int(header["Content-Length"]), 0, 0, hashlib.sha1(usedforsecurity=False)
            while True:
                data = self._take(min(self.chunk, length - done))
                if len(data) < min(self.chunk, length - done):
                    raise ValueError("the archive ends inside a record")
                done += len(data)
                sha.update(data)
                last = done == length
                yield header, n, data, done, base32_sha1(sha.digest()) if last else None
                n += 1
                if last:
                    break
            self._take(4)


def read_chunks(archives: DataFrame, *, archive_col: str = "archive", chunk: int = CHUNK, data: bool = True) -> DataFrame:
    """The chunk rows of archives. data=False leaves the payload out, and keeps lengths and digests."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for archive in batch.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(archive)
                with store.open_input_stream(path, compression=None) as file:
                    rows, held = [], 0
                    for header, n, part, done, digest in RecordStream(file, chunk).chunks():
                        page, refers = header.get("X-Page-ID"), header.get("X-Refers-To-Page-ID")
                        rows.append((header["WARC-Record-ID"].strip("<>"), None if page is None else int(page), header["WARC-Type"], refers, header["WARC-Payload-Digest"].removeprefix("sha1:"), int(header["X-Payload-Length"]), n, len(part), done, part if data else None, digest))
                        held += len(part) if data else 64
                        if held >= 1 << 22 or len(rows) >= 4096:
                            yield _chunk_batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield _chunk_batch(rows)

    return archives.select(archive_col).mapInArrow(task, CHUNKS)


_TYPES = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


def _chunk_batch(rows: list[tuple]) -> pa.RecordBatch:
    fields = [x.split() for x in CHUNKS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(values, _TYPES[kind]) for values, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)], [name for name, _ in fields])


def records(chunks: DataFrame) -> DataFrame:
    """A row per record, from its last chunk: page_id, payload_bytes, payload_digest, record_type, refers_to.

    For a response, length and digest are those of what was read; for a revisit, of the payload that
    it refers to, as declared.
    """
    revisit = F.col("record_type") == "revisit"
    return chunks.where("digest is not null").select(
        "page_id",
        F.when(revisit, F.col("declared_bytes")).otherwise(F.col("bytes_so_far")).alias("payload_bytes"),
        F.when(revisit, F.col("declared_digest")).otherwise(F.col("digest")).alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
        "record_id",
    )


def round_trip(spark: SparkSession, pages: DataFrame, **options: object) -> DataFrame:
    """Write the pages to archives in the shared folder and give the records read back from them."""
    archives = keep(write_archives(pages, fresh_path(spark, "warc"), **options), "warc-index")
    return records(read_chunks(archives, data=False))
