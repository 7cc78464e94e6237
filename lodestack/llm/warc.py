"""WARC archives over a chunked record table.

A record's payload is a run of rows (record identifier, chunk number, bytes). The writer
streams the chunks of a record into its gzip member and the reader streams them out again,
both with an incremental SHA-256, so neither holds more than a chunk of a record.

Of records with equal payloads of at least ``LEAST_REVISIT`` bytes the one with the
smallest page_id is written as response, the others as revisits of it.

Every record has an identifier of its own, made of its page_id, digest and place in the input, and
a revisit names its response's. Places are those of the scan, which the digests and the writer
read alike; of an input that is no table of files write it first.

Files get a new name per task attempt; only those in the manifest, a table in the shared
folder, belong to the archive, so repeated or lost attempts leave no records behind.

Edge cases: a null html is an empty payload; a null url writes no target; a null page_id comes
after all others (a revisit if its payload has a response with an id); rows with
the same page_id are records of their own, and each copy of a response's row is a
response; an empty table makes an archive without files; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import shared_path

CHUNK_BYTES, LEAST_REVISIT, ARCHIVE_BYTES = 64 * 1024, 100, 256 * 1024 * 1024
#: Duplicated payloads that may be broadcast, about 80 bytes each; with more, both sides are shuffled.
BROADCAST_PAYLOADS = 50_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
CHUNKS = "record_id string, page_id long, record_type string, refers_to long, declared string, chunk_no long, data binary, payload_bytes long, payload_digest string, last boolean"


def open_store(uri: str):
    """A pyarrow file system and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (fs.LocalFileSystem(), uri)


def record_id(page_id: int | None, digest: str, place: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}:{digest}:{place}')}>"


def chunk_table(pages: DataFrame, least: int = LEAST_REVISIT, chunk: int = CHUNK_BYTES) -> DataFrame:
    """page_id, place, url, digest, payload_bytes, first_id, first_place, chunk_no, data; a record's rows follow each other.

    ``first_id``: the page to revisit, null for a response, which alone has data.
    """
    payload = F.coalesce(pages["html"], F.lit("")).cast("binary")
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), F.monotonically_increasing_id().alias("place"), pages["url"], payload.alias("payload"))
    rows = rows.select("*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    first = rows.where(F.col("payload_bytes") >= least).groupBy("digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "place"))).alias("first"), F.count("*").alias("n"))
    first = first.where("n > 1").select(F.col("digest").alias("__digest"), F.col("first.page_id").alias("first_id"), F.col("first.place").alias("first_place"))
    path = shared_path(pages.sparkSession, "payloads")
    first.write.parquet(path)
    first = pages.sparkSession.read.schema(first.schema).parquet(path)
    first = F.broadcast(first) if first.count() <= BROADCAST_PAYLOADS else first
    joined = rows.join(first, F.col("digest") == F.col("__digest"), "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id"))
    pieces = F.when(revisit, 0).otherwise(F.greatest(F.lit(0), F.ceil(F.col("payload_bytes") / chunk) - 1)).cast("int")
    named = joined.select("page_id", "place", "url", "digest", "payload_bytes", F.when(revisit, F.col("first_id")).alias("first_id"), "first_place", "payload", F.explode(F.sequence(F.lit(0), pieces)).alias("chunk_no"))
    data = F.when(F.col("first_id").isNull(), F.substring(F.col("payload"), F.col("chunk_no") * chunk + 1, F.lit(chunk)))
    return named.select("page_id", "place", "url", "digest", "payload_bytes", "first_id", "first_place", "chunk_no", data.alias("data"))


def http_head(payload_bytes: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()


def header(page_id: int | None, place: int, url: str | None, digest: str, payload_bytes: int, first_id: int | None, first_place: int | None, date: str) -> bytes:
    """A record's WARC header, and for a response the head of its HTTP message."""
    target = "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    head = b"" if first_id is not None else http_head(payload_bytes)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first_id is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest, place)}",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {target}"] if target else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(first_id, digest, first_place)}", f"X-Refers-To-Page: {first_id}"] if first_id is not None else []),
        *([f"X-Page: {page_id}"] if page_id is not None else []),
        f"X-Payload-Length: {payload_bytes}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {(len(head) + payload_bytes) if first_id is None else 0}",
        "",
        "",
    ]
    return "\r\n".join(lines).encode() + head


def write_archives(chunks: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, date: datetime | None = None) -> DataFrame:
    """Writes the chunk table as .warc.gz files, a gzip member per record; the manifest (archive, records, bytes).

    ``date``: when the pages were fetched, by default now.
    """
    written = (date or datetime.now(timezone.utc)).astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches):
        import pyarrow as pa

        store, base = open_store(folder)
        file = name = squeeze = None
        records = size = 0
        digest, wanted, left = hashlib.sha256(), "", 0
        done = []

        def put(data: bytes) -> None:
            nonlocal size
            file.write(data)
            size += len(data)

        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            for i in range(batch.num_rows):
                page_id, place, url, sha, payload_bytes, first_id, first_place, chunk_no, data = (c[i].as_py() for c in columns)
                if chunk_no == 0:
                    if file is not None and size >= archive_bytes:
                        file.close()
                        done.append((name, records, size))
                        file = None
                    if file is None:
                        name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                        store.create_dir(base, recursive=True)
                        file = store.open_output_stream(f"{base}/{name}", compression=None)
                    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
                    put(squeeze.compress(header(page_id, place, url, sha, payload_bytes, first_id, first_place, written)))
                    digest, wanted, left = hashlib.sha256(), sha, payload_bytes if first_id is None else 0
                if first_id is None and data:
                    digest.update(data)
                    left -= len(data)
                    put(squeeze.compress(data))
                if left == 0:
                    if first_id is None and digest.hexdigest() != wanted:
                        raise ValueError(f"payload of page {page_id} changed while it was written")
                    put(squeeze.compress(b"\r\n\r\n") + squeeze.flush())
                    records += 1
        if file is not None:
            file.close()
            done.append((name, records, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in done], t) for j, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["archive", "records", "bytes"])

    manifest = f"{folder}/manifest"
    chunks.mapInArrow(run, "archive string, records long, bytes long").write.parquet(manifest)
    return chunks.sparkSession.read.schema("archive string, records long, bytes long").parquet(manifest)


class Member:
    """One gzip member after another of a stream, in pieces of bounded size."""

    def __init__(self, stream, piece: int = CHUNK_BYTES):
        self.stream, self.piece, self.raw, self.squeezed = stream, piece, b"", None
        self.text = bytearray()

    def next(self) -> bool:
        """Whether there is another member; it becomes the current one."""
        while self.squeezed is not None and not self.squeezed.eof:
            self.text.clear()
            if not self.more():
                raise ValueError("the archive ends inside a record")
        self.text.clear()
        if self.squeezed is not None:
            self.raw = self.squeezed.unused_data
        self.raw = self.raw or self.stream.read(self.piece)
        if not self.raw:
            return False
        self.squeezed = zlib.decompressobj(31)
        return True

    def more(self) -> bool:
        """Adds a piece of the member's text; False at its end."""
        if self.squeezed.eof:
            return False
        data = self.squeezed.unconsumed_tail or self.raw or self.stream.read(self.piece)
        self.raw = b""
        if not data:
            return False
        self.text += self.squeezed.decompress(data, self.piece)
        return True

    def until(self, mark: bytes) -> bytes:
        """The text up to and with ``mark``."""
        while (at := self.text.find(mark)) < 0:
            if not self.more():
                raise ValueError("a record without the end of its header")
        found = bytes(self.text[: at + len(mark)])
        del self.text[: at + len(mark)]
        return found

    def take(self, size: int) -> Iterator[bytes]:
        """``size`` bytes in pieces."""
        while size:
            if not self.text and not self.more():
                raise ValueError("a record shorter than its length")
            part = bytes(self.text[: min(size, self.piece)])
            del self.text[: len(part)]
            size -= len(part)
            if part:
                yield part


def records(stream) -> Iterator[tuple[dict[str, str], Iterator[bytes]]]:
    """Header fields (lower-case names) and payload pieces of each record, to be read in order."""
    member = Member(stream)
    while member.next():
        lines = member.until(b"\r\n\r\n").decode("utf-8").split("\r\n")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}
        length = int(fields["content-length"])
        if fields["warc-type"] == "response" and length:
            length -= len(member.until(b"\r\n\r\n"))
        yield fields, member.take(length)


def read_archives(manifest: DataFrame, folder: str, with_data: bool = True) -> DataFrame:
    """The chunk table of the archives: each chunk with the bytes and the digest so far.

    For a revisit the one row has the length and the digest that its header declares. Without
    ``with_data`` only the last chunk of each record is returned, and no bytes.
    """

    def run(batches):
        import pyarrow as pa

        names = ["record_id", "page_id", "record_type", "refers_to", "declared", "chunk_no", "data", "payload_bytes", "payload_digest", "last"]
        types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]
        rows: list[tuple] = []
        flush = lambda: pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(types)], names=names)
        number = lambda fields, name: int(fields[name]) if name in fields else None
        store, base = open_store(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for fields, pieces in records(stream):
                        declared = fields["warc-payload-digest"].partition(":")[2]
                        head = (fields["warc-record-id"], number(fields, "x-page"), fields["warc-type"], number(fields, "x-refers-to-page"), declared)
                        if fields["warc-type"] == "revisit":
                            rows.append((*head, 0, None, int(fields["x-payload-length"]), declared, True))
                        else:
                            digest, size, k, data = hashlib.sha256(), 0, -1, None
                            for k, part in enumerate(pieces):
                                if with_data and data is not None:
                                    rows.append((*head, k - 1, data, size, digest.hexdigest(), False))
                                digest.update(part)
                                size += len(part)
                                data = part
                            if digest.hexdigest() != declared:
                                raise ValueError(f"payload of record {head[0]} isn't what its digest says")
                            rows.append((*head, max(k, 0), data if with_data else None, size, digest.hexdigest(), True))
                        if len(rows) >= (64 if with_data else 4096):
                            yield flush()
                            rows = []
        if rows:
            yield flush()

    return manifest.select("archive").repartition(max(1, min(4096, manifest.count()))).mapInArrow(run, CHUNKS)


def archive_pages(pages: DataFrame, folder: str | None = None) -> tuple[DataFrame, str]:
    """Writes ``pages`` (page_id, url, html) into a folder of archives; its manifest and the folder."""
    folder = folder or shared_path(pages.sparkSession, "warc")
    return write_archives(chunk_table(pages), folder), folder


def archive_report(pages: DataFrame) -> DataFrame:
    """Writes the archives, reads them again: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    manifest, folder = archive_pages(pages)
    return read_archives(manifest, folder, with_data=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
