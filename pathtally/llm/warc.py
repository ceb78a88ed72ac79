"""WARC archives through a chunked record table.

Writing: a map task streams each record into its own gzip member of an archive, slice by slice.
A record whose payload equals that of a smaller id becomes a revisit that names it. Reading: a
task streams an archive, never holding more than a slice of a record, and emits rows
(record id, chunk number, bytes, digest so far); the row marked last has the whole digest, which
is compared with the record's header. Archives and their manifest lie in the shared folder; a
task that runs twice leaves a file which no manifest names.

Null html: empty payload. Empty payloads equal each other, so all but the first are revisits
(``revisit_from`` is the least size at which a payload may be revisited). Null ids are written as
responses and come back null; rows that repeat the smallest id of their payload are all responses.
Null urls become an empty target. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SLICE = 1 << 20
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, records long"
CHUNKS = (
    "record_id string, page_id long, chunk long, n_bytes long, digest_so_far string, last boolean, "
    "record_type string, refers_to long, payload_bytes long, payload_digest string, url string"
)


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def of_urn(value: str | None) -> int | None:
    number = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def one_line(value: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value or "")


def head(page_id: int | None, url: str | None, size: int, sha1: bytes, refers_to: int | None) -> tuple[bytes, bytes]:
    """The record's own header and the HTTP header that begins its block."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    revisit = refers_to is not None
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {urn(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {one_line(url)}",
        f"WARC-Payload-Digest: sha1:{base32(sha1)}",
        *([f"WARC-Refers-To: {urn(refers_to)}", f"WARC-Profile: {PROFILE}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (0 if revisit else size)}",
    ]
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "surrogatepass"), http


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_from: int = 0) -> DataFrame:
    """Writes archives below ``folder`` (a URI that pyarrow opens); returns their manifest.

    Digests are taken in the JVM; the least id of each payload is found by an aggregate of
    (digest, id), of which only payloads that occur twice are joined back.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload")
    ).withColumn("sha1", F.unhex(F.sha1("payload")))
    firsts = (
        rows.where(F.octet_length("payload") >= revisit_from).groupBy("sha1").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
        .where("first < last").select("sha1", "first")
    )
    typed = rows.join(firsts, "sha1", "left").select("page_id", "url", "payload", "sha1", F.when(F.col("page_id") > F.col("first"), F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        task = TaskContext.get()
        system, path = fs.FileSystem.from_uri(f"{folder}/archive-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz")
        out, n = None, 0
        for batch in batches:
            for k in range(batch.num_rows):
                page_id, url, payload, sha1, refers_to = (batch.column(c)[k] for c in range(5))
                view = memoryview(payload.as_buffer())
                lead, http = head(page_id.as_py(), url.as_py(), len(view), sha1.as_py(), refers_to.as_py())
                if out is None:
                    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    out = system.open_output_stream(path, compression=None)
                z = zlib.compressobj(1, zlib.DEFLATED, 31)
                out.write(z.compress(lead + http))
                if not refers_to.is_valid:
                    for at in range(0, len(view), SLICE):
                        out.write(z.compress(view[at : at + SLICE]))
                out.write(z.compress(b"\r\n\r\n") + z.flush())
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{path.rsplit('/', 1)[1]}"]), pa.array([n], pa.int64())], names=["path", "records"])

    return common.stage(typed.mapInArrow(run, MANIFEST), folder, "manifest")


def inflate(source) -> Iterator[bytes]:
    """The bytes of all gzip members of a stream, in slices of bounded size."""
    z, rest = zlib.decompressobj(31), b""
    while True:
        raw = rest or source.read(SLICE)
        if not raw:
            return
        if data := z.decompress(raw, SLICE):
            yield data
        if z.eof:
            rest, z = z.unused_data, zlib.decompressobj(31)
        else:
            rest = z.unconsumed_tail


def records(slices: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers, payload slice) in order, and (headers, None) at the end of each record.

    'http-length' among the headers is the payload's length by the HTTP header.
    """
    held = b""

    def more() -> bool:
        nonlocal held
        if (data := next(slices, None)) is None:
            return False
        held += data
        return True

    def block() -> dict[str, str] | None:
        nonlocal held
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("the archive ends within a header")
                return None
        lines = held[:end].decode("utf-8", "surrogatepass").split("\r\n")
        held = held[end + 4 :]
        return {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}

    while (fields := block()) is not None:
        # the HTTP header counts within Content-Length
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                raise ValueError("the archive ends within a record")
        size = end + 4
        http = block()
        fields["http-length"] = http["content-length"]
        left = int(fields["content-length"]) - size
        while left:
            want = min(left, SLICE)
            while len(held) < want:
                if not more():
                    raise ValueError("the archive ends within a payload")
            part, held = held[:want], held[want:]
            left -= len(part)
            yield fields, part
        yield fields, None
        while len(held) < 4:
            if not more():
                raise ValueError("the archive ends within a record")
        held = held[4:]


def chunks_of(slices: Iterator[bytes], with_data: bool = False) -> Iterator[tuple]:
    """Rows of CHUNKS (and the bytes) for one archive. A record without payload has one empty chunk."""
    digest, number, count = hashlib.sha1(), 0, 0
    pending: tuple[int, bytes] | None = None
    for fields, part in records(slices):
        if part is not None:
            if pending is not None:
                yield row(fields, number, pending, digest_at, False, None, count, with_data)
                number += 1
            digest.update(part)
            count += len(part)
            pending, digest_at = (len(part), part), digest.copy()
            continue
        stated = fields["warc-payload-digest"].removeprefix("sha1:")
        if fields["warc-type"] == "response":
            if base32(digest.digest()) != stated or count != int(fields["http-length"]):
                raise ValueError(f"record {fields['warc-record-id']}: the payload does not match its digest")
        yield row(fields, number, pending or (0, b""), digest, True, stated, int(fields["http-length"]), with_data)
        digest, number, count, pending = hashlib.sha1(), 0, 0, None


def row(fields, number, part, digest, last, stated, count, with_data) -> tuple:
    own = (
        fields["warc-record-id"], of_urn(fields["warc-record-id"]), number, part[0], base32(digest.digest()), last, fields["warc-type"],
        of_urn(fields.get("warc-refers-to")), count, stated, fields["warc-target-uri"],
    )
    return (*own, part[1]) if with_data else own


def read_chunks(manifest: DataFrame, with_data: bool = False, tasks: int | None = None) -> DataFrame:
    """The chunk table of the archives in ``manifest`` (column path); ``with_data`` adds the bytes.

    ``payload_bytes`` and ``payload_digest`` are of the whole payload in a record's last row; a
    revisit has them from its header. Archives are dealt round robin over ``tasks`` tasks.
    """
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = [x.split()[0] for x in CHUNKS.split(", ")]
    if with_data:
        kinds, names = [*kinds, pa.binary()], [*names, "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for paths in batches:
            for path in paths.column(0).to_pylist():
                system, at = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with system.open_input_stream(at, compression=None, buffer_size=SLICE) as source:
                    for r in chunks_of(inflate(source), with_data):
                        rows.append(r)
                        held += r[3]
                        if len(rows) >= 1000 or with_data and held >= 8 * SLICE:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    n = tasks or 3 * manifest.sparkSession.sparkContext.defaultParallelism
    return manifest.select("path").repartition(n).mapInArrow(run, CHUNKS + (", data binary" if with_data else ""))


def archive_pages(pages: DataFrame, folder: str | None = None, **columns) -> DataFrame:
    """Writes every page, reads all archives back and returns one row per record."""
    folder = folder or common.shared_dir(pages.sparkSession)
    manifest = write_archives(pages, folder, **columns)
    return read_chunks(manifest).where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
