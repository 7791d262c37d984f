"""WARC archives: a writer with revisit records, and a sequential reader that checks what it reads."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import materialize, scratch_path
from citeloom.plans.checkpoint import hadoop_path

#: An archive is closed when it has this many bytes; the next record begins another.
ARCHIVE_BYTES = 32 << 20
READ_BYTES = 1 << 18
MANIFEST = "path string, records long, bytes long"


def store_uri(spark, folder: str) -> str:
    """folder as a URI under which pyarrow, in the workers, reaches the same store as Spark; an error if there is none.

    Spark resolves the folder, so that a path without a scheme means the cluster's default file system. A small file is
    then written with pyarrow and looked for with Spark before any task runs.
    """
    files, path = hadoop_path(spark, folder)
    uri = files.makeQualified(path).toString()
    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file://" + uri[len("file:") :]
    uri = "s3:" + uri[len("s3a:") :] if uri.startswith("s3a:") else uri
    name = f"probe-{uuid.uuid4().hex}"
    try:
        store, root = fs.FileSystem.from_uri(uri)
        store.create_dir(root, recursive=True)
        store.open_output_stream(f"{root}/{name}", compression=None).close()
    except (pa.ArrowException, OSError) as error:
        raise ValueError(f"archives can't be written to {uri}: {error}") from error
    probe = path.suffix(f"/{name}")
    if not files.exists(probe):
        raise ValueError(f"{uri} is not the same store for pyarrow as for Spark")
    files.delete(probe, False)
    return uri


def _member(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(head.encode() + block + b"\r\n\r\n") + pack.flush()


def _name(page_id) -> str:
    """A page's id inside a record id: percent-encoded text; nothing for null and a bare % for the empty text."""
    return "" if page_id is None else quote(str(page_id), safe="") or "%"


def _id(name: str | None) -> str | None:
    """The id, as text, that _name() put into a record id."""
    inner = name[len("<urn:page:") : -1] if name else ""
    return None if not inner else "" if inner == "%" else unquote(inner)


def record(page_id, url: str | None, payload: bytes | None, digest: str, length: int, refers_to, date: str) -> bytes:
    """One gzip member: a response with its payload or, where refers_to is given, a revisit without."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + (payload or b"")
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{_name(page_id)}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", quote(url, safe="%/:?#[]@!$&'()*+,;=~") if url else "urn:none"),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
    ]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{_name(refers_to)}>")]
    return _member(fields, block)


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = 100, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write one record per row of pages (page_id, url, html) to archives under folder; return their manifest.

    The payload is the html in UTF-8 (null: empty). Of rows with equal payloads of at least min_revisit_bytes, those with
    the smallest page_id are responses and the rest revisit it; rows without page_id revisit too, or are responses where no
    row of the group has an id. Digests are grouped with partial sums; only groups of several rows are joined back. Files
    have unique names and only those in the manifest count, so a task that is run again harms nothing. No rows, no files. Ids
    are whole numbers, texts or dates; a record has its id as text. A null url is the record's urn:none. Payloads of any
    length are one record.
    """
    folder = store_uri(pages.sparkSession, folder)
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    hashed = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256)).withColumn("length", F.octet_length("payload").cast("long"))
    groups = hashed.where(F.col("length") >= min_revisit_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    repeats = materialize(groups.where("n > 1 and first is not null").select("digest", "first"), "repeats")
    if repeats.isEmpty():
        rows = hashed.withColumn("first", F.lit(None).cast(repeats.schema["first"].dataType))
    else:
        rows = hashed.join(repeats, "digest", "left")
    rows = rows.select("page_id", "url", "payload", "digest", "length", F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first")).alias("refers_to"))

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out = path = None
        records = size = 0

        def done():
            return pa.RecordBatch.from_pydict({"path": [path], "records": [records], "bytes": [size]}, pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                if out is None:
                    path, records, size = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(path, compression=None)
                data = record(*(x.as_py() for x in row), date)
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    yield done()
                    out = None
        if out is not None:
            out.close()
            yield done()

    return rows.mapInArrow(run, MANIFEST)


def members(stream, read_bytes: int = READ_BYTES) -> Iterator[bytes]:
    """The gzip members of a stream, one by one, by incremental decompression."""
    rest, unpack, parts = b"", zlib.decompressobj(31), []
    while True:
        data = rest or stream.read(read_bytes)
        if not data:
            if parts:
                raise ValueError("the archive ends inside a record")
            return
        parts.append(unpack.decompress(data))
        rest = unpack.unused_data
        if unpack.eof:
            yield b"".join(parts)
            unpack, parts = zlib.decompressobj(31), []


def parse(member: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """A record's fields, block and payload; framing and digests are checked, and a fault raises ValueError."""
    head, mark, body = member.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    n = int(fields["Content-Length"])
    if not mark or not version.startswith("WARC/1.") or len(body) != n + 4 or body[n:] != b"\r\n\r\n":
        raise ValueError("a record's framing is wrong")
    block = body[:n]
    if fields["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError(f"block digest of {fields['WARC-Record-ID']} is wrong")
    payload = block.partition(b"\r\n\r\n")[2]
    if fields["WARC-Type"] == "response" and fields["WARC-Payload-Digest"] != f"sha256:{hashlib.sha256(payload).hexdigest()}":
        raise ValueError(f"payload digest of {fields['WARC-Record-ID']} is wrong")
    return fields, block, payload


def read_archives(manifest: DataFrame, folder: str, payloads: bool = True, id_type: str = "long") -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of every record of the manifest's archives.

    One task reads an archive from its start to its end and holds one record at a time. A revisit has the length and
    digest of the full payload, which its own block doesn't hold (payload is null). With payloads false, payloads are
    checked but not returned (payload is null). Pages without page_id have null there; page_id and refers_to are cast from the
    records' text to id_type. An empty manifest gives no rows; a damaged or incomplete archive is an error.
    """
    folder = store_uri(manifest.sparkSession, folder)

    def run(batches):
        store, _ = fs.FileSystem.from_uri(folder)
        rows: list[tuple] = []

        def cut():
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
        for batch in batches:
            for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen = held = 0
                with store.open_input_stream(path, compression=None) as stream:
                    for member in members(stream):
                        fields, block, payload = parse(member)
                        http = dict(x.split(": ", 1) for x in block.partition(b"\r\n\r\n")[0].decode().split("\r\n")[1:])
                        revisit = fields["WARC-Type"] == "revisit"
                        rows.append((_id(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], int(http["Content-Length"]), fields["WARC-Payload-Digest"][len("sha256:") :], fields["WARC-Type"], _id(fields.get("WARC-Refers-To")), payload if payloads and not revisit else None))
                        seen, held = seen + 1, held + len(payload) * payloads
                        if len(rows) >= 5000 or held > 8 << 20:
                            yield cut()
                            rows.clear()
                            held = 0
                if seen != expected:
                    raise ValueError(f"{path} has {seen} of {expected} records")
        if rows:
            yield cut()

    one_each = manifest.select("path", "records")
    found = one_each.mapInArrow(run, "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary")
    return found.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def round_trip(pages: DataFrame, min_revisit_bytes: int = 100) -> DataFrame:
    """Write pages to archives in the shared folder, read all of them back, and return what the reader found (no payloads).

    Nulls, empty texts, repeated rows and empty tables are as in write_archives(); other columns are not read.
    """
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    manifest = materialize(write_archives(pages, folder, min_revisit_bytes), "manifest")
    n = max(1, manifest.count())
    return read_archives(manifest.repartition(n), folder, False, pages.schema["page_id"].dataType.simpleString())
