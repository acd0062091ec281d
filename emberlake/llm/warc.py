"""Operator 5, WARC archives: written by Spark tasks, read back record by record.

Every record is a gzip member of its own. The reader goes through an archive in order: it inflates one member
at a time with an incremental zlib decompressor, parses the header block, takes the payload by its
content-length, and checks it against the payload digest of the header; a record that fails is an error.

Records with equal payloads of REVISIT or more bytes: the one with the largest id holds the payload, the
others are revisit records that name it and hold none. The table is grouped by digest alone; payloads cross
the network once, in the join that tells each record what it is.

Archives go to the shared folder; a task writes to a name of its own attempt and tells it in the manifest, so
what a lost or repeated task has left is never read.

Edge cases: a null payload is empty; equal ids with equal payloads tie, and all of them that have the largest
id are responses; a null id cannot be referred to, and its record is always a response; rows that repeat are
written and read as often; payloads of any size are streamed in blocks; an empty table gives an empty table;
only the id, the url and the payload are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.llm.common import cut, shared_dir

REVISIT = 1000
BLOCK = 1 << 16
#: Bytes (before compression) after which a task begins another archive: one archive is read by one task.
ARCHIVE = 64 << 20
#: Bytes that one reading task takes on about.
READ = 4 * ARCHIVE
NAMESPACE = uuid.UUID("8c7a3f5e-2b61-4f0e-9d53-6f1f0c1c7b11")


def _header(row: dict) -> bytes:
    lines = [
        "WARC/1.1",
        f"WARC-Type: {row['type']}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(NAMESPACE, str(row['id']))}>",
        f"X-Source-Id: {'' if row['id'] is None else row['id']}",
        "WARC-Target-URI: " + (row["url"] or "").replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{row['digest']}",
        f"X-Payload-Length: {row['length']}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(row['body'])}",
    ]
    if row["type"] == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(NAMESPACE, str(row['refers']))}>", f"X-Refers-To-Source-Id: {row['refers']}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes a record for each row of pages to archives in folder; returns their manifest (path, records, bytes before compression), written."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary")).alias("body"))
    rows = rows.withColumns({"digest": F.sha1("body"), "length": F.octet_length("body").cast("long")})
    narrow = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary")).alias("body"))
    narrow = narrow.select("id", F.sha1("body").alias("digest"), F.octet_length("body").cast("long").alias("length"))
    equal = cut(narrow.where(f"length >= {REVISIT}").groupBy("digest", "length").agg(F.max("id").alias("keeper"), F.count("*").alias("m")).where("m > 1").select("digest", "length", "keeper"))
    # Only digests that repeat are joined; where there are few the payloads don't move at all.
    few = equal.limit(200_001).count() <= 200_000
    rows = rows.join(F.broadcast(equal) if few else equal, ["digest", "length"], "left")
    refers = F.when(F.col("id") < F.col("keeper"), F.col("keeper"))
    rows = rows.select("id", "url", "digest", "length", refers.alias("refers"), F.when(refers.isNull(), F.col("body")).alias("body"))

    def work(batches: Iterator) -> Iterator:
        import zlib

        import pyarrow as pa
        from pyarrow.fs import FileSystem
        from pyspark import TaskContext

        task = TaskContext.get()
        store, base = FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        made: list[tuple[str, int, int]] = []
        out, size, records = None, 0, 0
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                row["type"], row["body"] = ("response" if row["refers"] is None else "revisit"), row["body"] or b""
                if out is None:
                    name = f"{base}/{task.partitionId():06d}-{task.taskAttemptId():08d}-{len(made):04d}.warc.gz"
                    out, size, records = store.open_output_stream(name, compression=None), 0, 0
                    made.append((name, 0, 0))
                pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                out.write(pack.compress(_header(row)) + pack.compress(row["body"]) + pack.compress(b"\r\n\r\n") + pack.flush())
                size, records = size + len(row["body"]), records + 1
                made[-1] = (made[-1][0], records, size)
                if size >= ARCHIVE:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _, _ in made], pa.string()), pa.array([r for _, r, _ in made], pa.int64()), pa.array([b for _, _, b in made], pa.int64())], names=["path", "records", "bytes"])

    return cut(rows.mapInArrow(work, "path string, records long, bytes long"))


def members(stream, block: int = BLOCK) -> Iterator[bytes]:
    """The content of each gzip member of a stream, inflated block by block."""
    import zlib

    inflate, parts, rest = zlib.decompressobj(31), [], b""
    while True:
        data = rest or stream.read(block)
        rest = b""
        if not data:
            if parts or inflate.unconsumed_tail:
                raise ValueError("the archive ends within a record")
            return
        parts.append(inflate.decompress(data))
        if inflate.eof:
            rest = inflate.unused_data
            yield b"".join(parts)
            inflate, parts = zlib.decompressobj(31), []


def parse(member: bytes) -> dict:
    """A record's headers and payload, framed by its content-length and checked against its digest."""
    import hashlib

    head, sep, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    n = int(headers["Content-Length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length isn't its content-length")
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if headers["WARC-Type"] == "revisit" and (n or len(digest) != 40):
        raise ValueError("a revisit has a payload, or no digest of the one it stands for")
    if headers["WARC-Type"] == "response" and hashlib.sha1(rest[:n]).hexdigest() != digest:
        raise ValueError("a payload doesn't have its digest")
    return {
        "page_id": int(headers["X-Source-Id"]) if headers["X-Source-Id"] else None,
        "url": headers["WARC-Target-URI"],
        "record_type": headers["WARC-Type"],
        "refers_to": int(headers["X-Refers-To-Source-Id"]) if headers["WARC-Type"] == "revisit" else None,
        "payload_digest": digest,
        "payload_bytes": int(headers["X-Payload-Length"]),
        "payload": rest[:n],
    }


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """The records of the archives in manifest, a written table; a task reads archives of READ bytes or so, or a single one."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow.fs import FileSystem

        store, _ = FileSystem.from_uri(folder)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for path, records in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist(), strict=True):
                rows, held, read = [], 0, 0
                with store.open_input_stream(path, compression=None) as stream:
                    for member in members(stream):
                        rows.append(parse(member))
                        held, read = held + len(member), read + 1
                        if held > 1 << 22:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if read != records:
                    raise ValueError(f"{path} has {read} records, not {records}")
                yield pa.RecordBatch.from_pylist(rows, schema)

    schema = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
    # The manifest is small whatever it lists, so the number of tasks is set from the archives' bytes and not left to its own.
    told = manifest.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    tasks = max(1, min(told["n"], max(manifest.sparkSession.sparkContext.defaultParallelism, told["bytes"] // READ)))
    return manifest.repartition(tasks).mapInArrow(work, schema)


def archived(pages: DataFrame) -> DataFrame:
    """pages, written as archives to the shared folder and read back."""
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read_archives(write_archives(pages, folder), folder)
