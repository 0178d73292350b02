"""WARC archives with dictionary compression: written by tasks, listed in a manifest, read back.

An archive is a skippable frame that holds the Zstandard dictionary, then one frame per record, as
the .warc.zst convention has it.  Archives lie in the shared folder; each attempt of a task writes
files of its own, and only those of the attempt that Spark commits are in the manifest, so a lost
executor leaves at most files that nobody reads.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbline.llm.common import byte_groups, new_folder, store

#: Fixed values of the format: magic number of the dictionary's skippable frame, of a compressed frame.
SKIPPABLE_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
DATE = "2000-01-01T00:00:00Z"
#: Records below this many payload bytes are never revisits.
LEAST_BYTES = 100
#: Bytes of records in an archive before the next one begins.
ARCHIVE_BYTES = 64 << 20
DICTIONARY_BYTES = 64 << 10
LEVEL = 3


def payloads(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    return pages.select(
        F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("payload_digest", F.sha2("payload", 256))


def decide(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, payload, payload_digest, refers_to (null: a response).

    The first of equal payloads, by page_id, is the response; rows that repeat its id are responses
    too, a null id never is while another exists.
    """
    rows = payloads(pages, page_id, url, html)
    large = rows.filter(F.octet_length("payload") >= least)
    firsts = large.groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    repeated = firsts.filter((F.col("n") > 1) & F.col("first_id").isNotNull()).select(F.col("payload_digest").alias("same"), "first_id")
    joined = rows.join(repeated, (F.col("payload_digest") == F.col("same")) & (F.octet_length("payload") >= least), "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select("page_id", "url", "payload", "payload_digest", F.when(revisit, F.col("first_id")).alias("refers_to"))


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 record; a revisit has the digest and length of its payload in the header, and no block."""
    block = payload if refers_to is None else b""
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: text/html; charset=utf-8",
    ]
    if url:
        head.append(f"WARC-Target-URI: {' '.join(url.split())}")
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to)}", f"X-Payload-Length: {len(payload)}",
        ]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    size = int(fields["Content-Length"])
    if not version.startswith("WARC/") or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    return fields, rest[:size]


def dictionary(records: DataFrame, samples: int = 2000, sample_bytes: int = 16 << 10, size: int = DICTIONARY_BYTES) -> bytes:
    """A Zstandard dictionary from a bounded sample: ``samples`` records by a hash of their id, cut to ``sample_bytes``.

    Empty where the sample is too small to train on.
    """
    chosen = records.select("page_id", "url", "payload_digest", F.substring("payload", 1, sample_bytes).alias("payload"))
    mixed = F.xxhash64(F.lit("dictionary"), "page_id")
    share = 4 * samples / max(1, records.count())  # leaves some times the sample, so that little is sorted
    if share < 1:
        chosen = chosen.filter(F.pmod(mixed, F.lit(1_000_000_007)) < int(share * 1_000_000_007))
    chosen = chosen.orderBy(mixed, "payload_digest").limit(samples)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        found = [record(r["page_id"], r["url"], r["payload"], r["payload_digest"], None) for b in batches for r in b.to_pylist()]
        try:
            data = zstandard.train_dictionary(min(size, max(256, sum(map(len, found)) // 10)), found).as_bytes()
        except zstandard.ZstdError:  # too few or too short samples
            data = b""
        yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["dictionary"])

    rows = chosen.repartition(1).mapInArrow(train, "dictionary binary").collect()
    return bytes(rows[0]["dictionary"]) if rows else b""


STORES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss", "wasb": "abfs"}


def open_folder(folder: str):
    """A pyarrow filesystem and the path in it; a plain path is a local one.

    Spark's names for a store (s3a, s3n, abfss, wasbs) stand for pyarrow's.
    """
    from pyarrow import fs

    scheme, mark, rest = folder.partition("://")
    folder = STORES.get(scheme, scheme) + mark + rest if mark else folder
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def write(records: DataFrame, folder: str, trained: bytes, archive_bytes: int = ARCHIVE_BYTES, level: int = LEVEL) -> DataFrame:
    """Write the archives and return the manifest (path, n_records, n_bytes); one task writes one file at a time."""
    shared = records.sparkSession.sparkContext.broadcast(trained)
    names = ["path", "n_records", "n_bytes"]

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        place, root = open_folder(folder)
        place.create_dir(root, recursive=True)
        words = zstandard.ZstdCompressionDict(shared.value) if shared.value else None
        packer = zstandard.ZstdCompressor(level=level, dict_data=words, write_checksum=True)
        out, path, count, size = None, "", 0, 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pylist([dict(zip(names, (path, count, size)))], schema=pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())]))

        for batch in batches:
            for part in byte_groups(batch, 2, 8 << 20):
                for r in part.to_pylist():
                    if out is None:
                        path, count, size = f"{root}/{uuid.uuid4().hex}.warc.zst", 0, 0
                        out = place.open_output_stream(path, compression=None)
                        out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(shared.value)) + shared.value)
                    data = packer.compress(record(**{"page_id": r["page_id"], "url": r["url"], "payload": r["payload"], "digest": r["payload_digest"], "refers_to": r["refers_to"]}))
                    out.write(data)
                    count, size = count + 1, size + len(data)
                    if size >= archive_bytes:
                        yield done()
                        out = None
        if out is not None:
            yield done()

    ordered = records.select("page_id", "url", "payload", "payload_digest", "refers_to")
    return store(ordered.mapInArrow(save, "path string, n_records long, n_bytes long"), folder, "manifest")


def frames(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive, one at a time; the dictionary comes from its first frame."""
    import zstandard

    head = stream.read(8)
    magic, size = struct.unpack("<II", head)
    if magic != SKIPPABLE_MAGIC:
        raise ValueError("no dictionary frame at the start")
    data = stream.read(size)
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data) if data else None)
    rest = b""
    while True:
        rest = rest or stream.read(chunk)
        if not rest:
            return
        one, parts = unpacker.decompressobj(), []
        while True:
            parts.append(one.decompress(rest))
            rest = one.unused_data
            if one.eof:
                break
            rest = stream.read(chunk)
            if not rest:
                raise ValueError("the archive ends within a record")
        yield b"".join(parts)


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """Every record of the archives: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload.

    The digest of a response is computed from its payload and held against the header; a revisit
    states length and digest of the payload it stands for, and its payload is null.
    """
    fields = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def number(urn: str | None) -> int | None:
        digits = (urn or "")[len("<urn:page:") : -1]
        return int(digits) if digits else None

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, _ = open_folder(folder)
        rows, held = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with place.open_input_stream(path, compression=None) as stream:
                    for data in frames(stream):
                        head, block = parse(data)
                        revisit = head["WARC-Type"] == "revisit"
                        digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                        if not revisit and hashlib.sha256(block).hexdigest() != digest:
                            raise ValueError(f"digest of {head['WARC-Record-ID']} in {path} differs")
                        rows.append({
                            "page_id": number(head["WARC-Record-ID"]), "url": head.get("WARC-Target-URI"), "record_type": head["WARC-Type"],
                            "refers_to": number(head.get("WARC-Refers-To")), "payload_bytes": int(head["X-Payload-Length"]) if revisit else len(block),
                            "payload_digest": digest, "payload": None if revisit else block,
                        })
                        held += len(block)
                        if held > 4 << 20 or len(rows) >= 5000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    tasks = max(1, min(manifest.count(), 8 * manifest.sparkSession.sparkContext.defaultParallelism))
    files = manifest.select("path", F.col("n_bytes").alias("size")).repartition(tasks, "path")
    return files.mapInArrow(load, fields)


def archive(pages: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all pages to archives in ``folder`` (default: a new one in the shared folder) and read them back.

    A null html is an empty payload; pages below 100 bytes are all responses; a null url leaves the
    header out; repeated rows each have a record; an empty table writes no archive.
    """
    folder = folder or new_folder(pages.sparkSession, "warc")
    trained = dictionary(payloads(pages))
    return read(write(decide(pages), folder, trained, archive_bytes), folder)
