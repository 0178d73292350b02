"""Token ids in files: canonical length-limited Huffman codes, in blocks that can be read on their own.

A file holds documents in ascending order of their ids:

    magic, version, greatest code length, block size       (fixed header)
    code lengths of all ids, one byte each, deflated        (the canonical code follows from them)
    segments: the codes of some million ids, whole documents, padded to a byte
    directory, deflated: document ids, token counts; per segment its byte, ids and documents;
        per block the bit in its segment at which it starts
    place and size of the directory, its crc32, magic       (fixed trailer)

The code is the same in all files of a folder, from the counts of all ids.  A reader needs header,
directory and the segments it wants; within a segment any block can be decoded from its checkpoint.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbline.llm.common import byte_groups, new_folder, ship_package, store
from ebbline.llm.huffman import MAX_BITS, Table, canonical_codes, code_lengths, pack
from ebbline.llm.pieces import piece_ids
from ebbline.llm.warc import open_folder

MAGIC = b"EBTOKENS"
HEADER = struct.Struct("<8sHHIII")  # magic, version, greatest length, ids a block, ids in the code, size of the deflated lengths
TRAILER = struct.Struct("<QQI8s")  # place, size and crc32 of the directory, magic
#: Ids that a checkpoint stands for, ids a segment holds before it is closed, ids a file is aimed at.
BLOCK, SEGMENT_IDS, FILE_IDS = 1024, 1 << 20, 8 << 20


def encode_texts(df: DataFrame, tokenizer_path: str, end_id: int | None = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids binary, n, width): the ids of each whole text, then ``end_id``, in ``width`` bytes each; null is empty."""
    ship_package(df.sparkSession)
    source = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t"))
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("n", pa.int64()), ("width", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = piece_ids(tokenizer_path)
        tail, width = np.array([] if end_id is None else [end_id], work.kind).tobytes(), work.kind.itemsize
        for batch in batches:
            for part in byte_groups(batch, 1, 2 << 20):
                found = pc.binary_join_element_wise(work.arrays(part.column(1)), tail, b"")
                sizes = np.asarray(pc.binary_length(found)).astype(np.int64) // width
                yield pa.RecordBatch.from_arrays([part.column(0), found, pa.array(sizes), pa.array(np.full(len(found), width, np.int32))], schema=schema)

    return source.mapInArrow(run, "doc_id long, ids binary, n long, width int")


def id_counts(encoded: DataFrame) -> np.ndarray:
    """How often each id occurs; a task sends its sums, the driver receives one number per id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for part in byte_groups(batch, 0, 4 << 20):
                some = np.bincount(np.frombuffer(b"".join(part.column(0).to_pylist()), f"<u{part.column(1)[0]}"), minlength=len(total))
                some[: len(total)] += total
                total = some
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], names=["id", "n"])

    rows = encoded.select("ids", "width").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max((r["id"] for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        out[r["id"]] = r["n"]
    return out


class Writer:
    """Writes one file; memory is bounded by a segment and the directory's two numbers a document."""

    def __init__(self, stream, lengths: np.ndarray, block: int = BLOCK, segment_ids: int = SEGMENT_IDS, width: int = 4):
        self.kind = np.dtype(f"<u{width}")
        self.stream, self.lengths, self.codes, self.block, self.segment_ids = stream, lengths, canonical_codes(lengths), block, segment_ids
        packed = zlib.compress(lengths.tobytes())
        self.place = HEADER.size + len(packed)
        stream.write(HEADER.pack(MAGIC, 1, int(lengths.max(initial=0)), block, len(lengths), len(packed)) + packed)
        self.keys: list[int] = []
        self.nulls: list[bool] = []
        self.sizes: list[int] = []
        self.segments: list[tuple[int, int, int, int]] = []  # byte, bytes, ids, documents
        self.checkpoints: list[np.ndarray] = []
        self.waiting: list[bytes] = []
        self.held, self.n_ids = 0, 0

    def add(self, key: int | None, ids: bytes) -> None:
        self.keys.append(key or 0)
        self.nulls.append(key is None)
        self.sizes.append(len(ids) // self.kind.itemsize)
        self.waiting.append(ids)
        self.held += self.sizes[-1]
        if self.held >= self.segment_ids:
            self._flush()

    def _flush(self) -> None:
        if not self.waiting:
            return
        ids = np.frombuffer(b"".join(self.waiting), self.kind)
        data, starts = pack(ids, self.codes, self.lengths, self.block)
        self.stream.write(data)
        self.segments.append((self.place, len(data), len(ids), len(self.waiting)))
        self.checkpoints.append(starts)
        self.place += len(data)
        self.n_ids += len(ids)
        self.waiting, self.held = [], 0

    def close(self) -> int:
        """Returns the file's size."""
        self._flush()
        head = struct.pack("<QQ", len(self.keys), len(self.segments))
        parts = [np.array(self.keys, "<i8"), np.array(self.nulls, "u1"), np.array(self.sizes, "<i8"), np.array(self.segments, "<i8").reshape(-1), *self.checkpoints]
        data = zlib.compress(head + b"".join(p.astype(p.dtype.newbyteorder("<")).tobytes() for p in parts))
        self.stream.write(data + TRAILER.pack(self.place, len(data), zlib.crc32(data), MAGIC))
        return self.place + len(data) + TRAILER.size


class Reader:
    """Reads one file: the directory first, then whole segments or single blocks."""

    def __init__(self, file, size: int):
        self.file = file
        magic, version, _, self.block, n, packed = HEADER.unpack(self._at(0, HEADER.size))
        place, length, check, end = TRAILER.unpack(self._at(size - TRAILER.size, TRAILER.size))
        if magic != MAGIC or end != MAGIC or version != 1:
            raise ValueError("not a token file")
        lengths = np.frombuffer(zlib.decompress(self._at(HEADER.size, packed)), np.uint8)
        directory = self._at(place, length)
        if zlib.crc32(directory) != check or len(lengths) != n:
            raise ValueError("the directory is damaged")
        data = zlib.decompress(directory)
        n_docs, n_segments = struct.unpack_from("<QQ", data)
        self.at = 16

        def take(kind: str, count: int) -> np.ndarray:
            out = np.frombuffer(data, kind, count, self.at)
            self.at += out.nbytes
            return out

        self.keys, self.nulls, self.sizes = take("<i8", n_docs), take("u1", n_docs).astype(bool), take("<i8", n_docs)
        self.segments = take("<i8", 4 * n_segments).reshape(-1, 4)
        self.checkpoints = [take("<i8", -(-int(ids) // self.block)) for ids in self.segments[:, 2]]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.table = Table(lengths)

    def _at(self, place: int, size: int) -> bytes:
        self.file.seek(place)
        return self.file.read(size)

    def segment(self, k: int) -> np.ndarray:
        """The ids of a segment, all of its blocks side by side."""
        place, size, n, _ = self.segments[k].tolist()
        counts = np.full(len(self.checkpoints[k]), self.block)
        if len(counts):
            counts[-1] = n - self.block * (len(counts) - 1)
        return self.table.unpack(self._at(place, size), self.checkpoints[k], counts)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` to before ``stop`` of the file; only the blocks that hold them are read."""
        ends = np.cumsum(self.segments[:, 2])
        out = []
        for k in np.flatnonzero((ends > start) & (ends - self.segments[:, 2] < stop)).tolist():
            place, size, n, _ = self.segments[k].tolist()
            base, marks = int(ends[k]) - n, self.checkpoints[k]
            low, high = max(start - base, 0), min(stop - base, n)
            a, b = low // self.block, -(-high // self.block)
            first = int(marks[a]) >> 3
            last = size if b == len(marks) else (int(marks[b]) + 7) >> 3
            counts = np.minimum(self.block, n - self.block * np.arange(a, b))
            found = self.table.unpack(self._at(place + first, last - first), marks[a:b] - 8 * first, counts)
            out.append(found[low - a * self.block : high - a * self.block])
        return np.concatenate(out) if out else np.zeros(0, np.uint32)


def write(
    encoded: DataFrame, folder: str, max_bits: int = MAX_BITS, block: int = BLOCK, segment_ids: int = SEGMENT_IDS, file_ids: int = FILE_IDS,
) -> DataFrame:
    """Write the files and return the manifest: part, path, n_docs, n_ids, n_bytes, start (ids in all parts before).

    Documents go out in ranges of ascending doc_id (a null first; equal ids by a hash of their ids, so
    that a much repeated one has many ranges too).  A file is named by one attempt of a task and
    listed only when that attempt has ended, so an attempt that is lost leaves nothing that is read.
    """
    encoded.write.option("compression", "zstd").parquet(f"{folder}/encoded")
    encoded = encoded.sparkSession.read.schema(encoded.schema).parquet(f"{folder}/encoded")
    counts = id_counts(encoded)
    lengths = encoded.sparkSession.sparkContext.broadcast(code_lengths(counts, max_bits))
    files = max(1, int(-(-int(counts.sum()) // file_ids)))
    mixed = F.xxhash64("ids")
    dealt = encoded.withColumn("mixed", mixed).repartitionByRange(files, F.col("doc_id").asc_nulls_first(), "mixed")
    dealt = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "mixed")
    schema = pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())])

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, root = open_folder(folder)
        writer, stream, path = None, None, ""
        for batch in batches:
            for part in byte_groups(batch, 1, 4 << 20):
                for key, ids, width in zip(*(c.to_pylist() for c in part.columns)):
                    if writer is None:
                        place.create_dir(root, recursive=True)
                        path = f"{root}/{uuid.uuid4().hex}.tok"
                        stream = place.open_output_stream(path, compression=None)
                        writer = Writer(stream, lengths.value, block, segment_ids, width)
                    writer.add(key, ids)
        if writer is not None:
            size = writer.close()
            stream.close()
            row = {"part": TaskContext.get().partitionId(), "path": path, "n_docs": len(writer.keys), "n_ids": writer.n_ids, "n_bytes": size}
            yield pa.RecordBatch.from_pylist([row], schema=schema)

    fields = "part int, path string, n_docs long, n_ids long, n_bytes long"
    manifest = store(dealt.select("doc_id", "ids", "width").mapInArrow(save, fields), folder, "manifest")
    starts, total = [], 0
    for r in manifest.select("part", "n_ids").orderBy("part").collect():  # a row per file
        starts.append((r["part"], total))
        total += r["n_ids"]
    begins = manifest.sparkSession.createDataFrame(starts, "part int, start long")
    return store(manifest.join(F.broadcast(begins), "part"), folder, "files")


def read(manifest: DataFrame, folder: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids of every document, decoded from the files."""
    ship_package(manifest.sparkSession)
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    fields = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, _ = open_folder(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with place.open_input_file(row["path"]) as file:
                    reader, doc = Reader(file, row["n_bytes"]), 0
                    for k, (_, _, _, n_docs) in enumerate(reader.segments.tolist()):
                        ids, some = reader.segment(k), slice(doc, doc + n_docs)
                        sizes = reader.sizes[some]
                        ends = np.cumsum(sizes)
                        raw = memoryview(ids.astype("<u4").tobytes())
                        crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - sizes).tolist(), ends.tolist())]
                        columns = [
                            pa.array(reader.keys[some], pa.int64(), mask=reader.nulls[some]), pa.array(reader.starts[some] + row["start"]), pa.array(sizes), pa.array(crcs, pa.int64()),
                        ]
                        if with_ids:
                            columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int64))))
                        yield pa.RecordBatch.from_arrays(columns, names=names)
                        doc += n_docs

    tasks = max(1, min(manifest.count(), 8 * manifest.sparkSession.sparkContext.defaultParallelism))
    return manifest.select("path", "n_bytes", "start").repartition(tasks, "path").mapInArrow(load, fields)


def token_files(
    docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int | None = 2, with_ids: bool = True,
    max_bits: int = MAX_BITS, file_ids: int = FILE_IDS, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Encode all texts, write them to files in ``folder`` (default: a new one in the shared folder) and read them back.

    One row per input row: doc_id, start (ids of all documents before it), n_tokens with the end id,
    ids_crc32 (of the ids as little-endian unsigned 32-bit numbers), ids.  Null and empty texts have the
    end id alone; a null key comes first; equal keys follow each other in an order set by their ids, so
    repeated rows lie side by side; an empty table writes no file.  Other columns play no part.
    """
    folder = folder or new_folder(docs.sparkSession, "tokens")
    return read(write(encode_texts(docs, tokenizer_path, end_id, key, text), folder, max_bits, file_ids=file_ids), folder, with_ids)
