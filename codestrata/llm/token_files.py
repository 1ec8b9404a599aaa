"""Token ids as files of independent zstandard frames with a trailing seek table.

A file is one stream of ids, little-endian unsigned 32-bit integers, cut into
frames of ``FRAME_IDS`` ids whatever the documents' lengths. After the frames
come two skippable frames, so any zstandard reader can decompress the file:

* the document index: number of documents, then whether each has an id, the ids
  (signed 64-bit) and the numbers of tokens (unsigned 64-bit), compressed, with
  the CRC-32 of the compressed bytes in front;
* the seek table of the zstandard seekable format: compressed size, decompressed
  size and low half of the XXH64 of the decompressed bytes of each frame.

A reader fetches the tail, finds a document's place by summing the numbers of
tokens, and decompresses only the frames that hold it.

Writing: documents are range-partitioned and sorted by id, encoded where they
lie, and streamed to files of at most ``FILE_IDS`` ids. A file's name ends in a
random part, and only files named in the manifest count; the manifest is written
by Spark's own committed write after the tasks succeeded. A task that runs again
after an executor is lost leaves a file nobody reads.

Defined results: a null text is empty, so it has the end id alone; documents
with a null id come first; equal ids are ordered by a hash of the text; equal
rows are written once each. Other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codestrata.llm.tables import new_folder, stored, text_slices
from codestrata.llm.token_ids import encoder

FRAME_IDS = 1 << 16
FILE_IDS = 1 << 26
LEVEL = 3
READ_BYTES = 8 << 20

# Fixed values of the zstandard (seekable) format.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK = 0x184D2A5E
SEEKABLE_END = 0x8F92EAB1
CHECKSUMS = 0x80

MANIFEST = "folder string, file string, task int, part int, n_docs bigint, n_ids bigint, n_bytes bigint"


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder; without a scheme a path of this machine."""
    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


class FileWriter:
    """Writes one file. Memory: the ids of a frame and an entry per document."""

    def __init__(self, filesystem: fs.FileSystem, path: str):
        self.out = filesystem.open_output_stream(path, compression=None)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL)
        self.pending: list[bytes] = []
        self.pending_bytes = 0
        self.seek: list[bytes] = []
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []
        self.n_ids = 0
        self.n_bytes = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids) // 4)
        self.n_ids += len(ids) // 4
        self.pending.append(ids)
        self.pending_bytes += len(ids)
        if self.pending_bytes >= FRAME_IDS * 4:
            self._frames(last=False)

    def _frames(self, last: bool) -> None:
        whole = b"".join(self.pending)
        size = FRAME_IDS * 4
        end = len(whole) if last else len(whole) - len(whole) % size
        for begin in range(0, end, size):
            data = whole[begin : begin + size]
            frame = self.compressor.compress(data)
            self._write(frame)
            low = xxhash.xxh64_intdigest(data) & 0xFFFFFFFF
            self.seek.append(struct.pack("<III", len(frame), len(data), low))
        self.pending = [whole[end:]]
        self.pending_bytes = len(whole) - end

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.n_bytes += len(data)

    def close(self) -> None:
        self._frames(last=True)
        count = len(self.doc_ids)
        known = np.array([value is not None for value in self.doc_ids], np.uint8)
        ids = np.array([value or 0 for value in self.doc_ids], "<i8")
        index = known.tobytes() + ids.tobytes() + np.array(self.lengths, "<u8").tobytes()
        packed = struct.pack("<Q", count) + self.compressor.compress(index)
        body = struct.pack("<I", zlib.crc32(packed)) + packed
        table = b"".join(self.seek) + struct.pack("<IBI", len(self.seek), CHECKSUMS, SEEKABLE_END)
        self._write(struct.pack("<II", SKIPPABLE_INDEX, len(body)) + body)
        # The seek table's own header also tells where the index begins.
        self._write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)
        self.out.close()


class FileReader:
    """Reads documents of one file, decompressing the frames that hold them."""

    def __init__(self, filesystem: fs.FileSystem, path: str):
        self.source = filesystem.open_input_file(path)
        size = self.source.size()
        frames, flags, end = struct.unpack("<IBI", self._at(size - 9, 9))
        if end != SEEKABLE_END or flags != CHECKSUMS:
            raise ValueError(f"{path}: no seek table at the end")
        table_at = size - 9 - 12 * frames
        table = np.frombuffer(self._at(table_at, 12 * frames), "<u4").reshape(-1, 3)
        self.sums = table[:, 2]
        self.frame_at = np.concatenate([[0], np.cumsum(table[:, 0], dtype=np.int64)])
        self.id_at = np.concatenate([[0], np.cumsum(table[:, 1], dtype=np.int64)]) // 4
        index_at = int(self.frame_at[-1])
        magic, length = struct.unpack("<II", self._at(index_at, 8))
        body = self._at(index_at + 8, length)
        if magic != SKIPPABLE_INDEX or zlib.crc32(body[4:]) != struct.unpack("<I", body[:4])[0]:
            raise ValueError(f"{path}: damaged document index")
        (count,) = struct.unpack("<Q", body[4:12])
        self.decompressor = zstandard.ZstdDecompressor()
        index = self.decompressor.decompress(body[12:], max_output_size=max(1, 17 * count))
        self.known = np.frombuffer(index, np.uint8, count)
        self.doc_ids = np.frombuffer(index, "<i8", count, count)
        self.lengths = np.frombuffer(index, "<u8", count, 9 * count).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self._held: tuple[int, bytes] = (-1, b"")

    def _at(self, position: int, length: int) -> bytes:
        self.source.seek(position)
        return self.source.read(length)

    def _frame(self, number: int) -> bytes:
        if self._held[0] != number:
            begin, end = int(self.frame_at[number]), int(self.frame_at[number + 1])
            size = int(self.id_at[number + 1] - self.id_at[number]) * 4
            data = self.decompressor.decompress(self._at(begin, end - begin), max_output_size=size)
            if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != int(self.sums[number]):
                raise ValueError(f"frame {number}: wrong checksum")
            self._held = (number, data)
        return self._held[1]

    def ids(self, document: int) -> bytes:
        """Ids of the document at this place in the file."""
        begin, end = int(self.starts[document]), int(self.starts[document + 1])
        parts = []
        frame = int(np.searchsorted(self.id_at, begin, "right")) - 1
        while begin < end:
            stop = min(end, int(self.id_at[frame + 1]))
            first = int(self.id_at[frame])
            parts.append(self._frame(frame)[(begin - first) * 4 : (stop - first) * 4])
            begin, frame = stop, frame + 1
        return b"".join(parts)

    def find(self, doc_id: int | None) -> np.ndarray:
        """Places of the documents with this id; ids ascend within a file."""
        nulls = int(len(self.known) - self.known.sum())
        if doc_id is None:
            return np.arange(nulls)
        low = np.searchsorted(self.doc_ids[nulls:], doc_id, "left")
        high = np.searchsorted(self.doc_ids[nulls:], doc_id, "right")
        return np.arange(nulls + low, nulls + high)

    def close(self) -> None:
        self.source.close()


def write_token_files(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int,
    folder: str | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Encode and write ``docs`` in ascending id; returns the manifest, a row per file.

    ``folder`` must be reachable from every executor; by default it is a new one
    below ``spark.checkpoint.dir``.
    """
    folder = folder or new_folder(docs.sparkSession, "token-files")
    filesystem, path = open_folder(folder)
    filesystem.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, path = open_folder(folder)
        tokens, end = encoder(tokenizer_path), struct.pack("<I", end_id)
        task, written, writer = TaskContext.get().partitionId(), [], None
        for batch in text_slices(batches, "_text"):
            texts = batch.column("_text")
            for doc_id, text in zip(batch.column("_id").to_pylist(), texts, strict=True):
                if writer is None:
                    name = f"ids-{task:07d}-{len(written):05d}-{uuid.uuid4().hex}.zst"
                    writer = FileWriter(filesystem, f"{path}/{name}")
                writer.add(doc_id, tokens.encode(text.as_py() or "") + end)
                if writer.n_ids >= FILE_IDS:
                    written.append(_closed(writer, name))
                    writer = None
        if writer is not None:
            written.append(_closed(writer, name))
        rows = [
            {"folder": folder, "task": task, "part": part, **row} for part, row in enumerate(written)
        ]
        yield pa.RecordBatch.from_pylist(rows, schema=_MANIFEST_ARROW)

    rows = docs.select(
        F.col(id_column).cast("bigint").alias("_id"), F.col(text_column).alias("_text")
    )
    ordered = (
        rows.withColumn("_tie", F.xxhash64("_text"))
        .repartitionByRange("_id", "_tie")
        .sortWithinPartitions("_id", "_tie")
        .select("_id", "_text")
    )
    return stored(ordered.mapInArrow(write, MANIFEST), "token-manifest")


_MANIFEST_ARROW = pa.schema(
    [
        ("folder", pa.string()),
        ("file", pa.string()),
        ("task", pa.int32()),
        ("part", pa.int32()),
        ("n_docs", pa.int64()),
        ("n_ids", pa.int64()),
        ("n_bytes", pa.int64()),
    ]
)


def _closed(writer: FileWriter, name: str) -> dict:
    writer.close()
    return {
        "file": name,
        "n_docs": len(writer.doc_ids),
        "n_ids": writer.n_ids,
        "n_bytes": writer.n_bytes,
    }


def read_token_files(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document, from the files alone.

    ``start`` counts the ids of all documents before it. The running sum goes
    over the manifest, which has a row per file. Files are dealt to the tasks.
    """
    before = Window.orderBy("task", "part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).select(
        "folder", "file", "base"
    )
    files = files.repartition("file")
    schema = pa.schema(
        [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                filesystem, path = open_folder(row["folder"])
                reader = FileReader(filesystem, f"{path}/{row['file']}")
                yield from _read_file(reader, row["base"], schema)
                reader.close()

    return files.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def _read_file(reader: FileReader, base: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    count, begin = len(reader.doc_ids), 0
    while begin < count:
        limit = reader.starts[begin] + READ_BYTES // 4
        end = max(begin + 1, int(np.searchsorted(reader.starts, limit, "right")) - 1)
        end = min(end, count)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(reader.doc_ids[begin:end], mask=reader.known[begin:end] == 0),
                pa.array(base + reader.starts[begin:end]),
                pa.array(reader.lengths[begin:end]),
                pa.array([reader.ids(place) for place in range(begin, end)], pa.binary()),
            ],
            schema=schema,
        )
        begin = end


def read_documents(manifest: DataFrame, doc_ids: Iterable[int]) -> DataFrame:
    """``doc_id, ids`` of the documents asked for; other frames stay compressed."""
    wanted = sorted(set(doc_ids))
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                filesystem, path = open_folder(row["folder"])
                reader = FileReader(filesystem, f"{path}/{row['file']}")
                for doc_id in wanted:
                    for place in reader.find(doc_id):
                        yield pa.RecordBatch.from_pylist(
                            [{"doc_id": doc_id, "ids": reader.ids(int(place))}], schema=schema
                        )
                reader.close()

    return manifest.select("folder", "file").mapInArrow(read, "doc_id bigint, ids binary")


def token_files_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: write all documents, read the files back."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_token_files(manifest).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )
