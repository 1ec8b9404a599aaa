"""Packing token sequences into windows of fixed length, with bounded memory.

Each task keeps at most ``open_windows`` windows. A document's ids come as they
lie in the partition: whole windows are cut off first, the rest goes to the open
window it fits best. When it fits none and no window may be opened, the fullest
window is filled with the head of the rest and emitted, and the remainder tries
again. So windows that a task emits have no padding, and only documents that fit
nowhere are cut.

What is open at the end of a task is leftover; it lies in row groups of its own, so
the next level does not read the finished windows. Leftovers of ``merge_factor``
tasks at a time are packed in the same way, level by level, until one task holds
the last ``open_windows``; it fills the fullest from the emptiest, so at most the
very last window is padded. Every level is a table in the shared folder.

Nothing is shuffled, and a task holds a slice of texts and its open windows.

Defined results: a null or empty text is a piece with the end id alone; rows with
equal or null ids are packed like any others; an empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import struct
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm.tables import stored, text_slices
from codestrata.llm.token_ids import encoder

CAPACITY = 2048
OPEN_WINDOWS = 64
MERGE_FACTOR = 16
BATCH_BYTES = 4 << 20
#: Parquet row groups; a filter on ``sequence_id`` skips those without leftovers.
GROUP_BYTES = 2 << 20

PIECES = (
    "doc_id bigint, start bigint, length bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint, ids binary, task int"
)
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
        ("ids", pa.binary()),
        ("task", pa.int32()),
    ]
)


@dataclass(frozen=True, slots=True)
class Piece:
    doc_id: int | None
    start: int
    ids: bytes
    doc_tokens: int

    def __len__(self) -> int:
        return len(self.ids) // 4

    def split(self, length: int) -> tuple[Piece, Piece]:
        return (
            replace(self, ids=self.ids[: 4 * length]),
            replace(self, start=self.start + length, ids=self.ids[4 * length :]),
        )


class Packer:
    """Open windows of one task."""

    def __init__(self, capacity: int, open_windows: int):
        self.capacity = capacity
        self.open_windows = open_windows
        self.windows: dict[int, list[Piece]] = {}
        self.gaps: list[tuple[int, int]] = []  # (room left, window), ascending
        self.made = 0

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        """Place ``piece``; gives the windows that became full."""
        while len(piece) >= self.capacity:
            head, piece = piece.split(self.capacity)
            yield [head]
        while len(piece):
            place = bisect_left(self.gaps, (len(piece), -1))
            if place < len(self.gaps):
                full = self._put(place, piece)
                if full:
                    yield full
                return
            if len(self.windows) < self.open_windows:
                self.windows[self.made] = [piece]
                insort(self.gaps, (self.capacity - len(piece), self.made))
                self.made += 1
                return
            head, piece = piece.split(self.gaps[0][0])
            yield self._put(0, head)

    def _put(self, place: int, piece: Piece) -> list[Piece] | None:
        gap, window = self.gaps.pop(place)
        self.windows[window].append(piece)
        if gap == len(piece):
            return self.windows.pop(window)
        insort(self.gaps, (gap - len(piece), window))
        return None

    def leftovers(self) -> list[list[Piece]]:
        return list(self.windows.values())

    def merged(self) -> Iterator[list[Piece]]:
        """The open windows, the fullest filled from the emptiest."""
        windows = [self.windows[window] for _, window in self.gaps]
        while windows:
            fullest = windows.pop(0)
            room = self.capacity - sum(map(len, fullest))
            while room and windows:
                piece = windows[-1].pop()
                if len(piece) > room:
                    head, rest = piece.split(room)
                    windows[-1].append(rest)
                    piece = head
                fullest.append(piece)
                room -= len(piece)
                if not windows[-1]:
                    windows.pop()
            yield fullest


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int,
    capacity: int = CAPACITY,
    open_windows: int = OPEN_WINDOWS,
    merge_factor: int = MERGE_FACTOR,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """A row per piece: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids``.

    ``ids`` are little-endian unsigned 32-bit integers, ``start`` counts the
    document's ids before the piece, ``offset`` the sequence's.
    """

    def pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Piece]:
        tokens, end = encoder(tokenizer_path), struct.pack("<I", end_id)
        for batch in text_slices(batches, "_text"):
            texts = batch.column("_text").to_pylist()
            for doc_id, text in zip(batch.column("_id").to_pylist(), texts, strict=True):
                ids = tokens.encode(text or "") + end
                yield Piece(doc_id, 0, ids, len(ids) // 4)

    rows = docs.select(
        F.col(id_column).cast("bigint").alias("_id"), F.col(text_column).alias("_text")
    )
    packed = _level(rows, pieces_of, 0, capacity, open_windows, last=False)
    done, level = [packed.where("sequence_id IS NOT NULL")], 1
    tasks = _tasks_with_leftovers(packed)
    while tasks:
        last = tasks <= merge_factor
        groups = -(-tasks // merge_factor)
        rest = packed.where("sequence_id IS NULL").coalesce(groups)
        packed = _level(rest, _stored_pieces, level, capacity, open_windows, last)
        done.append(packed.where("sequence_id IS NOT NULL"))
        tasks = 0 if last else _tasks_with_leftovers(packed)
        level += 1
    pieces = done[0]
    for more in done[1:]:
        pieces = pieces.unionByName(more)
    return pieces.drop("task")


def _tasks_with_leftovers(packed: DataFrame) -> int:
    return packed.where("sequence_id IS NULL").agg(F.count_distinct("task")).first()[0]


def _level(rows, pieces_of, level: int, capacity: int, open_windows: int, last: bool) -> DataFrame:
    """One round of packing, written; leftovers have no ``sequence_id`` yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, packer = TaskContext.get().partitionId(), Packer(capacity, open_windows)
        out = _Output(task, (level << 56) | (task << 32))
        for piece in pieces_of(batches):
            for window in packer.add(piece):
                yield from out.add(window, closed=True)
        for window in packer.merged() if last else packer.leftovers():
            yield from out.add(window, closed=last)
        yield from out.flush()

    groups = {"parquet.block.size": GROUP_BYTES}
    return stored(rows.mapInArrow(run, PIECES), f"packed-{level}", **groups)


def _stored_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[Piece]:
    for batch in batches:
        names = ("doc_id", "start", "ids", "doc_tokens")
        for row in zip(*[batch.column(name).to_pylist() for name in names], strict=True):
            yield Piece(*row)


class _Output:
    """Rows of one task, gathered by column."""

    def __init__(self, task: int, first_id: int):
        self.task, self.next_id = task, first_id
        self._clear()

    def _clear(self) -> None:
        self.columns: list[list] = [[] for _ in _ARROW.names[:-1]]
        self.bytes = 0

    def add(self, window: list[Piece], closed: bool) -> Iterator[pa.RecordBatch]:
        offset, number = 0, self.next_id if closed else None
        for piece in window:
            length = len(piece)
            row = (piece.doc_id, piece.start, length, piece.doc_tokens, number, offset, piece.ids)
            for column, value in zip(self.columns, row, strict=True):
                column.append(value)
            offset += length
            self.bytes += len(piece.ids)
        self.next_id += closed
        if self.bytes >= BATCH_BYTES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.columns[0]:
            tasks = [self.task] * len(self.columns[0])
            arrays = [pa.array(x, field.type) for x, field in zip([*self.columns, tasks], _ARROW, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=_ARROW)
        self._clear()


def packed_documents(docs: DataFrame) -> DataFrame:
    """Pieces of ``docs`` in windows of 2,048 ids, with the digest of their ids."""
    import public_tokenizers

    pieces = pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return pieces.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
        "ids",
    )


def packed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: all documents."""
    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
