"""Removal of word sequences that occur elsewhere, by difference-cover anchors.

A window of ``width`` words is repeated if the same words start anywhere else, in
the same document or another. All words of repeated windows are removed.

1. Anchors. With a difference cover modulo a period v, any two positions i and j
   have a shift below v that takes both to cover positions. So two equal windows
   hold an equal anchor, a shorter window of ``width - v + 1`` words, that starts
   at a cover position in both. Only those starts are hashed: 5 of 21 for the
   default width.
2. Anchors with equal hashes meet (``shared_places``). Windows around a shared
   anchor are the candidates.
3. The candidates are hashed whole, with 96 bits, and meet in the same way. That
   is the extension of the anchor to a full match on all its sides, without
   comparing pairs: a group of any size costs its members.
4. Each document gets its repeated windows and drops the words they cover.

Where hashes meet, each task or block has joined its own copies first and sends one
entry per hash, so a passage in a third of all documents gives a partition no more
entries than there are tasks or blocks. Texts are dealt by document id to blocks of
about ``BLOCK_BYTES``, once; that exchange serves both steps that look at places.

Defined results: a null or empty text has no words. Rows are documents of their
own, so equal rows repeat each other. Rows that share an id are told apart by their
text; a null id is replaced by a hash of the text. Texts shorter than a window are
never changed. Columns of the input are kept; ``n_words``, ``n_removed`` and
``kept_text`` of the input are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codestrata.llm.tables import blocks_of, shuffle_partitions, text_slices
from codestrata.llm.word_hashes import mix, window_hashes, words_of

WIDTH = 35
BUCKETS_PER_PARTITION = 3
ENTRIES_PER_FLUSH = 1 << 20
BLOCK_BYTES = 8 << 20

# Difference sets; every residue is a difference of two members.
COVERS = {
    1: (0,),
    3: (0, 1),
    7: (1, 2, 4),
    13: (0, 1, 3, 9),
    21: (3, 6, 7, 12, 14),
    31: (1, 5, 11, 24, 25, 27),
    57: (0, 1, 6, 15, 22, 26, 45, 55),
}

_BUCKET_COLUMNS = "bucket int, entries binary, settled binary"
_BUCKETS = pa.schema([("bucket", pa.int32()), ("entries", pa.binary()), ("settled", pa.binary())])

#: An entry: two parts of a hash, the document (id and text hash), the place, and
#: whether the hash is already known to be shared.
_PLACE = (("document", "<i8"), ("text_hash", "<i4"), ("place", "<i4"))
_ENTRY = (("low", "<u8"), ("high", "<u4"), *_PLACE, ("known", "u1"))


def period_for(width: int) -> int:
    """The largest period whose anchors still have two fifths of the words."""
    return max(v for v in COVERS if v == 1 or 5 * (width - v + 1) >= 2 * width)


def _packed(columns: dict[str, np.ndarray], layout, rows) -> bytes:
    """Columns one after the other: like values lie together and compress."""
    return b"".join(columns[name][rows].astype(kind).tobytes() for name, kind in layout)


def _unpacked(parts: list[bytes], layout) -> dict[str, np.ndarray]:
    size = sum(np.dtype(kind).itemsize for _, kind in layout)
    found: dict[str, list[np.ndarray]] = {name: [] for name, _ in layout}
    for part in parts:
        count, at = len(part) // size, 0
        for name, kind in layout:
            found[name].append(np.frombuffer(part, kind, count, at))
            at += count * np.dtype(kind).itemsize
    return {name: np.concatenate(values) for name, values in found.items()}


def shared_places(entered: DataFrame, blocks: int) -> DataFrame:
    """``_block, places``: the places of each block whose hashes occur twice or more.

    ``entered`` has what tasks or blocks send to each bucket of hashes.
    """
    partitions = shuffle_partitions(entered.sparkSession)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, settled = [], []
        for batch in batches:
            entries += batch.column("entries").to_pylist()
            settled += batch.column("settled").to_pylist()
        if entries:
            yield _by_block(_meet(entries, settled), blocks)

    return entered.repartition(partitions, "bucket").mapInArrow(meet, "_block bigint, places binary")


def _joined_in_task(held: list[dict[str, np.ndarray]], buckets: int) -> pa.RecordBatch:
    """One entry per distinct hash, dealt by hash; further copies are settled already."""
    columns = {name: np.concatenate([part[name] for part in held]) for name in held[0]}
    order = np.lexsort((columns["high"], columns["low"]))
    columns = {name: values[order] for name, values in columns.items()}
    first = _first_of_runs(columns)
    sizes = np.diff(np.append(np.flatnonzero(first), len(first)))
    columns["known"] = np.zeros(len(first), np.uint8)
    columns["known"][first] = sizes > 1
    entered = np.flatnonzero(first)
    bucket = columns["low"][entered] % np.uint64(buckets)
    by_bucket = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[by_bucket], np.arange(buckets + 1, dtype=np.uint64))
    settled = np.flatnonzero(~first)
    # Settled places go anywhere; they are kept by document, so a bucket gets few rows of each.
    spread = mix(columns["document"][settled].astype(np.uint64)) % np.uint64(buckets)
    by_spread = np.argsort(spread, kind="stable")
    settled_cuts = np.searchsorted(spread[by_spread], np.arange(buckets + 1, dtype=np.uint64))
    rows = []
    for number in range(buckets):
        own = entered[by_bucket[cuts[number] : cuts[number + 1]]]
        passed = settled[by_spread[settled_cuts[number] : settled_cuts[number + 1]]]
        if len(own) or len(passed):
            rows.append((number, _packed(columns, _ENTRY, own), _packed(columns, _PLACE, passed)))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([row[0] for row in rows], pa.int32()),
            pa.array([row[1] for row in rows], pa.binary()),
            pa.array([row[2] for row in rows], pa.binary()),
        ],
        names=["bucket", "entries", "settled"],
    )


def _first_of_runs(columns: dict[str, np.ndarray]) -> np.ndarray:
    first = np.ones(len(columns["low"]), bool)
    first[1:] = (columns["low"][1:] != columns["low"][:-1]) | (columns["high"][1:] != columns["high"][:-1])
    return first


def _meet(entries: list[bytes], settled: list[bytes]) -> dict[str, np.ndarray]:
    """Places whose hash another task, or their own, has as well."""
    columns = _unpacked(entries, _ENTRY)
    order = np.lexsort((columns["high"], columns["low"]))
    columns = {name: values[order] for name, values in columns.items()}
    first = _first_of_runs(columns)
    run = np.cumsum(first) - 1
    sizes = np.bincount(run)
    shared = (sizes[run] > 1) | (columns["known"] > 0)
    passed = _unpacked(settled, _PLACE)
    return {name: np.concatenate([columns[name][shared], passed[name]]) for name, _ in _PLACE}


def _by_block(places: dict[str, np.ndarray], blocks: int) -> pa.RecordBatch:
    block = places["document"].astype(np.int64) % blocks
    order = np.lexsort((places["place"], places["document"], block))
    cuts = np.searchsorted(block[order], np.arange(blocks + 1))
    filled = [number for number in range(blocks) if cuts[number] < cuts[number + 1]]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(filled, pa.int64()),
            pa.array([_packed(places, _PLACE, order[cuts[n] : cuts[n + 1]]) for n in filled], pa.binary()),
        ],
        names=["_block", "places"],
    )


class Found:
    """The places found in the documents of a block."""

    def __init__(self, rows: pa.Table):
        columns = _unpacked([b"", *rows.column("places").to_pylist()], _PLACE)
        order = np.argsort(columns["document"], kind="stable")
        self.document, self.text_hash, self.place = (columns[name][order] for name, _ in _PLACE)

    def of(self, document: int, text_hash: int | None) -> np.ndarray:
        """Places in a document, of the text with this hash if one is given."""
        begin, end = np.searchsorted(self.document, [document, document + 1])
        places = self.place[begin:end]
        return places if text_hash is None else places[self.text_hash[begin:end] == text_hash]


def _entries(batch: pa.RecordBatch, words, starts: np.ndarray, low, high, with_text: bool) -> dict:
    """Entries for windows that start at the words ``starts`` of the batch."""
    owner = np.searchsorted(words.offsets, starts, "right") - 1
    texts = batch.column("_text_hash").to_numpy(zero_copy_only=False)
    return {
        "low": low,
        "high": high,
        "document": batch.column("_document").to_numpy(zero_copy_only=False)[owner],
        "text_hash": texts[owner] if with_text else np.zeros(len(owner), np.int32),
        "place": (starts - words.offsets[owner]).astype(np.int32),
    }


def _room(words) -> tuple[np.ndarray, np.ndarray]:
    """Of each word: its place in its text, and how many words follow there, itself included."""
    sizes = np.diff(words.offsets)
    place = np.arange(len(words.hashes)) - np.repeat(words.offsets[:-1], sizes)
    return place, np.repeat(sizes, sizes) - place


def anchor_entries(batch: pa.RecordBatch, text_column: str, width: int, period: int) -> dict:
    words = words_of(batch.column(text_column))
    anchor = width - period + 1
    hashes = window_hashes(words.hashes, anchor)
    place, room = _room(words)
    size = len(hashes)
    in_text = np.repeat(np.diff(words.offsets) >= width, np.diff(words.offsets))
    at = np.flatnonzero(
        (room[:size] >= anchor) & in_text[:size] & np.isin(place[:size] % period, COVERS[period])
    )
    # Any document with the id may be meant: this only chooses candidates.
    return _entries(batch, words, at, hashes[at], np.zeros(len(at), np.uint32), with_text=False)


def _marked(batch: pa.RecordBatch, words, found: Found, with_text: bool) -> np.ndarray:
    """Words of the batch at whose place something was found."""
    marked = np.zeros(len(words.hashes), bool)
    documents, texts = batch.column("_document").to_pylist(), batch.column("_text_hash").to_pylist()
    for row, (document, text_hash) in enumerate(zip(documents, texts, strict=True)):
        begin, end = words.offsets[row], words.offsets[row + 1]
        places = found.of(document, text_hash if with_text else None) + begin
        marked[places[places < end]] = True
    return marked


def window_entries(
    batch: pa.RecordBatch, found: Found, text_column: str, width: int, period: int
) -> dict:
    """Windows around shared anchors."""
    words = words_of(batch.column(text_column))
    _, room = _room(words)
    anchors = _marked(batch, words, found, with_text=False)
    # A window holds the anchors that start in its first ``period`` words.
    before = np.concatenate([[0], np.cumsum(anchors)])
    ends = np.minimum(np.arange(len(anchors)) + period, len(anchors))
    at = np.flatnonzero((room >= width) & (before[ends] > before[:-1]))
    other = words_of(batch.column(text_column), seed=1)
    low = window_hashes(words.hashes, width)
    high = window_hashes(other.hashes, width, seed=1) >> np.uint64(32)
    return _entries(batch, words, at, low[at], high[at].astype(np.uint32), with_text=True)


def _kept(
    batch: pa.RecordBatch, found: Found, text_column: str, width: int
) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Numbers of words and of removed words, and the kept words joined by blanks."""
    words = words_of(batch.column(text_column))
    starts = _marked(batch, words, found, with_text=True)
    steps = np.zeros(len(starts) + 1, np.int64)
    np.add.at(steps, np.flatnonzero(starts), 1)
    np.add.at(steps, np.minimum(np.flatnonzero(starts) + width, len(starts)), -1)
    removed = np.cumsum(steps)[:-1] > 0
    totals = np.concatenate([[0], np.cumsum(removed)])
    n_removed = totals[words.offsets[1:]] - totals[words.offsets[:-1]]
    kept = []
    for row in range(batch.num_rows):
        begin, end = words.offsets[row], words.offsets[row + 1]
        parts = words.data[words.bounds[row] : words.bounds[row + 1]].tobytes().split()
        if n_removed[row]:
            parts = [part for part, gone in zip(parts, removed[begin:end], strict=True) if not gone]
        kept.append(b" ".join(parts))
    return np.diff(words.offsets), n_removed, kept


def remove_repeats(
    docs: DataFrame, width: int = WIDTH, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Columns of ``docs`` with ``n_words``, ``n_removed`` and ``kept_text``."""
    period = period_for(width)
    own = [name for name in docs.columns if name not in ("n_words", "n_removed", "kept_text")]
    integral = isinstance(docs.schema[id_column].dataType, T.IntegralType)
    document = F.col(id_column).cast("bigint") if integral else F.xxhash64(id_column)
    # Never null, also to the planner: both joins then see the very same rows.
    document = F.coalesce(F.when(F.col(id_column).isNotNull(), document), F.xxhash64(text_column))
    blocks = _prime(blocks_of(docs, text_column, BLOCK_BYTES))
    rows = docs.select(*own, document.alias("_document"), F.hash(text_column).alias("_text_hash"))
    blocked = rows.withColumn("_block", F.pmod("_document", F.lit(blocks)))
    buckets = shuffle_partitions(docs.sparkSession) * BUCKETS_PER_PARTITION

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in text_slices(batches, text_column):
            held.append(anchor_entries(batch, text_column, width, period))
            count += len(held[-1]["low"])
            if count >= ENTRIES_PER_FLUSH:
                yield _joined_in_task(held, buckets)
                held, count = [], 0
        if count:
            yield _joined_in_task(held, buckets)

    def enter_windows(texts, places):
        found = Found(places)
        slices = text_slices(texts.to_batches(), text_column)
        held = [window_entries(batch, found, text_column, width, period) for batch in slices]
        if not any(len(part["low"]) for part in held):
            return _BUCKETS.empty_table()
        return pa.Table.from_batches([_joined_in_task(held, buckets)])

    schema = T.StructType([docs.schema[name] for name in own])
    for name, kind in (("n_words", "long"), ("n_removed", "long"), ("kept_text", "string")):
        schema = schema.add(name, kind)

    def strip(texts, places):
        found, out = Found(places), []
        for batch in text_slices(texts.to_batches(), text_column):
            n_words, n_removed, kept = _kept(batch, found, text_column, width)
            arrays = [batch.column(name) for name in own]
            arrays += [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
            arrays.append(pa.array(kept, pa.binary()).cast(pa.string()))
            out.append(pa.RecordBatch.from_arrays(arrays, names=schema.names))
        return pa.Table.from_batches(out) if out else pa.table({name: [] for name in schema.names})

    texts = rows.select("_document", "_text_hash", text_column)
    anchors = shared_places(texts.mapInArrow(enter, _BUCKET_COLUMNS), blocks)
    by_block = blocked.groupBy("_block")
    entered = by_block.cogroup(anchors.groupBy("_block")).applyInArrow(enter_windows, _BUCKET_COLUMNS)
    windows = shared_places(entered, blocks)
    return by_block.cogroup(windows.groupBy("_block")).applyInArrow(strip, schema)


def _prime(least: int) -> int:
    """The first prime from ``least`` on: ids with any regular step then fill all blocks."""
    number = max(2, least)
    while any(number % k == 0 for k in range(2, int(number**0.5) + 1)):
        number += 1
    return number


def repeats_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: windows of 35 words, digest of what is kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, 35).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )
