"""MinHash near-duplicates by a multi-index Hamming join.

1. Each document becomes its set of word shingles (64-bit hashes), a 128-bit digest
   of the set and a signature of ``CHUNKS * CHUNK_WIDTH`` minima of ``BITS`` bits.
   Documents with equal sets are one node from here on.
2. Multi-index join: a signature is split into ``CHUNKS`` chunks. Two signatures
   that differ in fewer than ``2 * CHUNKS`` places have, by the pigeonhole
   principle, a chunk with at most one differing place; every chunk is therefore
   entered under each of its versions with one place left open. All pairs within
   that distance share a key. For two sets with similarity 0.85 the chance that no
   chunk has at most one difference is (1 - 0.78) ** 12, about 2e-8.
3. Nodes that share a key are joined to the least of them, first within a task, then
   per key, so a key of any size makes no more rows than nodes. The components of
   these candidates hold every pair that shares a key. Here half of the digest names
   a node; two nodes of one name only become candidates.
4. Within a candidate component all pairs are compared on full sets, in blocks:
   a component of n nodes is dealt to g blocks and each pair of blocks is a group
   of its own, so no task holds more than two blocks. A group returns the links it
   needs to keep its nodes connected, not all pairs. One document of each candidate's
   set is read again, found by id and hash of the text; a bitmap of ``BITMAP_BITS``
   hashes of those, broadcast at that size whatever the corpus, keeps nearly all
   other texts out of the shuffle.
5. Components of the confirmed links; the label is the least document id.

Defined results: a text with fewer words than a shingle is one shingle of all its
words; without words (or null) the set is empty, such a document is alone and kept.
Copies are linked through their common set. Rows with equal ids are one document:
they get the same ``component_id`` where their sets are linked, else the id
belongs to several components; ``kept`` is true where ``doc_id`` is the component's
id. A null id is never the least; a component of null ids only has a null id and
keeps nothing. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm.components import components
from codestrata.llm.tables import shuffle_partitions, stored, text_slices
from codestrata.llm.word_hashes import mix, window_hashes, words_of

CHUNKS = 12
CHUNK_WIDTH = 6
BITS = 16
BUCKETS_PER_PARTITION = 3
BLOCK_NODES = 128
BLOCK_NODES_MOST = 2048
BLOCK_SHINGLES = 1 << 20
VOCABULARY_SLICE = 8192
BITMAP_BITS = 1 << 26
ENTRIES_PER_FLUSH = 1 << 20

_MULTIPLIERS = mix(np.arange(1, CHUNKS * CHUNK_WIDTH + 1, dtype=np.uint64) * np.uint64(7919)) | np.uint64(1)


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = words_of(texts, lower=True)
    windows = window_hashes(words.hashes, width)
    sets = []
    for begin, end in zip(words.offsets, words.offsets[1:], strict=False):
        if end - begin >= width:
            sets.append(np.unique(windows[begin : end - width + 1]))
        elif end > begin:
            # Shorter than a shingle: the whole sequence, told apart by its length.
            sets.append(window_hashes(words.hashes[begin:end], int(end - begin), seed=1))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def _digest(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """``BITS`` bits of the minimum under each hash function, a row per set; empty sets are 0."""
    filled = [place for place, shingles in enumerate(sets) if len(shingles)]
    out = np.zeros((len(sets), len(_MULTIPLIERS)), np.uint16)
    if filled:
        flat = np.concatenate([sets[place] for place in filled])
        starts = np.concatenate([[0], np.cumsum([len(sets[place]) for place in filled])[:-1]])
        for column, multiplier in enumerate(_MULTIPLIERS):
            least = np.minimum.reduceat(flat * multiplier, starts)
            out[filled, column] = (mix(least) >> np.uint64(64 - BITS)).astype(np.uint16)
    return out


def chunk_keys(signature: np.ndarray) -> np.ndarray:
    """All keys of each signature: every chunk with each of its places left open."""
    wide = signature.astype(np.uint64)
    keys = []
    for chunk in range(CHUNKS):
        part = wide[:, chunk * CHUNK_WIDTH : (chunk + 1) * CHUNK_WIDTH]
        for left_open in range(CHUNK_WIDTH):
            key = np.full(len(wide), chunk * CHUNK_WIDTH + left_open + 1, np.uint64)
            for place in range(CHUNK_WIDTH):
                if place != left_open:
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + part[:, place])
            keys.append(key)
    return np.stack(keys, 1)


def described(docs: DataFrame, width: int, id_column: str, text_column: str) -> DataFrame:
    """``_id, _text_hash, n_shingles, node, signature`` of every row; node is null for an empty set."""
    rows = docs.select(
        F.col(id_column).alias("_id"),
        F.xxhash64(text_column).alias("_text_hash"),
        F.col(text_column).alias("_text"),
    )
    kind = rows.schema["_id"].dataType.simpleString()

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "_text"):
            sets = shingle_sets(batch.column("_text"), width)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id"),
                    batch.column("_text_hash"),
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([_digest(x) for x in sets], pa.binary()),
                    pa.array([row.tobytes() for row in signatures(sets)], pa.binary()),
                ],
                names=["_id", "_text_hash", "n_shingles", "node", "signature"],
            )

    schema = f"_id {kind}, _text_hash bigint, n_shingles bigint, node binary, signature binary"
    return rows.mapInArrow(describe, schema)


_ENTRIES = "bucket int, keys binary, nodes binary, links binary"


def _name() -> Column:
    """The first 8 bytes of a node."""
    return F.substring("node", 1, 8)


def candidate_links(nodes: DataFrame) -> DataFrame:
    """``a, b``: names of nodes that share a key, each joined to the least of the key."""
    partitions = shuffle_partitions(nodes.sparkSession)
    buckets = partitions * BUCKETS_PER_PARTITION

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0
        for batch in batches:
            signature = b"".join(batch.column("signature").to_pylist())
            keys = chunk_keys(np.frombuffer(signature, np.uint16).reshape(batch.num_rows, -1))
            names = np.frombuffer(b"".join(batch.column("name").to_pylist()), ">u8")
            held.append((keys.ravel(), np.repeat(names.astype(np.uint64), keys.shape[1])))
            count += keys.size
            if count >= ENTRIES_PER_FLUSH:
                yield from _entries(held, buckets)
                held, count = [], 0
        if held:
            yield from _entries(held, buckets)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes, links = [], [], []
        for batch in batches:
            for row in batch.to_pylist():
                keys.append(np.frombuffer(row["keys"], np.uint64))
                nodes.append(np.frombuffer(row["nodes"], np.uint64))
                links.append(np.frombuffer(row["links"], np.uint64).reshape(-1, 2))
        if keys:
            _, _, more = _least_of_each(np.concatenate(keys), np.concatenate(nodes))
            pairs = np.unique(np.concatenate([*links, more]), axis=0).astype(">u8")
            yield pa.RecordBatch.from_arrays(
                [pa.array([x.tobytes() for x in side], pa.binary()) for side in (pairs[:, :1], pairs[:, 1:])],
                names=["a", "b"],
            )

    entered = nodes.select(_name().alias("name"), "signature").mapInArrow(enter, _ENTRIES)
    met = entered.repartition(partitions, "bucket").mapInArrow(meet, "a binary, b binary")
    return met.dropDuplicates()


def _least_of_each(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the least node of each, and links from it to the key's other nodes."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    least = nodes[first][np.cumsum(first) - 1] if len(keys) else nodes
    other = least != nodes
    links = np.unique(np.stack([least[other], nodes[other]], 1), axis=0)
    return keys[first], nodes[first], links


def _entries(held, buckets: int) -> Iterator[pa.RecordBatch]:
    """What a task has for each bucket; its own copies of a key are joined beforehand."""
    keys, nodes, links = _least_of_each(*(np.concatenate(x) for x in zip(*held, strict=True)))
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    spread = (mix(links[:, 1]) % np.uint64(buckets)).astype(np.int64)
    link_order = np.argsort(spread, kind="stable")
    link_cuts = np.searchsorted(spread[link_order], np.arange(buckets + 1))
    columns: list[list] = [[], [], [], []]
    for number in range(buckets):
        some = order[cuts[number] : cuts[number + 1]]
        own = link_order[link_cuts[number] : link_cuts[number + 1]]
        if len(some) or len(own):
            for column, value in zip(
                columns,
                (number, keys[some].tobytes(), nodes[some].tobytes(), links[own].tobytes()),
                strict=True,
            ):
                column.append(value)
    yield pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.int32()), *[pa.array(x, pa.binary()) for x in columns[1:]]],
        names=["bucket", "keys", "nodes", "links"],
    )


def confirmed_links(
    docs: DataFrame,
    members: DataFrame,
    width: int,
    percent: int,
    id_column: str,
    text_column: str,
) -> DataFrame:
    """``a, b``: links of the similarity join, enough to connect what it connects.

    ``members`` has ``node, label, first, n_shingles``: the candidate components and for
    each node ``id`` and ``text_hash`` of a document that has its set.
    """
    sizes = members.groupBy("label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    by_count = F.least(
        F.ceil(F.col("n") / BLOCK_NODES),
        F.greatest(F.lit(64).cast("bigint"), F.ceil(F.col("n") / BLOCK_NODES_MOST)),
    )
    blocks = F.greatest(by_count, F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("bigint")
    placed = members.join(sizes.select("label", blocks.alias("blocks")), "label").select(
        "node", "label", "first", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block")
    )
    texts = docs.select(
        F.struct(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("text_hash")).alias("_own"),
        F.col(text_column).alias("_text"),
    )
    # Of what the bitmap lets through most is wanted: both sides are shuffled, at any size.
    same = F.col("_own.id").eqNullSafe(F.col("first.id")) & (F.col("_own.text_hash") == F.col("first.text_hash"))
    wanted = _likely_in(texts, "_own", members.select("first"), "first").hint("merge").join(placed, same)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "_text"):
            found = shingle_sets(batch.column("_text"), width)
            # Rows may be equal in id and hash only.
            same = [_digest(x) == node for x, node in zip(found, batch.column("node").to_pylist(), strict=True)]
            names = ["node", "label", "blocks", "block"]
            out = [batch.column(name) for name in names]
            out.append(pa.array([x.tobytes() for x in found], pa.binary()))
            yield pa.RecordBatch.from_arrays(out, names=[*names, "shingles"]).filter(pa.array(same))

    with_sets = wanted.select("node", "label", "blocks", "block", "_text").mapInArrow(
        sets, "node binary, label binary, blocks bigint, block bigint, shingles binary"
    )
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    paired = with_sets.withColumn("_other", every).select(
        "label",
        F.least("block", "_other").alias("low"),
        F.greatest("block", "_other").alias("high"),
        "block",
        "node",
        "shingles",
    )
    keys = ["label", "low", "high"]
    dealt = paired.repartition(*keys).sortWithinPartitions(*keys, "block", "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            for row in batch.to_pylist():
                own = (row["label"], row["low"], row["high"])
                if own != key and rows:
                    yield from _compare(rows, percent)
                    rows = []
                key = own
                if not rows or rows[-1]["node"] != row["node"]:
                    rows.append(row)
        if rows:
            yield from _compare(rows, percent)

    return dealt.mapInArrow(compare, "a binary, b binary")


def _likely_in(rows: DataFrame, column: str, few: DataFrame, few_column: str) -> DataFrame:
    """``rows`` whose ``column`` is in ``few_column`` of ``few``, and some by chance.

    The bitmap has ``BITMAP_BITS`` bits in rows of 4 KB, so the broadcast is bounded.
    """
    def place(name: str) -> Column:
        return F.pmod(F.xxhash64(name), F.lit(BITMAP_BITS))

    bitmap = (
        few.select(place(few_column).alias("_bit"))
        .groupBy(F.bitmap_bucket_number("_bit").alias("_bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_bit")).alias("_bitmap"))
    )
    bitmap = stored(bitmap, "near-bitmap")
    placed = rows.withColumn("_bit", place(column)).withColumn("_bucket", F.bitmap_bucket_number("_bit"))
    at = F.bitmap_bit_position("_bit")
    byte = F.conv(F.hex(F.expr("substring(_bitmap, cast(bitmap_bit_position(_bit) div 8 as int) + 1, 1)")), 16, 10)
    found = F.getbit(byte.cast("int"), (at % 8).cast("int")) == 1
    return placed.join(F.broadcast(bitmap), "_bucket").where(found).select(*rows.columns)


def _compare(rows: list[dict], percent: int) -> Iterator[pa.RecordBatch]:
    """Links between the two blocks of a group, or within its only one."""
    sets = [np.frombuffer(row["shingles"], np.uint64) for row in rows]
    low = [place for place, row in enumerate(rows) if row["block"] == row["low"]]
    high = low if rows[0]["low"] == rows[0]["high"] else [p for p in range(len(rows)) if p not in set(low)]
    parent = list(range(len(rows)))

    def root(place: int) -> int:
        while parent[place] != place:
            parent[place] = parent[parent[place]]
            place = parent[place]
        return place

    left, right = [], []
    for i, j in _linked(sets, low, high, percent):
        a, b = root(i), root(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            left.append(rows[i]["node"])
            right.append(rows[j]["node"])
    if left:
        yield pa.RecordBatch.from_arrays(
            [pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["a", "b"]
        )


def _linked(sets, low: list[int], high: list[int], percent: int) -> Iterator[tuple[int, int]]:
    """Pairs with ``100 * intersection >= percent * union``, by products of membership."""
    sizes = np.array([len(x) for x in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, place, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[place] > 1
    numbers = np.cumsum(times > 1) - 1
    column, owner = numbers[place[shared]], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    common = np.zeros((len(low), len(high)), np.float32)
    total = int(column[-1]) + 1 if len(column) else 0
    for begin in range(0, total, VOCABULARY_SLICE):
        a, b = np.searchsorted(column, [begin, begin + VOCABULARY_SLICE])
        members = np.zeros((len(sets), min(VOCABULARY_SLICE, total - begin)), np.float32)
        members[owner[a:b], column[a:b] - begin] = 1
        common += members[low] @ members[high].T
    common = common.astype(np.int64)
    union = sizes[low][:, None] + sizes[high][None, :] - common
    for i, j in np.argwhere(100 * common >= percent * union):
        if low[i] != high[j]:
            yield low[i], high[j]


def _grouped(
    docs: DataFrame, width: int, percent: int, id_column: str, text_column: str
) -> tuple[DataFrame, DataFrame]:
    """Described rows, and per node its ``group`` and the least id of that."""
    table = stored(described(docs, width, id_column, text_column), "near-described")
    nodes = (
        table.where("node IS NOT NULL")
        .groupBy("node")
        .agg(
            F.min("_id").alias("first_id"),
            F.min(F.struct(F.col("_id").alias("id"), F.col("_text_hash").alias("text_hash"))).alias("first"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("signature").alias("signature"),
        )
    )
    nodes = stored(nodes, "near-nodes")
    candidates = components(candidate_links(nodes)).withColumnRenamed("node", "name")
    named = nodes.select("node", "first", "n_shingles", _name().alias("name"))
    members = stored(candidates.join(named, "name").drop("name"), "near-members")
    links = confirmed_links(docs, members, width, percent, id_column, text_column)
    groups = components(links).join(nodes.select("node", "first_id"), "node")
    least = groups.groupBy("label").agg(F.min("first_id").alias("_least"))
    linked = groups.join(least, "label").select("node", "label", "_least")
    all_groups = nodes.join(linked, "node", "left").select(
        "node",
        F.coalesce("label", "node").alias("group"),
        F.coalesce("_least", "first_id").alias("_component"),
    )
    return table, stored(all_groups, "near-groups")


def near_duplicates(
    docs: DataFrame,
    width: int = 5,
    percent: int = 80,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``id, n_shingles, component_id, kept`` for every row of ``docs``.

    Two documents are linked if 100 times the intersection of their sets is at least
    ``percent`` times the union.
    """
    table, groups = _grouped(docs, width, percent, id_column, text_column)
    found = table.join(groups, "node", "left")
    own = F.when(F.col("node").isNull(), F.col("_id")).otherwise(F.col("_component"))
    return found.select(
        F.col("_id").alias(id_column),
        "n_shingles",
        own.alias("component_id"),
        F.coalesce(F.col("_id") == own, F.lit(False)).alias("kept"),
    )


def keep_one(
    docs: DataFrame,
    width: int = 5,
    percent: int = 80,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """The rows of ``docs`` with one of each group, with all their columns.

    The row with the least id stays, a null id last, equal ids by a hash of the
    text; of rows equal in both one stays. Documents without words all stay.
    """
    table, groups = _grouped(docs, width, percent, id_column, text_column)
    rows = table.join(groups.select("node", "group"), "node")
    order = F.struct(F.col("_id").isNull().alias("last"), "_id", "_text_hash")
    chosen = rows.groupBy("group").agg(F.min(order).alias("chosen"))
    placed = rows.join(chosen, "group").select("_id", "_text_hash", (order == F.col("chosen")).alias("stays"))
    placed = stored(placed, "near-placed")
    own = docs.columns
    keyed = docs.select(
        *own, F.col(id_column).alias("_near_id"), F.xxhash64(text_column).alias("_near_hash")
    )
    gone = placed.where(~F.col("stays")).select("_id", "_text_hash").dropDuplicates()
    same = F.col("_near_id").eqNullSafe(F.col("_id")) & (F.col("_near_hash") == F.col("_text_hash"))
    kept = keyed.join(gone, same, "left_anti")
    twice = placed.where("stays").groupBy("_id", "_text_hash").agg(F.count("*").alias("n")).where("n > 1")
    if not twice.isEmpty():
        # Rows equal in id and text: one of each group's chosen rows.
        repeated = kept.join(twice.select("_id", "_text_hash"), same, "left_semi")
        single = kept.join(twice.select("_id", "_text_hash"), same, "left_anti")
        kept = single.unionByName(repeated.dropDuplicates(["_near_id", "_near_hash"]))
    return kept.select(*own)


def near_duplicates_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: three-word shingles, similarity 0.85."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, percent=85)
