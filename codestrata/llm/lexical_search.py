"""Ranked lexical search by pipelined term partitioning.

Documents are indexed in shards of about ``SHARD_BYTES`` of text and at most
``SHARD_DOCS`` documents: for each term of a shard its posting list, that is the
documents' slots in the shard with the term's occurrences. Only terms that some
item has are kept, by a join on the term; the lists are written and give document
frequencies.

Terms belong to owners by how common they are (``OWNERS``: shares of the
documents). Items are dealt to bundles of about ``BUNDLE_ITEMS``. A bundle starts in
every shard with no accumulators and visits the owners one after the other, the
rarest terms first: in a cogroup with the owner's posting lists of that shard the
owner adds its integer contributions, and the bundle goes on with the sparse
accumulators (item, slot, score) of the documents touched so far. The owner of the
commonest terms comes last and selects each item's best documents at once, so what
it touches is never sent. The best of all shards are merged by a final selection.

Sizes: a cogroup holds one shard's lists of one owner and one bundle's scores there
(about ``BUNDLE_ITEMS`` times ``SHARD_DOCS`` integers at most), whatever the corpus,
the term or the item. A very common term is one list per shard.

Terms are compared by 64-bit hashes of their lower-cased bytes: with a million item
terms against a billion others the chance of any clash is 5e-5.

Defined results: documents without a term (null, empty, no letters) count nowhere
and are never found. Rows of equal id are documents of their own; a null id ranks
after the others of equal score. Rows of one item id, null included, are one item
with the terms of all its distinct texts; items without terms, or whose terms no
document has, give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codestrata.llm.tables import stored, text_slices
from codestrata.llm.word_hashes import Words, texts_as_bytes, words_of

SHARD_BYTES = 8 << 20
SHARD_DOCS = 1 << 14
BUNDLE_ITEMS = 256
#: An owner's terms are in at most this share of the documents; a last owner has the others.
OWNERS = (1 / 64, 1 / 8)
TERMS_AT_ONCE = 1 << 14

# The parts of the score.
_SCALE = 1_000_000_000

_INDEX = "shard bigint, term bigint, df bigint, postings binary"
_STATE = "bundle int, shard bigint, docs binary, scores binary"
_HITS = "bundle int, item int, doc_id bigint, score bigint"

#: Bytes that end a term become a blank, A-Z become a-z.
_FOLD = np.full(256, 0x20, np.uint8)
for _first, _last in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
    _FOLD[_first : _last + 1] = np.arange(_first, _last + 1)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)

_POSTING = np.dtype([("slot", "<u2"), ("tf", "<u4")])
_SCORE = np.dtype([("item", "<u4"), ("slot", "<u2"), ("score", "<i8")])


def terms_of(texts: pa.Array) -> Words:
    """Hashes of the terms of every text: runs of digits, letters a-z and other than ASCII."""
    data, bounds = texts_as_bytes(texts)
    folded = pa.LargeStringArray.from_buffers(
        len(bounds) - 1, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(_FOLD[data])
    )
    return words_of(folded)


class _Shard:
    """Documents gathered for one shard, and their posting lists."""

    def __init__(self):
        self.hashes, self.slots, self.ids, self.lengths = [], [], [], []
        self.bytes = 0

    def add(self, ids: list, hashes: np.ndarray, lengths: np.ndarray, size: int) -> None:
        first = len(self.ids)
        self.hashes.append(hashes)
        self.slots.append(np.repeat(np.arange(first, first + len(ids)), lengths))
        self.ids += ids
        self.lengths.append(lengths)
        self.bytes += size

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        """One row with ids and lengths (no term), then one per term."""
        hashes, slots = np.concatenate(self.hashes), np.concatenate(self.slots)
        order = np.lexsort((slots, hashes))
        hashes, slots = hashes[order], slots[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (slots[1:] != slots[:-1])
        first = np.flatnonzero(new)
        postings = np.empty(len(first), _POSTING)
        postings["slot"] = slots[first]
        postings["tf"] = np.diff(np.append(first, len(hashes)))
        hashes = hashes[first]
        ends = np.append(np.flatnonzero(hashes[1:] != hashes[:-1]) + 1, len(hashes))
        begins = np.append(0, ends[:-1])
        lengths = np.concatenate(self.lengths).astype("<i8")
        known = pa.array(self.ids, pa.int64())
        head = known.fill_null(0).to_numpy().astype("<i8").tobytes()
        head += np.array([i is None for i in self.ids], np.uint8).tobytes()
        yield _index_rows(shard, [None], [int(lengths.sum())], [head + lengths.tobytes()])
        for at in range(0, len(ends), TERMS_AT_ONCE):
            b, e = begins[at : at + TERMS_AT_ONCE], ends[at : at + TERMS_AT_ONCE]
            lists = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(),
                len(b),
                [
                    None,
                    pa.py_buffer((np.append(b, e[-1]) - b[0]) * _POSTING.itemsize),
                    pa.py_buffer(postings[b[0] : e[-1]].tobytes()),
                ],
            )
            yield _index_rows(shard, hashes[b].view(np.int64), e - b, lists.cast(pa.binary()))


def _index_rows(shard: int, terms, counts, postings) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([shard] * len(terms), pa.int64()),
            pa.array(terms, pa.int64()),
            pa.array(counts, pa.int64()),
            postings if isinstance(postings, pa.Array) else pa.array(postings, pa.binary()),
        ],
        names=["shard", "term", "df", "postings"],
    )


def _documents_of(postings: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, which of them are null, and lengths from a shard's row without term."""
    number = len(postings) // 17
    ids = np.frombuffer(postings, "<i8", number)
    nulls = np.frombuffer(postings, np.uint8, number, 8 * number).astype(bool)
    return ids, nulls, np.frombuffer(postings, "<i8", number, 9 * number)


def index_of(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``shard, term, df, postings`` of all terms; a row without term per shard holds its documents."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = TaskContext.get().partitionId() << 32, _Shard()
        for batch in text_slices(batches, "_text"):
            words = terms_of(batch.column("_text"))
            ids = batch.column("_id").to_pylist()
            for begin in range(0, len(ids), SHARD_DOCS):
                part = ids[begin : begin + SHARD_DOCS]
                bounds = words.offsets[begin : begin + len(part) + 1]
                lengths = np.diff(bounds)
                size = int(words.bounds[begin + len(part)] - words.bounds[begin])
                full = len(shard.ids) + len(part) > SHARD_DOCS or shard.bytes + size > SHARD_BYTES
                if shard.ids and full:
                    yield from shard.rows(number)
                    number, shard = number + 1, _Shard()
                held = np.flatnonzero(lengths)  # documents without a term take no slot
                if len(held):
                    hashes = words.hashes[bounds[0] : bounds[-1]]
                    shard.add([part[i] for i in held], hashes, lengths[held], size)
        if shard.ids:
            yield from shard.rows(number)

    rows = docs.select(
        F.col(id_column).cast("bigint").alias("_id"), F.col(text_column).alias("_text")
    )
    return rows.mapInArrow(build, _INDEX)


def item_terms(items: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``_item, term, n``: how often each item has each term. ``_item`` is the id as text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "_text"):
            words = terms_of(batch.column("_text"))
            rows = np.repeat(np.arange(batch.num_rows), np.diff(words.offsets))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_item").take(pa.array(rows)), pa.array(words.hashes.view(np.int64))],
                names=["_item", "term"],
            )

    rows = items.select(
        F.coalesce(F.concat(F.lit("i"), F.col(id_column).cast("string")), F.lit("")).alias("_item"),
        F.col(text_column).alias("_text"),
    ).distinct()
    found = rows.mapInArrow(count, "_item string, term bigint")
    return found.groupBy("_item", "term").agg(F.count("*").alias("n"))


def _visits(index: DataFrame, wanted: DataFrame, n_docs: int) -> DataFrame:
    """``bundle, shard, owner, weight, users, postings``: what a bundle meets at an owner.

    ``users`` are the bundle's items with the term, and how often they have it.
    """
    counts = index.where("term IS NOT NULL").groupBy("term").agg(F.sum("df").alias("df"))
    ratio = F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1).cast("double")
    owner = F.lit(0)
    for share in OWNERS:
        owner = owner + (F.col("df") > F.lit(share * n_docs)).cast("int")
    weights = counts.select(
        "term", F.floor(F.lit(1000.0) * F.log(ratio)).alias("weight"), owner.alias("owner")
    )
    users = wanted.groupBy("bundle", "term").agg(F.collect_list(F.struct("item", "n")).alias("users"))
    owned = stored(users.join(weights, "term"), "owned-terms")
    return index.select("shard", "term", "postings").join(owned, "term").drop("term")


def _visit(state: DataFrame, visits: DataFrame, n_docs: int, n_terms: int, k: int | None) -> DataFrame:
    """Bundles after an owner's contributions; with ``k``, each item's best documents instead."""

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        ids, nulls, lengths = _documents_of(row["docs"])
        held = np.frombuffer(row["scores"], _SCORE)
        users = right.column("users").to_pylist()
        most = max([*(user["item"] for some in users for user in some), *held["item"][-1:].tolist()], default=-1)
        scores = np.zeros((most + 1, len(ids)), np.int64)
        scores[held["item"], held["slot"]] = held["score"]
        norms = 25 + _product(75 * n_docs, lengths) // n_terms
        weights = right.column("weight").to_pylist()
        for some, weight, postings in zip(users, weights, right.column("postings"), strict=True):
            found = np.frombuffer(postings.as_py(), _POSTING)
            slots, tf = found["slot"], found["tf"].astype(np.int64)
            parts = weight * ((_SCALE * tf) // (1000 * tf + 8 * norms[slots].astype(np.int64)))
            for user in some:
                scores[user["item"], slots] += user["n"] * parts
        key = (row["bundle"], row["shard"])
        return _sparse(*key, row["docs"], scores) if k is None else _best(key[0], scores, ids, nulls, k)

    cells = ["bundle", "shard"]
    met = state.groupBy(*cells).cogroup(visits.groupBy(*cells))
    return met.applyInArrow(add, _STATE if k is None else _HITS)


def _product(factor: int, values: np.ndarray) -> np.ndarray:
    """``factor * values``, in integers of any length where 64 bits are too few."""
    if len(values) and factor * int(values.max()) >= 1 << 63:
        return factor * values.astype(object)
    return factor * values


def _sparse(bundle: int, shard: int, docs: bytes, scores: np.ndarray) -> pa.Table:
    items, slots = np.nonzero(scores)
    held = np.empty(len(items), _SCORE)
    held["item"], held["slot"], held["score"] = items, slots, scores[items, slots]
    columns = [pa.array([bundle], pa.int32()), pa.array([shard], pa.int64())]
    columns += [pa.array([docs], pa.binary()), pa.array([held.tobytes()], pa.binary())]
    return pa.table(columns, names=["bundle", "shard", "docs", "scores"])


def _best(bundle: int, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray, k: int) -> pa.Table:
    """The ``k`` best documents of each item, equal scores by ascending id, null last."""
    items, places = [], []
    for item, line in enumerate(scores):
        at = np.flatnonzero(line)
        if len(at) > k:
            worst = np.partition(line[at], len(at) - k)[len(at) - k]
            at = at[line[at] >= worst]
        at = at[np.lexsort((ids[at], nulls[at], -line[at]))][:k]
        items.append(np.full(len(at), item))
        places.append(at)
    at = np.concatenate(places) if places else np.zeros(0, np.int64)
    rows = np.concatenate(items) if items else np.zeros(0, np.int64)
    return pa.table(
        [
            pa.array(np.full(len(at), bundle), pa.int32()),
            pa.array(rows, pa.int32()),
            pa.array(ids[at], pa.int64(), mask=nulls[at]),
            pa.array(scores[rows, at], pa.int64()),
        ],
        names=["bundle", "item", "doc_id", "score"],
    )


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item.

    Columns for ids are named as in the inputs; those of documents are ``bigint``.
    """
    wanted = stored(item_terms(items, item_column, item_text_column), "item-terms")
    bundles = -(-wanted.select("_item").distinct().count() // BUNDLE_ITEMS) or 1
    bundle = F.pmod(F.xxhash64("_item"), F.lit(bundles)).cast("int")
    number = F.row_number().over(Window.partitionBy("bundle").orderBy("_item")) - 1
    named = wanted.select("_item", bundle.alias("bundle")).distinct().withColumn("item", number)
    named = stored(named, "items")
    terms = stored(wanted.select("term").distinct(), "item-term-keys")

    index = index_of(docs, id_column, text_column)
    keys = terms.unionByName(docs.sparkSession.range(1).select(F.lit(None).cast("bigint").alias("term")))
    index = stored(index.join(keys, index["term"].eqNullSafe(keys["term"]), "left_semi"), "postings")
    shards = index.where("term IS NULL")
    total = shards.agg(
        F.sum((F.octet_length("postings") / 17).cast("bigint")).alias("docs"), F.sum("df").alias("terms")
    ).first()

    visits = _visits(index, wanted.join(named, "_item"), total["docs"] or 0)
    every = F.explode(F.sequence(F.lit(0), F.lit(bundles - 1))).alias("bundle")
    # New columns, as both sides of the cogroups come from the index.
    state = shards.select(
        every, (F.col("shard") + 0).alias("shard"), F.col("postings").alias("docs"), F.lit(b"").alias("scores")
    )
    for owner in range(len(OWNERS) + 1):
        here = visits.where(F.col("owner") == owner)
        state = _visit(state, here, total["docs"], total["terms"], k if owner == len(OWNERS) else None)

    best = state.withColumn("_row", F.monotonically_increasing_id())
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_row")]
    place = F.row_number().over(Window.partitionBy("bundle", "item").orderBy(*order))
    ranked = best.withColumn("rank", place).where(F.col("rank") <= k).join(named, ["bundle", "item"])
    item = F.when(F.col("_item") != "", F.expr("substr(_item, 2)")).cast(items.schema[item_column].dataType)
    return ranked.select(item.alias(item_column), "rank", F.col("doc_id").alias(id_column), "score")


def best_documents_of_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: the ten best documents for every item of ``benchmark``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _terms_sql(table: str, key: str) -> str:
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    return f"SELECT {key}, unnest(regexp_extract_all({lower}, '{pattern}')) AS term FROM {table}"


ORACLE_SQL = f"""
WITH doc_terms AS (
  SELECT doc_id, term, count(*) AS tf FROM ({_terms_sql("documents", "doc_id")}) t GROUP BY doc_id, term
), item_terms AS (
  {_terms_sql("benchmark", "item_id")}
), lengths AS (
  SELECT doc_id, sum(tf) AS n FROM doc_terms GROUP BY doc_id
), totals AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
  FROM doc_terms, totals GROUP BY term, docs
), norms AS (
  SELECT doc_id, 25 + CAST(75 * n * docs AS BIGINT) // terms AS m FROM lengths, totals
), scores AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM item_terms JOIN doc_terms USING (term) JOIN weights USING (term) JOIN norms USING (doc_id)
  GROUP BY item_id, doc_id
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
         doc_id, score FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
