"""Exact top-k by integer inner product: tiled matrix products, selection, merging.

Vectors become integers, floor(scale * x), and are packed into matrices of
``PACK_ROWS`` rows. Queries are dealt to slots, candidates to bands, and every
cell of slots x bands is one group: queries are repeated once per band,
candidates once per slot, never per pair. A cell multiplies its queries by one
pack of candidates after the other and keeps a running list of k per query, so a
pack costs a product and a partial selection, and lists are only touched where
the pack beats the worst entry held. Lists of all bands are merged in a tree:
``MERGE_FACTOR`` bands at a time, then those results, until one list is left.

Products are exact: in 64-bit floats while no sum can pass 2**53, else in
integers of any length; a score beyond a signed 64-bit integer is held at its end.

Defined results: vectors that are null, or hold null or non-finite components,
and rows with a null id take no part; vectors of different lengths are not
compared. A query leaves out every row with its own id. Equal scores go to the
smaller id. Repeated candidate rows each take a place; a repeated query row counts
once. Queries without any candidate have no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codestrata.llm.tables import stored

PACK_ROWS = 2048
SLOT_ROWS = 2048
BAND_ROWS = 16_384
TILE_QUERIES = 256
MERGE_FACTOR = 32
_EXACT_FLOAT = 1 << 53

_PACKED = "dim int, rows int, ids binary, data binary"
_HITS = "query_id bigint, vec_id bigint, score bigint, band bigint"


def integer_vectors(
    table: DataFrame, scale: int, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """``_id, _vector`` (array<bigint>) of the rows that take part."""
    wide = F.col(vector_column).cast("array<double>")
    whole = ~F.exists(
        wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    )
    rows = table.where(F.col(id_column).isNotNull() & F.col(vector_column).isNotNull() & whole)
    return rows.select(
        F.col(id_column).cast("bigint").alias("_id"),
        F.transform(wide, lambda x: F.floor(x * F.lit(float(scale)))).alias("_vector"),
    )


def _packs(vectors: DataFrame) -> DataFrame:
    """Vectors of one length in matrices of up to ``PACK_ROWS`` rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        count: dict[int, int] = {}
        for batch in batches:
            ids = batch.column("_id").to_numpy(zero_copy_only=False)
            vectors = batch.column("_vector")
            lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(lengths)
            for dim in np.unique(lengths):
                places = np.flatnonzero(lengths == dim)
                at = (ends[places] - dim)[:, None] + np.arange(dim)
                held.setdefault(int(dim), []).append((ids[places], flat[at]))
                count[int(dim)] = count.get(int(dim), 0) + len(places)
                if count[int(dim)] >= PACK_ROWS:
                    yield from _emit(int(dim), held.pop(int(dim)))
                    count.pop(int(dim))
        for dim, parts in held.items():
            yield from _emit(dim, parts)

    return vectors.mapInArrow(pack, _PACKED)


def _emit(dim: int, parts) -> Iterator[pa.RecordBatch]:
    ids = np.concatenate([part[0] for part in parts]).astype("<i8")
    data = np.concatenate([part[1] for part in parts]).astype("<i8")
    for begin in range(0, len(ids), PACK_ROWS):
        some = slice(begin, begin + PACK_ROWS)
        order = np.argsort(ids[some], kind="stable")
        yield pa.RecordBatch.from_pylist(
            [
                {
                    "dim": dim,
                    "rows": len(order),
                    "ids": ids[some][order].tobytes(),
                    "data": data[some][order].tobytes(),
                }
            ],
            schema=pa.schema(
                [("dim", pa.int32()), ("rows", pa.int32()), ("ids", pa.binary()), ("data", pa.binary())]
            ),
        )


def top_k(
    table: DataFrame,
    is_query: Column,
    k: int,
    scale: int,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the best ``k`` rows for each query row.

    ``is_query`` is a condition on ``_id``.
    """
    vectors = integer_vectors(table, scale, id_column, vector_column)
    queries = stored(_packs(vectors.where(is_query).dropDuplicates()), "query-packs")
    candidates = stored(_packs(vectors), "candidate-packs")
    n_queries = queries.agg(F.sum("rows")).first()[0] or 0
    n_candidates = candidates.agg(F.sum("rows")).first()[0] or 0
    slots, bands = -(-n_queries // SLOT_ROWS) or 1, -(-n_candidates // BAND_ROWS) or 1
    left = _dealt(queries, "slot", slots, "band", bands)
    right = _dealt(candidates, "band", bands, "slot", slots)

    def cell(key, left: pa.Table, right: pa.Table) -> pa.Table:
        return _cell(key[2].as_py(), left, right, k)

    hits = (
        left.groupBy("dim", "slot", "band")
        .cogroup(right.groupBy("dim", "slot", "band"))
        .applyInArrow(cell, _HITS)
    )
    while bands > MERGE_FACTOR:
        bands = -(-bands // MERGE_FACTOR)
        hits = _best(hits.withColumn("band", F.expr(f"band div {MERGE_FACTOR}")), ["query_id", "band"], k)
        hits = stored(hits.drop("rank"), "merged-lists")
    return _best(hits, ["query_id"], k).select("query_id", "rank", "vec_id", "score")


def _dealt(packs: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
    """Packs in one of ``n_own`` parts by hash, repeated for each of ``n_other``."""
    place = F.pmod(F.xxhash64("ids"), F.lit(n_own)).cast("bigint")
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_other - 1).cast("bigint")))
    return packs.withColumn(own, place).withColumn(other, every)


def _best(hits: DataFrame, group: list[str], k: int) -> DataFrame:
    """The first ``k`` of each group; Spark cuts each task's part before the shuffle."""
    order = Window.partitionBy(*group).orderBy(F.col("score").desc(), F.col("vec_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _matrices(packs: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for pack in packs.to_batches(max_chunksize=1):
        row = pack.to_pylist()[0]
        ids = np.frombuffer(row["ids"], "<i8")
        yield ids, np.frombuffer(row["data"], "<i8").reshape(len(ids), -1)


def _cell(band: int, left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    columns: list[list[np.ndarray]] = [[], [], []]
    for query_ids, query_data in _matrices(left):
        for begin in range(0, len(query_ids), TILE_QUERIES):
            ids = query_ids[begin : begin + TILE_QUERIES]
            best = _search(ids, query_data[begin : begin + TILE_QUERIES], right, k)
            for query_id, (found, scores) in zip(ids, best, strict=True):
                columns[0].append(np.full(len(found), query_id))
                columns[1].append(found)
                columns[2].append(scores)
    joined = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in columns]
    names = ["query_id", "vec_id", "score", "band"]
    bands = np.full(len(joined[0]), band, np.int64)
    return pa.table([pa.array(x, pa.int64()) for x in (*joined, bands)], names=names)


def _search(query_ids, query_data, packs: pa.Table, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the best ``k`` over all packs: ids and scores, best first."""
    none = np.zeros(0, np.int64)
    best = [(none, none) for _ in query_ids]
    for ids, data in _matrices(packs):
        scores, own = _products(query_data, data), ids[None, :] == query_ids[:, None]
        take = min(k, len(ids))
        # An own row must not count towards the selection, so one place more is looked at.
        cut = np.partition(np.where(own, scores.min() - 1, scores), len(ids) - take, axis=1)
        worst = cut[:, len(ids) - take]
        top = cut[:, len(ids) - take :].max(axis=1)
        for row, (held_ids, held_scores) in enumerate(best):
            floor = held_scores[-1] if len(held_ids) == k else None
            if floor is not None and top[row] < floor:
                continue
            line = scores[row]
            at = np.flatnonzero((line >= worst[row]) & ~own[row])
            if floor is not None:
                at = at[line[at] >= floor]
            more = np.concatenate([held_ids, ids[at]])
            values = np.concatenate([held_scores, line[at].astype(np.int64)])
            order = np.lexsort((more, -values.astype(np.float64) if _fits(values) else -values))[:k]
            best[row] = (more[order], values[order])
    return best


def _fits(values: np.ndarray) -> bool:
    return not len(values) or int(np.abs(values.astype(object)).max()) < _EXACT_FLOAT


def _products(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact inner products, as floats where they are whole and as integers otherwise."""
    if not queries.size or not candidates.size:
        return np.zeros((len(queries), len(candidates)))
    most = queries.shape[1] * _largest(queries) * _largest(candidates)
    if most < _EXACT_FLOAT:
        return queries.astype(np.float64) @ candidates.T.astype(np.float64)
    exact = queries.astype(object) @ candidates.T.astype(object)
    ends = np.iinfo(np.int64)
    return np.clip(exact, ends.min + 2, ends.max).astype(np.int64)


def _largest(data: np.ndarray) -> int:
    return max(abs(int(data.min())), abs(int(data.max())))


def nearest_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: rows with an id divisible by 20 against all others."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(table, F.col("_id") % 20 == 0, k=20, scale=64)


ORACLE_SQL = """
WITH vectors AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), components AS (
  SELECT vec_id, unnest(v) AS x, unnest(generate_series(1, len(v))) AS i FROM vectors
), scores AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM components q JOIN components c ON q.i = c.i AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0 GROUP BY q.vec_id, c.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
         vec_id, score FROM scores
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
