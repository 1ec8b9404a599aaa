import numpy as np
import pytest
from pyspark.sql import functions as F

from codestrata.llm import topk_search
from codestrata.llm.topk_search import top_k

SCHEMA = "vec_id bigint, embedding array<float>, score string"


def brute(rows, k):
    usable = [
        (i, [int(np.floor(64 * float(np.float32(x)))) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for query in sorted({(i, tuple(v)) for i, v in usable if i % 20 == 0}):
        scores = [
            (-sum(a * b for a, b in zip(query[1], v)), i)
            for i, v in usable
            if i != query[0] and len(v) == len(query[1])
        ]
        out += [(query[0], rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def search(spark, rows, k=5):
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA).repartition(3)
    found = top_k(table, F.col("_id") % 20 == 0, k=k, scale=64)
    return sorted(tuple(row) for row in found.select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("small_tiles", [False, True])
def test_against_brute_force(spark, small_tiles, monkeypatch):
    if small_tiles:
        for name, value in (("PACK_ROWS", 16), ("SLOT_ROWS", 8), ("BAND_ROWS", 20), ("TILE_QUERIES", 3), ("MERGE_FACTOR", 2)):
            monkeypatch.setattr(topk_search, name, value)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(200)]
    rows += [(i, [0.5] * 6) for i in range(200, 260)]  # ties
    assert search(spark, rows) == sorted(brute(rows, 5))


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 2.0]), (1, [1.0, None]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (None, [1.0, 1.0])]
    rows += [(5, [2.0, 2.0]), (5, [2.0, 2.0]), (6, [1.0, 1.0, 1.0]), (20, [1.0, 1.0]), (40, []), (-20, [3.0, 3.0])]
    assert search(spark, rows) == sorted(brute(rows, 5))


def test_large_components_stay_exact(spark):
    rows = [(0, [1e7, 3.0]), (1, [1e7, 1.0]), (2, [1e7, 2.0]), (3, [-1e7, 0.0]), (20, [1.0, 1.0])]
    assert search(spark, rows) == sorted(brute(rows, 5))


def test_empty_table(spark):
    assert search(spark, []) == []
