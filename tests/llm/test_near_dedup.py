import random

import numpy as np
import pytest

from codestrata.llm import near_dedup
from codestrata.llm.components import components
from codestrata.llm.near_dedup import CHUNK_WIDTH, CHUNKS, chunk_keys, keep_one, near_duplicates


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if len(words) >= width:
        return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))
    return frozenset([tuple(words)] if words else [])


def brute(texts, width, percent):
    """(id, n_shingles, component) of every row."""
    sets = [shingles(text, width) for _, text in texts]
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    out = []
    for place, (i, _) in enumerate(texts):
        ids = [texts[k][0] for k in range(len(texts)) if label[k] == label[place] and texts[k][0] is not None]
        out.append((i, len(sets[place]), i if not sets[place] else min(ids, default=None)))
    return sorted(out, key=lambda row: [(x is not None, x) for x in row])


def family(rng, size, words=120, changes=(0, 14)):
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    for _ in range(size):
        own = list(base)
        for _ in range(rng.randint(*changes)):
            own[rng.randrange(words)] = f"v{rng.randrange(5000)}"
        yield " ".join(own)


@pytest.mark.parametrize(("width", "percent", "block"), [(3, 85, 128), (5, 80, 8)])
def test_against_brute_force(docs, rows_of, width, percent, block, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_NODES", block)
    rng = random.Random(width)
    texts = [text for size in (90, 40, 7, 2, 2, 1, 1) for text in family(rng, size)]
    texts += [texts[0]] * 30 + [texts[1].upper(), texts[1].replace(" ", "\n")]
    rng.shuffle(texts)
    rows = list(enumerate(texts)) + [(900, None), (901, ""), (902, "a b"), (903, "A  b"), (904, "a"), (905, "a c")]
    found = near_duplicates(docs(rows), width, percent)
    assert rows_of(found, "doc_id", "n_shingles", "component_id") == brute(rows, width, percent)
    assert all(row["kept"] == (row["doc_id"] == row["component_id"]) for row in found.collect())


def test_odd_rows(docs, odd, rows_of):
    found = near_duplicates(docs(odd), 3, 85)
    assert rows_of(found, "doc_id", "n_shingles", "component_id") == brute(odd, 3, 85)
    assert near_duplicates(docs([])).count() == 0


def test_keep_one(docs, rows_of):
    rng = random.Random(3)
    first, second = list(family(rng, 2, changes=(0, 1)))
    rows = [(5, first), (3, second), (3, second), (None, first), (8, ""), (8, ""), (9, "other text"), (None, "x y"), (None, "x y")]
    kept = keep_one(docs(rows))
    assert rows_of(kept, "doc_id", "text") == [(None, "x y"), (3, second), (8, ""), (8, ""), (9, "other text")]
    assert kept.columns == docs(rows).columns


def test_pairs_within_the_distance_share_a_key():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a = rng.integers(0, 1 << 16, CHUNKS * CHUNK_WIDTH).astype(np.uint16)
        b = a.copy()
        changed = rng.choice(len(a), 2 * CHUNKS - 1, replace=False)
        b[changed] ^= 1
        keys = chunk_keys(np.stack([a, b]))
        assert set(keys[0]) & set(keys[1])


def test_components(spark, rows_of):
    chain = [(f"{i:03}".encode(), f"{i + 1:03}".encode()) for i in range(40)]
    links = spark.createDataFrame([*chain, (b"x", b"z"), (b"y", b"z"), (b"q", b"q")], "a binary, b binary")
    found = {bytes(row["node"]): bytes(row["label"]) for row in components(links).collect()}
    assert {found[f"{i:03}".encode()] for i in range(41)} == {b"000"}
    assert found[b"x"] == found[b"y"] == found[b"z"] == b"x" and found[b"q"] == b"q"


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a binary, b binary")).count() == 0


def test_many_rows_of_one_id(docs, rows_of):
    """Rows of one id, or of none, stay linear: each text is one candidate."""
    rng = random.Random(5)
    texts = list(family(rng, 60, changes=(0, 3)))
    rows = [(None if i % 2 else 1, text) for i, text in enumerate(texts)] + [(7, texts[0])] * 50
    found = near_duplicates(docs(rows), 3, 85)
    assert rows_of(found, "doc_id", "n_shingles", "component_id") == brute(rows, 3, 85)


def test_bitmap_keeps_what_is_wanted(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = spark.range(2000).select(F.struct("id", (F.col("id") * 7).alias("hash")).alias("own"), "id")
    few = rows.where("id % 50 = 0").select(F.col("own").alias("first"))
    likely = near_dedup._likely_in(rows, "own", few, "first")
    assert likely.where("id % 50 = 0").count() == 40 and likely.count() < 60
    monkeypatch.setattr(near_dedup, "BITMAP_BITS", 64)
    assert near_dedup._likely_in(rows, "own", few, "first").where("id % 50 = 0").count() == 40
