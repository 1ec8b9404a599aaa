import math
import random
import re
from collections import Counter, defaultdict

import pytest

from codestrata.llm import lexical_search
from codestrata.llm.lexical_search import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    counted = [(i, Counter(terms(text))) for i, text in docs if terms(text)]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(term for _, c in counted for term in c)
    wanted = defaultdict(list)
    for i, text in dict.fromkeys(items):
        wanted[i] += terms(text)
    out = []
    for item, own in wanted.items():
        found = []
        for i, c in counted:
            m = 25 + 75 * sum(c.values()) * n_docs // n_terms
            score = 0
            for term in own:
                if term in c:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                    score += weight * (1_000_000_000 * c[term] // (1000 * c[term] + 8 * m))
            if score:
                found.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(found)[:k], 1)]
    return out


def table(spark, rows, key):
    df = spark.createDataFrame(rows, f"{key} bigint, text string")
    return df.selectExpr("*", "'x' AS term", "'x' AS shard", "'x' AS score", "1 AS bundle", "0 AS rank").repartition(3)


def same(spark, docs, items, k=10):
    found = search(table(spark, docs, "doc_id"), table(spark, items, "item_id"), k).collect()
    key = lambda row: [(x is None, x or 0) for x in row]
    expected = sorted(brute(docs, items, k), key=key)
    assert sorted((tuple(row) for row in found), key=key) == expected
    return expected


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, small, monkeypatch):
    if small:  # many shards and bundles
        for name, value in (("SHARD_BYTES", 2000), ("SHARD_DOCS", 7), ("BUNDLE_ITEMS", 3), ("TERMS_AT_ONCE", 5)):
            monkeypatch.setattr(lexical_search, name, value)
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    text = lambda n: " ".join(rng.choices(words, weights, k=n))
    docs = [(i, text(rng.randint(1, 80))) for i in range(150)]
    items = [(i, text(rng.randint(1, 30))) for i in range(12)]
    assert len(same(spark, docs, items)) > 100


def test_odd_rows(spark, odd):
    items = [
        (1, "WORD one a b C"),
        (1, "WORD one a b C"),
        (1, "another text of item 1: 12 x"),
        (2, None),
        (3, ""),
        (4, "— … !"),
        (5, "nowhere"),
        (None, "id 中文 ünïcode Ünïcode"),
        (6, "word " * 1000),
    ]
    assert same(spark, odd, items)


def test_ties_by_id_and_hot_copies(spark):
    docs = [(i, "same words here") for i in range(300, 0, -1)] + [(7, "same words here"), (400, "other words")]
    found = same(spark, docs, [(1, "same"), (2, "other words")])
    assert [row[2] for row in found if row[0] == 1] == [1, 2, 3, 4, 5, 6, 7, 7, 8, 9]


def test_empty_tables(spark):
    assert same(spark, [], [(1, "a")]) == []
    assert same(spark, [(1, "a")], []) == []
    assert same(spark, [(1, None), (2, " ")], [(1, "a")]) == []


def test_norm_beyond_64_bits():
    import numpy as np

    values = np.array([10**9], np.int64)
    assert int((lexical_search._product(75 * 10**12, values) // 10**13)[0]) == 75 * 10**21 // 10**13
