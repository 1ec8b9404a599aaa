import hashlib
import random
from collections import Counter

import pytest

from codestrata.llm import substring_dedup
from codestrata.llm.substring_dedup import COVERS, period_for, remove_repeats


def brute(texts, width):
    words = [(text or "").encode().split() for _, text in texts]
    counts = Counter(tuple(own[i : i + width]) for own in words for i in range(len(own) - width + 1))
    out = []
    for (doc_id, _), own in zip(texts, words, strict=True):
        gone = {k for i in range(len(own) - width + 1) if counts[tuple(own[i : i + width])] > 1 for k in range(i, i + width)}
        kept = b" ".join(word for k, word in enumerate(own) if k not in gone)
        out.append((doc_id, len(own), len(gone), kept.decode()))
    return sorted(out, key=lambda row: [(x is not None, x) for x in row])


def corpus(rng):
    text = lambda n: " ".join(f"w{rng.randrange(40)}" for _ in range(n))
    shared = [text(n) for n in (34, 35, 36, 60, 200)]
    texts = [text(rng.randrange(1, 400)) for _ in range(40)]
    for _ in range(60):
        texts.append(f"{text(rng.randrange(50))}\n{rng.choice(shared)} {text(rng.randrange(50))}")
    texts += [shared[3]] * 5 + [f"{shared[4]} {text(3)} {shared[4]}"]
    return texts


@pytest.mark.parametrize("width", [35, 8, 1])
def test_against_brute_force(docs, rows_of, width, monkeypatch):
    monkeypatch.setattr(substring_dedup, "ENTRIES_PER_FLUSH", 500)
    rng = random.Random(width)
    rows = list(enumerate(corpus(rng))) + [(990, None), (991, "")]
    found = remove_repeats(docs(rows), width)
    assert rows_of(found, "doc_id", "n_words", "n_removed", "kept_text") == brute(rows, width)


def test_odd_rows(docs, odd, rows_of):
    rows = [*odd, (7, "another text of id seven"), (None, "second without id")]
    table = docs(rows)
    found = remove_repeats(table, 3)
    assert rows_of(found, "doc_id", "n_words", "n_removed", "kept_text") == brute(rows, 3)
    assert rows_of(found, "doc_id", "text") == rows_of(table, "doc_id", "text")
    assert remove_repeats(docs([])).count() == 0


def test_text_ids(spark, rows_of):
    text = " ".join(map(str, range(50)))
    table = spark.createDataFrame([("a", text), ("b", f"x {text} y"), ("c", "z")], "doc_id string, text string")
    found = remove_repeats(table)
    assert rows_of(found, "doc_id", "n_removed") == [("a", 50), ("b", 50), ("c", 0)]


def test_covers():
    for period, cover in COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    assert period_for(35) == 21 and period_for(1) == 1


def test_texts_are_shuffled_once(docs, spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = " ".join(map(str, range(50)))
        found = remove_repeats(docs([(1, text), (2, text), (3, "a b")], 1))
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    final = plan.split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final


def test_query_digest(spark):
    rows = substring_dedup.repeats_of_documents(spark, "/root/testdata/sf0.001").collect()
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    expected = [
        (i, n, gone, hashlib.sha256(kept.encode()).hexdigest())
        for i, n, gone, kept in brute([(row["doc_id"], row["text"]) for row in texts], 35)
    ]
    assert sorted(map(tuple, rows)) == expected
