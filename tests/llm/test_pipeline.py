import random

import pytest

import corpus_pipeline
from codestrata.llm.toxicity import labels_to_learn, toxicity
from pyspark.sql import functions as F

from llm.test_near_dedup import brute as near_brute
from llm.test_packing import check
from llm.test_substring_dedup import brute as substring_brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """The rows before and after each stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.stored(stage(spark, docs, SF), f"test-{name}")
        out[name] = (before, docs)
    return out


def test_columns(steps):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "substring_dedup", "mixing", "packing"]
    for name in names[:-1]:
        before, after = steps[name]
        assert after.dtypes == before.dtypes


def test_toxicity(spark, steps):
    before, after = steps["toxicity"]
    judged = toxicity(before, labels_to_learn(spark, SF), F.lit(False))
    clean = judged.where("predicted = 0").select("doc_id")
    assert sorted(after.collect()) == sorted(before.join(clean, "doc_id").select(*before.columns).collect())


def test_near_dedup(steps):
    before, after = steps["near_dedup"]
    rows = [(row["doc_id"], row["text"]) for row in before.collect()]
    expected = {i for i, _, component in near_brute(rows, 5, 80) if i == component}
    assert {row["doc_id"] for row in after.collect()} == expected


def test_substring_dedup(steps):
    before, after = steps["substring_dedup"]
    texts = {row["doc_id"]: row for row in before.collect()}
    rows = [(i, row["text"]) for i, row in texts.items()]
    expected = {
        i: texts[i]["text"] if not gone else kept for i, _, gone, kept in substring_brute(rows, 35)
    }
    found = after.collect()
    assert {row["doc_id"]: row["text"] for row in found} == expected
    assert all(row["n_chars"] == len(row["text"]) for row in found if row["text"] != texts[row["doc_id"]]["text"])


def test_mixing(steps):
    before, after = steps["mixing"]
    texts = {row["doc_id"]: row for row in before.collect()}
    assert all(row == texts[row["doc_id"]] for row in after.collect())


def test_packing(steps):
    before, after = steps["packing"]
    texts = [(row["doc_id"], row["text"]) for row in before.collect()]
    check(after.collect(), texts, 2048, 1)


def test_run(spark, steps):
    assert corpus_pipeline.run(spark, SF).agg(F.sum("length")).first() == steps["packing"][1].agg(F.sum("length")).first()


def test_odd_rows(spark, docs, odd, tmp_path):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    table = docs([*odd, *((50 + i, f"text {random.Random(i).random()}") for i in range(30))]).select(*columns)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(50, 1), (51, 0), (None, 1), (52, None)], "doc_id bigint, toxic bigint")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    empty = f"{tmp_path}/empty"
    table.limit(0).write.parquet(f"{empty}/documents.parquet")
    labels.limit(0).write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
