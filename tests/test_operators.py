import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from codestrata.dataset import Dataset
from codestrata.operators.joins import count_over_join, hot_keys, natural_join, split_join
from codestrata.operators.ordering import with_position
from codestrata.plans import analyses


def test_natural_join_uses_all_shared_columns(spark):
    left = spark.createDataFrame([(1, "a", 10), (1, "b", 20)], "k int, s string, x int")
    right = spark.createDataFrame([(1, "a", True), (2, "b", False)], "k int, s string, y boolean")
    assert [tuple(r) for r in natural_join(left, right).collect()] == [(1, "a", 10, True)]


def test_natural_join_refuses_cross_product(spark):
    left, right = spark.range(2).toDF("a"), spark.range(2).toDF("b")
    with pytest.raises(ValueError, match="no shared columns"):
        natural_join(left, right)


def test_counts_over_joins_equal_counted_rows(spark):
    rng = random.Random(7)

    def table(columns, rows, values=6):
        pick = lambda: rng.choice([None, *range(values)])
        return spark.createDataFrame(
            [tuple(pick() for _ in columns) for _ in range(rows)], ", ".join(f"{c} int" for c in columns)
        )

    keyed = spark.createDataFrame([(i % 4, i, i % 3) for i in range(12)], "a int, k int, d int")
    chains = [
        [table("ab", 60), table("bc", 50), table("cd", 40)],
        [table("ab", 60), table("cd", 40), table("abc", 50)],
        [table("abc", 80), keyed, table("ad", 30)],
        [keyed],
    ]
    for tables in chains:
        with_keys = [(df, ["a", "k"] if df is keyed else []) for df in tables]
        columns = sorted({c for df in tables for c in df.columns})
        # The plain join needs an order in which neighbours share columns.
        ordered = sorted(tables, key=lambda df: -len(df.columns)) if tables == chains[1] else tables
        rows = natural_join(*ordered)
        for by in (columns[:1], columns[-1:], columns[:2], columns):
            plain = rows.groupBy(*by).agg(F.count("*").alias("n"))
            got = count_over_join(with_keys, by)
            assert got.columns == plain.columns
            assert got.exceptAll(plain).isEmpty() and plain.exceptAll(got).isEmpty()


def test_counts_over_joins_of_odd_tables(spark):
    empty = spark.createDataFrame([], "a int, n bigint")
    some = spark.createDataFrame([(1, 2)], "a int, _count int")
    assert count_over_join([(some, []), (empty, [])], ["a"]).isEmpty()
    assert [tuple(r) for r in count_over_join([(some, []), (some, ["a"])], ["_count"]).collect()] == [(2, 1)]
    with pytest.raises(ValueError, match="no such columns"):
        count_over_join([(some, [])], ["b"])
    with pytest.raises(ValueError, match="no shared columns"):
        count_over_join([(some, []), (spark.range(1), [])], ["a"])


def test_joined_equals_the_natural_join(ds):
    for names in (
        ("ref_commits", "commit_files", "files"),
        ("files", "commit_files", "commits", "refs"),
        ("refs", "files"),
    ):
        plain = natural_join(*(ds.table(name) for name in names))
        got = ds.joined(*names)
        assert sorted(got.columns) == sorted(plain.columns)
        digest = lambda df: df.agg(
            F.count("*"), F.sum(F.xxhash64(*sorted(plain.columns)).cast("decimal(38,0)"))
        ).first()
        assert digest(got) == digest(plain)
    with pytest.raises(ValueError, match="not joined"):
        ds.count_joined(["files"], ["file_path"], where={"refs": "true"})


def test_positions_with_a_hot_group(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 == 0 else f"g{i % 50}", rng.randrange(500), i) for i in range(20_000)]
    df = spark.createDataFrame(rows, "g string, t int, id int").repartition(7)
    got = with_position(df, ["g"], ["t", "id"])
    plain = df.withColumn(
        "position", F.row_number().over(Window.partitionBy("g").orderBy("t", "id")).cast("bigint")
    )
    assert got.count() == len(rows)
    assert got.select(plain.columns).exceptAll(plain).isEmpty()


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("hot_by", [["k"], ["k", "j"]])
def test_split_join_equals_plain_join(spark, how, hot_by):
    left = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 400).alias("k"),
        (F.col("id") % 2).alias("j"),
        F.col("id").alias("v"),
    )
    right = spark.range(1500).select(
        (F.col("id") % 300).alias("k"), (F.col("id") % 2).alias("j"), F.col("id").alias("w")
    )
    hot = hot_keys(left, hot_by, 100)
    assert not hot.isEmpty()
    got = split_join(left, right, ["k", "j"], ["v"], hot, how)
    plain = left.join(right, ["k", "j"], how)
    assert got.count() == plain.count()
    assert got.select(plain.columns).exceptAll(plain).isEmpty()


def test_tables_are_the_same_with_split_keys(spark, ds):
    split = Dataset(spark, ds.stored)
    split.find_hot(commits_per_tree=1, files_per_blob=5)
    assert "hot_blobs" in split.stored and "hot_blobs" not in ds.stored
    # The star schema has one commit per tree: name some trees as shared.
    trees = split.table("commits").select("repository_id", "tree_hash", F.lit(7).alias("groups"))
    split.stored["hot_trees"] = trees.limit(500)
    for name in ("files", "blobs", "commit_files", "commit_blobs", "commit_trees"):
        got, plain = split.table(name), ds.table(name)
        assert got.count() == plain.count()
        assert got.exceptAll(plain).isEmpty()
    calls = analyses.files_calling(split, "trim")
    assert sorted(map(tuple, calls.collect())) == sorted(
        map(tuple, analyses.files_calling(ds, "trim").collect())
    )
