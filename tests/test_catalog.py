import pytest
from pyspark.errors import AnalysisException, ParseException

from codestrata.dataset import Dataset
from codestrata.operators.catalog import describe_table, show_tables
from codestrata.schema import TABLES

NAMES = [
    "blobs",
    "commit_blobs",
    "commit_files",
    "commit_trees",
    "commits",
    "files",
    "ref_commits",
    "refs",
    "remotes",
    "repositories",
    "tree_entries",
]


def test_tables_without_a_source(spark):
    Dataset.empty(spark).register()
    listed = show_tables(spark)
    assert listed.columns == ["Table"]
    assert [r.Table for r in listed.collect()] == NAMES == list(TABLES)
    assert all(spark.table(name).isEmpty() for name in NAMES)


def test_describe(spark, ds):
    ds.register()
    rows = describe_table(spark, "repositories")
    assert rows.columns == ["name", "type"]
    assert [tuple(r) for r in rows.collect()] == [("repository_id", "TEXT")]
    assert [tuple(r) for r in describe_table(spark, "commits").collect()] == [
        ("repository_id", "TEXT"),
        ("commit_hash", "TEXT"),
        ("commit_author_name", "TEXT"),
        ("commit_author_email", "TEXT"),
        ("commit_author_when", "TIMESTAMP"),
        ("committer_name", "TEXT"),
        ("committer_email", "TEXT"),
        ("committer_when", "TIMESTAMP"),
        ("commit_message", "TEXT"),
        ("tree_hash", "TEXT"),
        ("commit_parents", "JSON"),
    ]
    for name in NAMES:
        assert describe_table(spark, name).count() == len(spark.table(name).columns)


@pytest.mark.parametrize(
    "query",
    [
        "select * from repositories",
        "SELECT * FROM REPOSITORIES;",
        " \t Select * From Repositories ; ",
        "/* comment */ select * from repositories;",
        "/* multi line\n comment */\n select * from repositories",
    ],
)
def test_spellings(ds, query):
    assert ds.sql(query).count() == 25


@pytest.mark.parametrize(
    "query, error",
    [
        ("show", ParseException),
        ("select from repositories", AnalysisException),
        ("select * from nope", AnalysisException),
        ("select nope from repositories", AnalysisException),
    ],
)
def test_errors(ds, query, error):
    with pytest.raises(error):
        ds.sql(query).collect()


def test_literal_without_table(spark):
    assert [tuple(r) for r in spark.sql("SELECT 1").collect()] == [(1,)]


@pytest.mark.parametrize("name", NAMES)
def test_tables_are_read_only(spark, ds, name):
    ds.register()
    values = ", ".join("NULL" for _ in spark.table(name).columns)
    with pytest.raises(AnalysisException):
        spark.sql(f"INSERT INTO {name} VALUES ({values})")


def test_unknown_table(spark, ds):
    with pytest.raises(KeyError, match="table not found"):
        ds.table("nope")
    with pytest.raises(KeyError, match="table not found"):
        describe_table(spark, "nope")
