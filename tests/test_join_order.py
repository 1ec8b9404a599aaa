"""SQL over three views and more joins in the order that costs least, whatever order it names."""

import re

import pytest

from codestrata.dataset import Dataset
from codestrata.sources.star_schema import open_star_schema

COUNT = (
    "SELECT f.repository_id, COUNT(*) num_files "
    "FROM ref_commits r NATURAL JOIN commit_files cf NATURAL JOIN files f GROUP BY f.repository_id"
)
TIPS = (
    "SELECT files.repository_id, files.file_path, files.blob_hash, refs.ref_name "
    "FROM files NATURAL JOIN commit_files NATURAL JOIN commits NATURAL JOIN refs"
)


@pytest.fixture(scope="module")
def star(spark, tmp_path_factory):
    """Two repositories of 300 commits, five branches each."""
    folder = tmp_path_factory.mktemp("star")
    tables = {
        "nation": "SELECT CAST(id AS int) n_nationkey FROM range(2)",
        "customer": "SELECT id c_custkey, CAST(id % 2 AS int) c_nationkey, 'Customer#' || id c_name, "
        "'S' || id DIV 2 c_mktsegment FROM range(10)",
        "orders": "SELECT id o_orderkey, id % 10 o_custkey, DATE'2020-01-01' + CAST(id AS int) o_orderdate, "
        "'1' o_orderpriority, 'O' o_orderstatus FROM range(600)",
        "lineitem": "SELECT id DIV 3 l_orderkey, id l_partkey FROM range(1800)",
        "documents": "SELECT id doc_id, 'x' text, 's' source FROM range(100)",
        "pages": "SELECT id page_id, '<p>' html FROM range(40)",
        "events": "SELECT id event_id, '{}' props FROM range(60)",
    }
    for name, text in tables.items():
        spark.sql(text).write.parquet(f"{folder}/{name}.parquet")
    return open_star_schema(spark, str(folder))


def _depths(df, column):
    """How far down the optimized plan the tables that have ``column`` lie."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    return [re.search(r"\w", line).start() for line in lines if "Relation" in line and f"{column}#" in line]


def test_few_tips_are_joined_before_all_files(star):
    rows = star.sql(TIPS)
    assert min(_depths(rows, "ref_name")) > min(_depths(rows, "file_path"))
    expected = star.joined("files", "commit_files", "commits", "refs").select(*rows.columns)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, expected.collect()))
    assert rows.count() == 12 * 5


def test_files_are_joined_before_refs_repeat_them(star):
    rows = star.sql(COUNT)
    assert max(_depths(rows, "history_index")) < min(_depths(rows, "file_path"))
    expected = star.count_joined(["ref_commits", "commit_files", "files"], ["repository_id"], "num_files")
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, expected.collect()))


def test_counted_tables_keep_their_folders(star):
    star.count_relations(["files"])
    at_head = star.stored["tree_files"].where("tip = 'HEAD'")
    assert at_head.count() == 2 * 5 and "tip" in at_head.columns


def test_file_rows_are_counted_last(star):
    """Whatever table is named first: commits are not multiplied by their files and then shuffled."""
    counted = star.count_joined(
        ["files", "commit_files", "ref_commits"],
        ["repository_id", "file_path"],
        where={"ref_commits": "ref_name = 'HEAD'"},
    )
    assert max(_depths(counted, "file_path")) < min(_depths(counted, "history_index"))
    joined = star.joined("files", "commit_files", "ref_commits").where("ref_name = 'HEAD'")
    expected = joined.groupBy("repository_id", "file_path").count()
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, expected.collect()))


@pytest.fixture
def shuffled(spark):
    """The shuffles of a query whose tables are too large for broadcasts, by the columns dealt on."""
    setting = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "-1")
    yield lambda df: re.findall(
        r"Exchange hashpartitioning\((.*), \d+\)", df._jdf.queryExecution().executedPlan().toString()
    )
    spark.conf.set(setting, before)


def test_file_rows_stay_where_they_are(star, shuffled):
    """Lists dealt out by tree meet each other and the commits without a shuffle of paths or trees."""
    rows = star.sql(COUNT)
    assert not [keys for keys in shuffled(rows) if "file_path" in keys or "tree_hash" in keys]
    expected = star.count_joined(["ref_commits", "commit_files", "files"], ["repository_id"], "num_files")
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, expected.collect()))
    dealt, lists = star.stored["tree_files_by_tree"], star.stored["tree_files"]
    assert sorted(map(str, dealt.select(*lists.columns).collect())) == sorted(map(str, lists.collect()))


def test_a_question_of_one_view_reads_lists_by_path(star):
    star.sql(COUNT)
    plan = star.sql("SELECT tree_hash FROM files WHERE file_path = 'LICENSE'")._jdf.queryExecution()
    assert "codestrata_counted" not in plan.executedPlan().toString()


def test_blobs_of_commits_are_shuffled_for_neither_step(star, shuffled):
    rows = star.table("commit_blobs")
    assert shuffled(rows) == []
    expected = star.table("commit_files").select(*rows.columns).distinct()
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, expected.collect()))


def test_lists_in_one_order_are_shuffled_once(star, shuffled):
    stored = {name: df for name, df in star.stored.items() if name != "tree_files_by_tree"}
    rows = Dataset(star.spark, stored).table("commit_blobs")
    assert len([keys for keys in shuffled(rows) if "tree_hash" in keys]) == 2  # file rows and commits
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, star.table("commit_blobs").collect()))


def test_trees_of_many_commits_are_not_joined_as_dealt(star):
    hot = star.stored["commits"].limit(1).selectExpr("repository_id", "tree_hash", "2L AS groups")
    other = Dataset(star.spark, {**star.stored, "hot_trees": hot})
    assert other.lists_by_tree == "tree_files" and star.lists_by_tree == "tree_files_by_tree"
    assert sorted(map(tuple, other.table("commit_blobs").collect())) == sorted(
        map(tuple, star.table("commit_blobs").collect())
    )
