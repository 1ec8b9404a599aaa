"""Plans must stay the ones meant for large data."""

import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from codestrata.dataset import Dataset
from codestrata.operators.layout import clustered, interleaved
from codestrata.plans import analyses


def plan_of(df):
    return df._jdf.queryExecution().toString()


def read_schemas(df):
    return re.findall(r"ReadSchema: (struct<[^\n]*)", plan_of(df))


def test_counts_read_no_content(ds):
    for job in (
        analyses.top_repositories_by_files,
        analyses.top_repositories_by_commits,
        analyses.top_repositories_by_contributors,
        analyses.committers,
        analyses.tip_files,
    ):
        assert not any("blob_content" in schema for schema in read_schemas(job(ds)))


def test_column_pruning_and_pushdown(ds):
    (schema,) = read_schemas(analyses.committers(ds))
    assert schema.startswith("struct<commit_author_email:string>")
    plan = plan_of(analyses.top_repositories_by_commits(ds))
    assert "EqualTo(ref_name,HEAD)" in plan
    assert "TakeOrderedAndProject" in plan


def test_content_of_few_files_is_not_shuffled(ds):
    for job in (analyses.files_at_head, analyses.license_and_readme_blobs):
        plan = plan_of(job(ds)).split("== Physical Plan ==")[1]
        assert "LeftSemi" in plan and "SortMergeJoin" not in plan
        assert "Exchange hashpartitioning(blob_hash" not in plan
    assert "In(file_path, [LICENSE,README.md])" in plan


@pytest.mark.parametrize("name", sorted(entry_module.queries()))
def test_no_cross_joins(spark, name):
    from conftest import SF_DIR

    plan = plan_of(entry_module.queries()[name](spark, SF_DIR))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_clustered_copy_reads_fewer_rows(ds):
    condition = "repository_id = 'repo-3'"
    copy = clustered(ds, "ref_commits", ["repository_id"])
    plain = ds.table("ref_commits")
    assert copy.exceptAll(plain).isEmpty() and plain.exceptAll(copy).isEmpty()
    found = copy.where(condition)
    assert "PushedFilters: [IsNotNull(repository_id), EqualTo(repository_id,repo-3)]" in plan_of(found)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.where(condition).collect()))


def test_trees_are_parsed_once_and_after_joins(ds):
    by_sql = ds.sql(
        "SELECT * FROM (SELECT cf.file_path, UAST(f.blob_content, LANGUAGE(f.file_path, f.blob_content)) as uast "
        "FROM ref_commits r NATURAL JOIN commit_files cf NATURAL JOIN files f "
        "WHERE r.ref_name = 'HEAD' AND r.history_index = 0) t WHERE uast != ''"
    )
    for df in (by_sql, analyses.uast_at_head(ds)):
        physical = plan_of(df).split("== Physical Plan ==")[1]
        assert physical.count("ArrowEvalPython") == 1
    physical = plan_of(by_sql).split("== Physical Plan ==")[1]
    assert physical.index("ArrowEvalPython") < physical.index("Join")


def test_tips_read_only_their_file_lists(ds):
    total = ds.tree_files.count()
    for ref in ("HEAD", "refs/heads/building"):
        tips = analyses.tip_files(ds, ref)
        scan = next(line for line in plan_of(tips).splitlines() if "PartitionFilters: [" in line and "tip" in line)
        assert "none" not in scan
        trees = analyses.tip_trees(ds, ref)
        everything = ds.classified_files.join(trees, ["repository_id", "tree_hash"])
        assert tips.columns == everything.columns and tips.count() == everything.count() > 0
        assert tips.exceptAll(everything).isEmpty()
    # One list per repository, however many commits there are.
    read = ds.classified_files_at_tips("HEAD")
    trees = read.select("repository_id", "tree_hash").distinct().count()
    assert trees == ds.table("refs").where("ref_name = 'HEAD'").count()
    assert read.count() * 10 < total


def scans(df, *columns):
    return [schema for schema in read_schemas(df) if all(column in schema for column in columns)]


def test_content_drops_out_where_it_is_not_read(ds):
    for text in (
        "SELECT count(*) FROM files",
        "SELECT repository_id, file_path FROM classified_files WHERE language = 'Java'",
        "SELECT count(*) FROM files NATURAL JOIN commit_files NATURAL JOIN classified_files",
        "SELECT repository_id, count(*) FROM files WHERE file_path LIKE 'src/%' GROUP BY repository_id",
    ):
        df = ds.sql(text)
        assert not scans(df, "blob_content") and "blob_size" not in plan_of(df).split("== Physical Plan ==")[1]
        assert not df.isEmpty()
    languages = "SELECT DISTINCT {} AS language, file_path, blob_hash FROM {}"
    stored = ds.sql(languages.format("language", "classified_files"))
    computed = ds.sql(languages.format("LANGUAGE(file_path, blob_content)", "files"))
    assert stored.exceptAll(computed).isEmpty() and computed.exceptAll(stored).isEmpty()


def test_content_is_shuffled_once_where_it_is_read(spark, ds):
    with_setting = {"spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {key: spark.conf.get(key) for key in with_setting}
    try:
        for key, value in with_setting.items():
            spark.conf.set(key, value)
        physical = plan_of(ds.sql("SELECT file_path, blob_content FROM files")).split("== Physical Plan ==")[1]
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    # One exchange and one sort a side: grouping on the key uses those of the join.
    assert physical.count("Exchange hashpartitioning(blob_hash") == 2
    assert physical.count("+- Sort [blob_hash") + physical.count(":- Sort [blob_hash") == 2


def test_file_lists_are_read_once_in_joins(ds):
    joined = ds.joined("ref_commits", "commit_files", "files").select("commit_hash", "file_path")
    counted = ds.count_joined(["ref_commits", "files", "commit_files"], ["repository_id"])
    for df in (joined, counted):
        assert len([line for line in plan_of(df).split("== Physical Plan ==")[1].splitlines() if "FileScan" in line]) == 3
        assert not scans(df, "blob_content")
    # Rows are counted per tree and commit before they meet; no join is on the repository alone.
    assert "[repository_id#" not in "".join(re.findall(r"Join \[repository_id#\d+\]", plan_of(counted)))


def files_with(df, column, value):
    """How many files of ``df`` may hold the value, by their statistics, and how many there are."""
    names = [name.removeprefix("file://") for name in df.inputFiles()]
    hits = 0
    for name in names:
        meta = pq.ParquetFile(name).metadata
        at = meta.schema.names.index(column)
        groups = [meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups)]
        hits += any(g.min <= value <= g.max for g in groups if g.has_min_max)
    return hits, len(names)


def test_interleaved_copy_skips_files_by_any_column(spark, ds):
    columns = ["repository_id", "commit_author_email"]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sorted_copy, copy = clustered(ds, "commits", columns), interleaved(ds, "commits", columns)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    plain = ds.table("commits")
    assert copy.columns == plain.columns and copy.count() == plain.count()
    assert copy.exceptAll(plain).isEmpty()
    row = plain.orderBy("commit_hash").first()
    for column in columns:
        read, files = files_with(copy, column, row[column])
        assert files > 16 and 2 * read < files
        found = copy.where(f"{column} = '{row[column]}'")
        assert f"EqualTo({column},{row[column]})" in plan_of(found)
        assert found.count() == plain.where(f"{column} = '{row[column]}'").count()
    second = columns[1]
    assert files_with(copy, second, row[second])[0] < files_with(sorted_copy, second, row[second])[0]
    assert interleaved(ds, "commits", columns).inputFiles() == copy.inputFiles()


def test_interleaved_copies_of_odd_tables(spark, ds):
    empty = Dataset.empty(spark)
    assert interleaved(empty, "refs", ["ref_name", "repository_id"]).isEmpty()
    with pytest.raises(ValueError, match="columns"):
        interleaved(ds, "refs", [])


def test_approximate_contributors_are_close(ds):
    exact = {r[0]: r[1] for r in ds.table("commits").groupBy("repository_id").agg(
        F.count_distinct("commit_author_email")).collect()}
    near = {r[0]: r[1] for r in analyses.approximate_contributors(ds).collect()}
    assert near.keys() == exact.keys()
    # Five standard errors of a sketch.
    assert all(abs(near[r] - exact[r]) <= max(1, 0.08 * exact[r]) for r in exact)
    some = ds.table("repositories").where("repository_id < 'repo-2'")
    for repositories in (None, some):
        commits = ds.table("commits")
        if repositories is not None:
            commits = commits.join(repositories, "repository_id", "left_semi")
        total = commits.agg(F.count_distinct("commit_author_email")).first()[0]
        merged = analyses.approximate_contributors_of(ds, repositories)
        assert abs(merged.first()[0] - total) <= max(1, 0.08 * total)
        assert "commit_author_email" not in plan_of(merged).split("== Physical Plan ==")[1]
    assert analyses.approximate_contributors_of(ds, some.limit(0)).first()[0] == 0
