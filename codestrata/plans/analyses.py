"""The documented analyses, each a function from a dataset to a DataFrame.

Top-k reports break ties by name. Full sorts also end in a unique key: it
makes the order stable and lets the range partitioner split a run of equal
counts over several tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.dataset import HEAD, Dataset
from codestrata.functions.sql import uast
from codestrata.operators.nodes import (
    parsable_blobs,
    per_file,
    trees_by_blob,
    trees_selected,
)


def _reachable(ds: Dataset, ref: str) -> DataFrame:
    return ds.table("ref_commits").where(F.col("ref_name") == ref)


def tip_trees(ds: Dataset, ref: str = HEAD) -> DataFrame:
    """Root tree of each repository at the tip of ``ref``.

    The tip is where ``ref_commits`` has ``history_index = 0``; ``refs`` names
    the same commits in far fewer rows. Written once, one row per repository,
    so joins with it are planned for its true size.
    """

    def build() -> DataFrame:
        tips = ds.table("refs").where(F.col("ref_name") == ref)
        commits = ds.table("commits").select("repository_id", "commit_hash", "tree_hash")
        return tips.join(commits, ["repository_id", "commit_hash"]).select(
            "repository_id", "tree_hash"
        )

    return ds.remembered(f"tip_trees:{ref}", build)


def tip_files(ds: Dataset, ref: str = HEAD) -> DataFrame:
    """Files of each repository at the tip of ``ref``: path, hashes and language."""
    lists = ds.classified_files_at_tips(ref)
    return lists.join(tip_trees(ds, ref), ["repository_id", "tree_hash"])


def top_repositories_by_commits(ds: Dataset, k: int = 10, ref: str = HEAD) -> DataFrame:
    return (
        _reachable(ds, ref)
        .groupBy("repository_id")
        .agg(F.count("*").alias("commit_count"))
        .orderBy(F.desc("commit_count"), "repository_id")
        .limit(k)
    )


def files_at_head(ds: Dataset, ref: str = HEAD) -> DataFrame:
    return ds.with_content_of_few(tip_files(ds, ref)).select("file_path", "blob_content")


def uast_at_head(ds: Dataset, ref: str = HEAD) -> DataFrame:
    """Syntax tree of every file at the tip; files without a tree are left out."""
    files = tip_files(ds, ref)
    trees = parsable_blobs(ds, files).select(
        "blob_hash", "lang", uast(F.col("blob_content"), F.col("lang")).alias("uast")
    )
    return per_file(ds, files, trees).where(F.length("uast") > 0).select("file_path", "uast")


def functions_of_language(ds: Dataset, language: str, ref: str = HEAD) -> DataFrame:
    """Functions, whole, in the files of one language at the tip; NULL where there is no tree."""
    files = tip_files(ds, ref).where(F.lower("language") == language.lower())
    functions = trees_selected(ds, files, "//FunctionGroup", [language])
    return per_file(ds, files, trees_by_blob(functions), "left").select(
        "repository_id", "file_path", F.col("nodes").alias("functions")
    )


def files_calling(ds: Dataset, method: str, ref: str = HEAD) -> DataFrame:
    """Files at the tip that call ``method``, with the calls."""
    files = tip_files(ds, ref)
    path = f'//*[@roleCallee]/Identifier[@Name="{method}"]'
    calls = trees_by_blob(trees_selected(ds, files, path))
    return per_file(ds, files, calls).select(
        "repository_id", "file_path", F.col("nodes").alias("functionCall")
    )


def blobs_by_path(ds: Dataset, *paths: str) -> DataFrame:
    """Content of the files at the given paths across history."""
    wanted = ds.tree_files.where(F.col("file_path").isin(*paths))
    return ds.with_content_of_few(wanted).select("repository_id", "blob_content")


def license_and_readme_blobs(ds: Dataset) -> DataFrame:
    return blobs_by_path(ds, "LICENSE", "README.md")


def license_blobs(ds: Dataset) -> DataFrame:
    return blobs_by_path(ds, "LICENSE").select("blob_content")


def last_commit_messages(ds: Dataset, ref: str = HEAD) -> DataFrame:
    tips = ds.table("refs").where(F.col("ref_name") == ref)
    commits = ds.table("commits").select("repository_id", "commit_hash", "commit_message")
    return tips.join(commits, ["repository_id", "commit_hash"]).select("commit_message")


def top_repositories_by_contributors(ds: Dataset, k: int = 10) -> DataFrame:
    return (
        ds.table("commits")
        .groupBy("repository_id")
        .agg(F.count_distinct("commit_author_email").alias("contributor_count"))
        .orderBy(F.desc("contributor_count"), "repository_id")
        .limit(k)
    )


# Sketches have 2^12 buckets: a relative standard error of about 1.6 %.
SKETCH_BITS = 12


def contributor_sketches(ds: Dataset) -> DataFrame:
    """``repository_id, contributors``: a mergeable sketch of the author addresses.

    Kept with the dataset and one small row per repository, so later questions
    over any set of repositories read no commits.
    """

    def build() -> DataFrame:
        sketch = F.hll_sketch_agg("commit_author_email", F.lit(SKETCH_BITS))
        return ds.table("commits").groupBy("repository_id").agg(sketch.alias("contributors"))

    return ds.remembered("contributor_sketches", build)


def approximate_contributors(ds: Dataset) -> DataFrame:
    """Distinct authors per repository, about; the exact count is in the report above."""
    estimate = F.hll_sketch_estimate("contributors")
    return contributor_sketches(ds).select("repository_id", estimate.alias("contributor_count"))


def approximate_contributors_of(ds: Dataset, repositories: DataFrame | None = None) -> DataFrame:
    """Distinct authors of the given repositories (default: all) together, about."""
    sketches = contributor_sketches(ds)
    if repositories is not None:
        sketches = sketches.join(repositories.select("repository_id").distinct(), "repository_id")
    merged = F.hll_sketch_estimate(F.hll_union_agg("contributors"))
    return sketches.agg(F.coalesce(merged, F.lit(0)).alias("contributor_count"))


def top_repositories_by_files(ds: Dataset, k: int = 10, ref: str = HEAD) -> DataFrame:
    """File rows summed over the history of ``ref``.

    Every row of ``commit_files`` has exactly one row in ``files``, so files
    are counted per tree before any join and no file row is joined at all.
    """
    per_tree = ds.tree_files.groupBy("repository_id", "tree_hash").agg(F.count("*").alias("n"))
    commits = ds.table("commits").select("repository_id", "commit_hash", "tree_hash")
    return (
        _reachable(ds, ref)
        .select("repository_id", "commit_hash")
        .join(commits, ["repository_id", "commit_hash"])
        .join(per_tree, ["repository_id", "tree_hash"])
        .groupBy("repository_id")
        .agg(F.sum("n").alias("num_files"))
        .orderBy(F.desc("num_files"), "repository_id")
        .limit(k)
    )


def committers_per_repository(ds: Dataset) -> DataFrame:
    return (
        ds.table("commits")
        .groupBy(
            F.col("commit_author_email").alias("author"), F.col("repository_id").alias("id")
        )
        .agg(F.count("*").alias("num_commits"))
        .orderBy(F.desc("num_commits"), "author", "id")
    )


def committers(ds: Dataset) -> DataFrame:
    return (
        ds.table("commits")
        .groupBy(F.col("commit_author_email").alias("author"))
        .agg(F.count("*").alias("num_commits"))
        .orderBy(F.desc("num_commits"), "author")
    )
