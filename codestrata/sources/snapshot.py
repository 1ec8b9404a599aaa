"""Snapshots: the stored relations of one work directory, written once.

A snapshot is replaced as a whole and never updated, so running queries keep
what they started with. Its folder is named by a digest of the source, which
keeps the data of several work directories side by side.

A source that can tell what changed builds on the snapshot before: relations
given as ``Grown`` keep the files written then and add new ones.

Relations given as functions are made and written when a question first reads them:
what it does not name costs nothing. A ``store`` gets all of them at once.

With a ``store`` the folder outlives the application: a manifest, written last,
names the relations of the newest complete snapshot, and another session or
application opens it without reading the source.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codestrata.dataset import AT_HEAD, AT_REF, HEAD, IN_HISTORY, Dataset
from codestrata.scratch import (
    is_materialized,
    materialize,
    note,
    notes,
    scratch_root,
    write_clustered,
    write_dealt,
    write_table,
)

# Sort order of the large tables: the columns questions filter on by value.
CLUSTERED_ON = {
    "ref_commits": ("ref_name", "repository_id"),
    "tree_files": ("file_path", "repository_id"),
}

# Columns with a folder per value.
FOLDERS = {"tree_files": ("tip",)}

# Snapshots opened by this application: (application, source, store) -> dataset.
_opened: dict[tuple[str, str, str | None], Dataset] = {}


class Grown(NamedTuple):
    """A relation of the snapshot before, with rows to add."""

    before: DataFrame
    added: DataFrame


class Sorted(NamedTuple):
    """A clustered relation as narrow rows, their order and the columns made of them."""

    rows: DataFrame
    order: list[Column]
    made: list[Column | str]


class Dealt(NamedTuple):
    """A relation as narrow rows, the columns whose hash they are dealt by, and those made of them."""

    rows: DataFrame
    by: dict[str, Column]
    made: list[Column]


def source_key(source: str) -> str:
    return hashlib.sha1(source.encode()).hexdigest()


def source_folder(spark: SparkSession, source: str, store: str | None = None) -> str:
    return f"{store.rstrip('/') if store else scratch_root(spark)}/{source_key(source)}"


def open_snapshot(
    spark: SparkSession,
    source: str,
    build: Callable[..., Mapping[str, DataFrame | Grown]],
    refresh: bool = False,
    store: str | None = None,
    grow: bool = False,
) -> Dataset:
    """The snapshot of ``source``: built on first use, rebuilt only on ``refresh``.

    ``store`` is a folder every executor reaches; what is there is opened again.
    With ``grow`` a rebuild gets the snapshot before as its third argument.
    """
    key = (spark.sparkContext.applicationId, source, store)
    known = _opened.get(key)
    if not refresh and known is not None and known.spark is spark:
        return known
    home = source_folder(spark, source, store)
    dataset = None
    if store and not (refresh and not grow):
        dataset = _reopened(spark, home)
    if refresh and grow:
        # Another application may have refreshed the store since.
        before = dataset or (known if known is not None and known.spark is spark else None)
        dataset = None
        if before is not None:
            dataset = _built(spark, source, build, home, bool(store), before)
    if dataset is None:
        dataset = _built(spark, source, build, home, bool(store))
    _opened[key] = dataset
    return dataset


def _built(
    spark: SparkSession, source: str, build, home: str, durable: bool, before: Dataset | None = None
) -> Dataset:
    folder = f"{home}/snapshot-{uuid.uuid4().hex}"
    relations = dict(build(spark, source) if before is None else build(spark, source, before))
    if durable:
        relations = {name: df() if callable(df) else df for name, df in relations.items()}
    if isinstance(relations["tree_files"], DataFrame):
        relations["tree_files"] = with_tips(
            relations["tree_files"], relations["refs"], relations["commits"]
        )

    def stored(item: tuple[str, DataFrame | Grown | Sorted | Dealt | Callable]) -> DataFrame | Callable:
        name, df = item
        if callable(df):
            return lambda: stored((name, df()))
        if isinstance(df, Grown):
            return df.before.unionByName(stored((name, df.added)))
        if isinstance(df, Sorted):
            return write_clustered(
                df.rows,
                CLUSTERED_ON[name],
                f"{folder}/{name}",
                folders=FOLDERS.get(name, ()),
                order=df.order,
                made=df.made,
            )
        if isinstance(df, Dealt):
            return write_dealt(df.rows, df.by, f"{folder}/{name}", df.made)
        if name in CLUSTERED_ON:
            # Range partitioning samples its input first: without a table it would run twice.
            df = df if is_materialized(df) else materialize(df, name)
            return write_clustered(
                df, CLUSTERED_ON[name], f"{folder}/{name}", folders=FOLDERS.get(name, ())
            )
        # Steps of this application do not outlive it.
        return df if is_materialized(df) and not durable else write_table(df, f"{folder}/{name}")

    # The writes are independent jobs: small ones fill the gaps of large ones.
    with ThreadPoolExecutor(max_workers=4) as pool:
        written = pool.map(stored, relations.items())
        dataset = Dataset(spark, dict(zip(relations, written, strict=True)), home)
    dataset.find_hot(later=any(map(callable, relations.values())))
    if durable:
        rows = []
        for name, df in dataset.stored.items():
            if name not in relations:
                dataset.stored[name] = df = write_table(df, f"{folder}/{name}")
            paths = [f"{folder}/{name}"]
            if isinstance(relations.get(name), Grown):
                paths = [*before.paths[name], *paths]
            dataset.paths[name] = paths
            rows += [(name, path, df.schema.json()) for path in paths]
        note(spark, f"{home}/snapshots", rows)
    return dataset


def with_tips(tree_files: DataFrame, refs: DataFrame, commits: DataFrame) -> DataFrame:
    """``tree_files`` with ``tip``: ``HEAD``, ``ref`` or ``none``, the first that has the tree at its tip.

    Most lists belong to history; a question about a tip reads a folder whose size
    grows with the repositories (or their refs), not with the commits.
    """
    key = ["repository_id", "tree_hash"]
    rank = F.when(F.col("ref_name") == HEAD, F.lit(AT_HEAD)).otherwise(F.lit(AT_REF))
    tips = (
        refs.join(commits.select(*key, "commit_hash"), ["repository_id", "commit_hash"])
        .groupBy(*key)
        .agg(F.min(rank).alias("tip"))
    )
    joined = tree_files.join(materialize(tips, "tips"), key, "left")
    return joined.withColumn("tip", F.coalesce("tip", F.lit(IN_HISTORY)))


def _reopened(spark: SparkSession, home: str) -> Dataset | None:
    """The newest complete snapshot below ``home``, if there is one."""
    rows = notes(spark, f"{home}/snapshots")
    if not rows:
        return None
    paths: dict[str, list[str]] = {}
    schemas: dict[str, T.StructType] = {}
    for row in rows:
        if row["entry"] == rows[0]["entry"]:
            paths.setdefault(row["name"], []).append(row["path"])
            schemas[row["name"]] = T.StructType.fromJson(json.loads(row["info"]))
    stored = {name: spark.read.schema(schemas[name]).parquet(*paths[name]) for name in paths}
    dataset = Dataset(spark, stored, home)
    dataset.paths = paths
    return dataset
