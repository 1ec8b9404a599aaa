"""A work directory of git repositories as the eleven tables.

The directory must be reachable under the same path on every executor. Tasks
call ``git`` only to list and read objects, in slices of bounded size, so a
huge repository is read by many tasks. Content is read once per distinct blob,
whatever the number of copies and forks. Everything relational (file lists of
trees, history of refs) is done by joins.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.dataset import Dataset
from codestrata.functions.language import language_of_content
from codestrata.operators.history import walk_history
from codestrata.operators.joins import hot_keys, split_join
from codestrata.operators.languages import with_language
from codestrata.scratch import materialize
from codestrata.sources import git_objects as git
from codestrata.sources.snapshot import Grown, open_snapshot

DIRECTORY_MODE = "040000"
SUBMODULE_MODE = "160000"

# Roots that list the same subtree in one join group.
ROOTS_PER_GROUP = 1000

_BATCH_ROWS = 10_000
_BATCH_BYTES = 16 << 20

_OBJECTS = pa.schema(
    [
        ("repository_id", pa.string()),
        ("path", pa.string()),
        ("object_hash", pa.string()),
        ("kind", pa.string()),
        ("size", pa.int64()),
        ("slice", pa.int64()),
    ]
)
_NAMED = pa.schema(
    [
        ("repository_id", pa.string()),
        ("kind", pa.string()),
        ("name", pa.string()),
        ("value", pa.string()),
    ]
)
_TIME = pa.timestamp("us", tz="UTC")
_COMMITS = pa.schema(
    [
        ("repository_id", pa.string()),
        ("commit_hash", pa.string()),
        ("commit_author_name", pa.string()),
        ("commit_author_email", pa.string()),
        ("commit_author_when", _TIME),
        ("committer_name", pa.string()),
        ("committer_email", pa.string()),
        ("committer_when", _TIME),
        ("commit_message", pa.string()),
        ("tree_hash", pa.string()),
        ("commit_parents", pa.string()),
    ]
)
_ENTRIES = pa.schema(
    [
        ("repository_id", pa.string()),
        ("tree_hash", pa.string()),
        ("blob_hash", pa.string()),
        ("tree_entry_name", pa.string()),
        ("tree_entry_mode", pa.string()),
    ]
)
_CONTENTS = pa.schema(
    [("blob_hash", pa.string()), ("blob_size", pa.int64()), ("blob_content", pa.binary())]
)
_SPARK_TYPES = {
    pa.string(): "string",
    pa.int64(): "bigint",
    pa.binary(): "binary",
    pa.bool_(): "boolean",
    _TIME: "timestamp",
}


def open_workdir(
    spark: SparkSession,
    workdir: str | None = None,
    refresh: bool = False,
    store: str | None = None,
    reread: bool = False,
) -> Dataset:
    """The dataset of a work directory (default: the current one).

    It is a snapshot: repositories added later appear after ``refresh``. With a
    ``store`` folder the snapshot is kept there and opened again by later applications.

    A refresh lists the refs and remotes of all repositories, and reads objects only
    of those where they changed; objects written since without any change of a ref
    appear with ``reread``, which reads everything again.
    """
    root = os.path.realpath(workdir if workdir is not None else os.getcwd())
    if not os.path.isdir(root):
        raise NotADirectoryError(f"no directory: {workdir}")
    return open_snapshot(spark, root, build, refresh or reread, store, grow=not reread)


def build(
    spark: SparkSession, root: str, before: Dataset | None = None
) -> dict[str, DataFrame | Grown]:
    """The relations of all repositories; those as they were ``before`` are not read again."""
    found = materialize(find_repositories(spark, root), "repositories")
    named = materialize(_listed(found, _named_rows, _NAMED), "names")
    states = materialize(repository_states(found, named), "states")
    repositories, same = found, None
    if before is not None and "states" in before.stored:
        same = materialize(
            states.join(before.stored["states"], states.columns, "left_semi").select("repository_id"),
            "same",
        )
        if same.isEmpty():
            same = None
        else:
            repositories = materialize(found.join(same, "repository_id", "left_anti"), "changed")

    def and_same(name: str, changed: DataFrame) -> DataFrame:
        if same is None:
            return changed
        kept = before.stored[name].join(same, "repository_id", "left_semi")
        return changed.unionByName(kept.select(*changed.columns))

    objects = materialize(_listed(repositories, _object_rows, _OBJECTS), "objects")
    commits = materialize(_read(objects, "commit", _commit_rows, _COMMITS), "commits")
    tree_entries = materialize(_read(objects, "tree", _entry_rows, _ENTRIES), "entries")
    refs = materialize(
        named.where("kind = 'ref'")
        .select("repository_id", F.col("name").alias("ref_name"), F.col("value").alias("commit_hash")),
        "refs",
    )
    tree_files, subtrees = expand_trees(commits, tree_entries)
    blobs = _one_owner(objects)
    if same is not None:
        known = before.stored["contents"].select(F.col("blob_hash").alias("object_hash"))
        blobs = blobs.join(known, "object_hash", "left_anti")
    added = materialize(
        _read(blobs, "blob", _content_rows, _CONTENTS).withColumn(
            "content_language", language_of_content()
        ),
        "contents",
    )
    contents = added if same is None else before.stored["contents"].unionByName(added)
    owned = objects.where("kind = 'blob'").select(
        "repository_id", F.col("object_hash").alias("blob_hash")
    )
    changed_refs = refs.join(repositories.select("repository_id"), "repository_id", "left_semi")
    return {
        "repositories": found.select("repository_id"),
        "states": states,
        "remotes": named.where("kind = 'remote'").select(
            "repository_id", F.col("name").alias("remote_name"), F.col("value").alias("remote_url")
        ),
        "refs": refs,
        "ref_commits": and_same("ref_commits", walk_history(commits, changed_refs)),
        "commits": and_same("commits", commits),
        "tree_entries": and_same("tree_entries", tree_entries),
        "tree_files": and_same("tree_files", with_language(tree_files, contents)),
        "subtrees": and_same("subtrees", subtrees),
        "owned_blobs": and_same("owned_blobs", owned),
        "contents": contents if same is None else Grown(before.stored["contents"], added),
    }


def repository_states(repositories: DataFrame, named: DataFrame) -> DataFrame:
    """``repository_id, path, state``: a digest of the refs and remotes, in any order."""
    row = ["kind", "name", "value"]
    digests = named.groupBy("repository_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.xxhash64(*row).cast("decimal(38,0)")).alias("total"),
        F.bit_xor(F.xxhash64(F.lit("state"), *row)).alias("mixed"),
    )
    state = F.concat_ws(":", "rows", "total", "mixed")
    return repositories.join(digests, "repository_id", "left").select(
        "repository_id", "path", state.alias("state")
    )


def find_repositories(spark: SparkSession, root: str) -> DataFrame:
    """``repository_id, path`` of the repositories at and below ``root``.

    Directories are listed level by level, each level as one distributed job.
    """
    schema = pa.schema([("path", pa.string()), ("is_repository", pa.bool_())])
    level = spark.createDataFrame([(root,)], "path string")
    found = []
    while True:
        listed = materialize(
            level.repartition(_partitions(spark)).mapInArrow(
                _mapper(_directory_rows, schema), _ddl(schema)
            ),
            "directories",
        )
        found.append(listed.where("is_repository"))
        level = listed.where("NOT is_repository").select("path")
        if level.isEmpty():
            break
    repositories = found[0]
    for deeper in found[1:]:
        repositories = repositories.unionByName(deeper)
    relative = F.substring("path", F.lit(len(root) + 2), F.length("path"))
    name = F.when(F.col("path") == root, F.lit(os.path.basename(root))).otherwise(relative)
    return repositories.select(name.alias("repository_id"), "path")


def expand_trees(commits: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """File lists and subtrees of every distinct root tree.

    One join per directory level. A subtree shared by very many roots is a hot
    join key with a large product, so its roots are split into groups.
    """
    key = ["repository_id", "tree_hash"]
    level = (
        commits.select(*key)
        .distinct()
        .select(*key, F.col("tree_hash").alias("root"), F.lit("").alias("prefix"))
    )
    files, folders = [], []
    while not level.isEmpty():
        hot = materialize(hot_keys(level, key, ROOTS_PER_GROUP), "hot")
        listed = materialize(
            split_join(level, entries, key, ["root", "prefix"], hot).select(
                "repository_id",
                "root",
                F.concat("prefix", "tree_entry_name").alias("file_path"),
                "blob_hash",
                F.col("tree_entry_mode").alias("mode"),
            ),
            "trees",
        )
        files.append(
            listed.where(~F.col("mode").isin(DIRECTORY_MODE, SUBMODULE_MODE)).select(
                "repository_id", "file_path", "blob_hash", F.col("root").alias("tree_hash")
            )
        )
        below = listed.where(F.col("mode") == DIRECTORY_MODE)
        folders.append(
            below.select(
                "repository_id",
                F.col("root").alias("tree_hash"),
                F.col("blob_hash").alias("subtree_hash"),
            )
        )
        level = below.select(
            "repository_id",
            F.col("blob_hash").alias("tree_hash"),
            "root",
            F.concat("file_path", F.lit("/")).alias("prefix"),
        )
    if not files:
        empty = entries.limit(0)
        text = lambda name: F.lit("").alias(name)
        return (
            empty.select("repository_id", text("file_path"), "blob_hash", "tree_hash"),
            empty.select("repository_id", "tree_hash", text("subtree_hash")),
        )
    return _union(files), _union(folders).distinct()


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _one_owner(objects: DataFrame) -> DataFrame:
    """Each distinct blob in one repository that holds it."""
    return (
        objects.where("kind = 'blob'")
        .groupBy("object_hash", "kind")
        .agg(F.min(F.struct("repository_id", "path", "slice")).alias("owner"))
        .select("owner.*", "object_hash", "kind")
    )


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _listed(repositories: DataFrame, rows: Callable, schema: pa.Schema) -> DataFrame:
    spread = repositories.repartition(_partitions(repositories.sparkSession), "repository_id")
    return spread.mapInArrow(_mapper(rows, schema), _ddl(schema))


def _read(objects: DataFrame, kind: str, rows: Callable, schema: pa.Schema) -> DataFrame:
    """Objects of one kind, a slice of a repository at a time."""
    spread = (
        objects.where(F.col("kind") == kind)
        .select("repository_id", "path", "object_hash", "slice")
        .repartition(_partitions(objects.sparkSession), "repository_id", "slice")
        .sortWithinPartitions("repository_id", "slice")
    )
    return spread.mapInArrow(_mapper(rows, schema), _ddl(schema))


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{field.name} {_SPARK_TYPES[field.type]}" for field in schema)


def _mapper(rows: Callable, schema: pa.Schema) -> Callable:
    """``mapInArrow`` function that turns input dicts into batches of tuples.

    ``rows`` yields (bytes held, tuple) pairs.
    """
    max_rows, max_bytes = _BATCH_ROWS, _BATCH_BYTES

    def batch_of(held: list[tuple]) -> pa.RecordBatch:
        columns = zip(*held, strict=True)
        arrays = [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def map_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for weight, row in rows(item for batch in batches for item in batch.to_pylist()):
            held.append(row)
            size += weight
            if len(held) >= max_rows or size >= max_bytes:
                yield batch_of(held)
                held, size = [], 0
        if held:
            yield batch_of(held)

    return map_batches


def _directory_rows(items: Iterator[dict]) -> Iterator[tuple[int, tuple]]:
    for item in items:
        if git.is_repository(item["path"]):
            yield 0, (item["path"], True)
        for path in git.subdirectories(item["path"]):
            yield 0, (path, False)


def _object_rows(items: Iterator[dict]) -> Iterator[tuple[int, tuple]]:
    for item in items:
        for row in git.object_rows(item["path"]):
            yield 0, (item["repository_id"], item["path"], *row)


def _named_rows(items: Iterator[dict]) -> Iterator[tuple[int, tuple]]:
    for item in items:
        for kind, rows in (("ref", git.ref_rows), ("remote", git.remote_rows)):
            for row in rows(item["path"]):
                yield 0, (item["repository_id"], kind, *row)


def _objects_of(items: Iterator[dict]) -> Iterator[tuple[dict, bytes]]:
    reader = git.ObjectReader()
    try:
        for item in items:
            yield item, reader.read(item["path"], item["object_hash"])
    finally:
        reader.close()


def _commit_rows(items: Iterator[dict]) -> Iterator[tuple[int, tuple]]:
    for item, data in _objects_of(items):
        *row, parents = git.commit_row(data)
        parents = json.dumps(parents, separators=(",", ":"))
        yield len(data), (item["repository_id"], item["object_hash"], *row, parents)


def _entry_rows(items: Iterator[dict]) -> Iterator[tuple[int, tuple]]:
    for item, data in _objects_of(items):
        for row in git.entry_rows(item["object_hash"], data):
            yield 100, (item["repository_id"], item["object_hash"], *row)


def _content_rows(items: Iterator[dict]) -> Iterator[tuple[int, tuple]]:
    for item, data in _objects_of(items):
        yield len(data), (item["object_hash"], len(data), data)
