"""The eleven tables: names, columns and types.

Columns shared by two tables are their natural-join key, so a column keeps its
name wherever it appears.
"""

from __future__ import annotations

from pyspark.sql import types as T

_TEXT = T.StringType()
_TIME = T.TimestampType()
_LONG = T.LongType()
_BLOB = T.BinaryType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


SCHEMAS: dict[str, T.StructType] = {
    "blobs": _table(repository_id=_TEXT, blob_hash=_TEXT, blob_size=_LONG, blob_content=_BLOB),
    "commit_blobs": _table(repository_id=_TEXT, commit_hash=_TEXT, blob_hash=_TEXT),
    "commit_files": _table(
        repository_id=_TEXT, commit_hash=_TEXT, file_path=_TEXT, blob_hash=_TEXT, tree_hash=_TEXT
    ),
    "commit_trees": _table(repository_id=_TEXT, commit_hash=_TEXT, tree_hash=_TEXT),
    "commits": _table(
        repository_id=_TEXT,
        commit_hash=_TEXT,
        commit_author_name=_TEXT,
        commit_author_email=_TEXT,
        commit_author_when=_TIME,
        committer_name=_TEXT,
        committer_email=_TEXT,
        committer_when=_TIME,
        commit_message=_TEXT,
        tree_hash=_TEXT,
        commit_parents=_TEXT,
    ),
    "files": _table(
        repository_id=_TEXT,
        file_path=_TEXT,
        blob_hash=_TEXT,
        tree_hash=_TEXT,
        blob_content=_BLOB,
        blob_size=_LONG,
    ),
    "ref_commits": _table(
        repository_id=_TEXT, commit_hash=_TEXT, ref_name=_TEXT, history_index=_LONG
    ),
    "refs": _table(repository_id=_TEXT, ref_name=_TEXT, commit_hash=_TEXT),
    "remotes": _table(repository_id=_TEXT, remote_name=_TEXT, remote_url=_TEXT),
    "repositories": _table(repository_id=_TEXT),
    "tree_entries": _table(
        repository_id=_TEXT,
        tree_hash=_TEXT,
        blob_hash=_TEXT,
        tree_entry_name=_TEXT,
        tree_entry_mode=_TEXT,
    ),
}

TABLES: tuple[str, ...] = tuple(sorted(SCHEMAS))

# commit_parents is JSON text; the catalog shows it as JSON.
JSON_COLUMNS = frozenset({"commit_parents"})
