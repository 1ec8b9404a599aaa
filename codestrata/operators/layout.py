"""Clustered copies of tables for selective equality filters.

A copy is sorted on chosen columns, so a filter on them reaches Parquet as a
pushed filter and skips files and row groups by their statistics and Bloom
filters. A copy belongs to one dataset, stays when another dataset is opened,
and is rebuilt only on request. Which copies there are is noted beside them, so
any session that opens the dataset's folder finds them.

Sorted on several columns, only a filter on the first skips much. An interleaved
copy treats all of them alike: it is sorted by the bits of each column's rank in
turn, so a filter on any one of them skips files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame

from codestrata.dataset import Dataset
from codestrata.operators.ordering import interleaved_rank
from codestrata.scratch import note, notes, write_clustered


def copies(ds: Dataset) -> dict[tuple[str, tuple[str, ...]], str]:
    """Paths of the dataset's sorted copies by table and columns."""
    return _paths(ds, "copies")


def interleaved_copies(ds: Dataset) -> dict[tuple[str, tuple[str, ...]], str]:
    """Paths of the dataset's interleaved copies by table and columns."""
    return _paths(ds, "interleaved-copies")


def _paths(ds: Dataset, kind: str) -> dict[tuple[str, tuple[str, ...]], str]:
    found: dict[tuple[str, tuple[str, ...]], str | None] = {}
    for row in notes(ds.spark, f"{ds.folder}/{kind}"):  # the latest comes first
        found.setdefault((row["name"], tuple(json.loads(row["info"]))), row["path"])
    return {key: path for key, path in found.items() if path is not None}


def clustered(
    ds: Dataset, table: str, columns: Sequence[str], rebuild: bool = False
) -> DataFrame:
    """The copy of ``table`` clustered on ``columns``; made on first use or ``rebuild``."""
    path = None if rebuild else copies(ds).get((table, tuple(columns)))
    if path is None:
        path = f"{ds.folder}/clustered/{table}-{'-'.join(columns)}-{uuid.uuid4().hex}"
        write_clustered(ds.table(table), columns, path, bloom_filters=True)
        _note(ds, table, columns, path)
    return ds.spark.read.parquet(path)


def interleaved(
    ds: Dataset, table: str, columns: Sequence[str], rebuild: bool = False
) -> DataFrame:
    """The copy of ``table`` clustered on all ``columns`` alike; made on first use or ``rebuild``."""
    path = None if rebuild else interleaved_copies(ds).get((table, tuple(columns)))
    if path is None:
        path = f"{ds.folder}/interleaved/{table}-{'-'.join(columns)}-{uuid.uuid4().hex}"
        df = ds.table(table)
        order = [interleaved_rank(df, columns), *columns]
        write_clustered(df, columns, path, bloom_filters=True, order=order)
        _note(ds, table, columns, path, "interleaved-copies")
    return ds.spark.read.parquet(path)


def drop_copy(ds: Dataset, table: str, columns: Sequence[str]) -> None:
    """Forget a copy; queries that opened it keep its files."""
    if (table, tuple(columns)) not in copies(ds):
        raise KeyError(f"no copy of {table} on {', '.join(columns)}")
    _note(ds, table, columns, None)


def _note(
    ds: Dataset, table: str, columns: Sequence[str], path: str | None, kind: str = "copies"
) -> None:
    note(ds.spark, f"{ds.folder}/{kind}", [(table, path, json.dumps(list(columns)))])
