"""Shared scratch space for snapshots and for cutting lineage.

Everything goes below ``spark.checkpoint.dir``, the folder all executors reach.
A lost executor therefore never takes written intermediate results with it.
"""

from __future__ import annotations

import re
import tempfile
import time
import uuid
import weakref
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tables that already exist as files; a snapshot keeps them without a copy.
_written: weakref.WeakSet[DataFrame] = weakref.WeakSet()

# Where a table that was written lies, and the columns it has a folder per value of.
_places: weakref.WeakKeyDictionary[DataFrame, tuple[str, tuple[str, ...]]] = weakref.WeakKeyDictionary()

# Tables in the catalog that know how their rows are dealt.
_dealt: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()

# Database of the tables that Spark has counted, and of those dealt out by a hash.
_COUNTED = "codestrata_counted"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of this application."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="codestrata-")
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/codestrata-{context.applicationId}"


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back: same rows, no lineage, known size."""
    # Hashes are hex text: zstd halves them, the default leaves them as they are.
    df.write.option("compression", "zstd").mode("errorifexists").parquet(path)
    return _read_back(df.sparkSession, df.schema, path)


def _read_back(spark: SparkSession, schema: T.StructType, path: str, folders: Sequence[str] = ()) -> DataFrame:
    df = spark.read.schema(schema).parquet(path)
    _places[df] = path, tuple(folders)
    return df


def counted(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A written table with its number of rows and of different values of ``columns``.

    With them the planner orders joins by cost. The files stay where they are; any
    other ``df`` comes back as it is.
    """
    spark = df.sparkSession
    if df in _dealt:
        table = _dealt[df]
    elif df in _places:
        path, folders = _places[df]
        table = _new_table(spark)
        fields = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in df.schema)
        partitions = f"PARTITIONED BY ({', '.join(folders)})" if folders else ""
        spark.sql(f"CREATE TABLE {table} ({fields}) USING parquet {partitions} LOCATION '{path}'")
        if folders:
            spark.sql(f"MSCK REPAIR TABLE {table}")
    else:
        return df
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR COLUMNS {', '.join(columns)}")
    return spark.table(table).select(*df.columns)


def _new_table(spark: SparkSession) -> str:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {_COUNTED} LOCATION '{scratch_root(spark)}/counted'")
    return f"{_COUNTED}.t_{uuid.uuid4().hex}"


def write_dealt(df: DataFrame, by: Mapping[str, Column], path: str, made: Sequence[Column]) -> DataFrame:
    """The columns ``made`` of ``df``, dealt out by a hash of ``by``: joins and groups on those shuffle nothing.

    ``by`` has columns of ``made`` by name, as they are computed from ``df``, whose narrow
    rows are what is shuffled. Every task then writes one bucket. Only the catalog
    knows of buckets, so the table is read through it.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = _new_table(spark)
    writer = df.repartition(buckets, *by.values()).select(*made).write.option("compression", "zstd")
    writer.option("path", path).bucketBy(buckets, *by).sortBy(*by).saveAsTable(table, format="parquet")
    written = spark.table(table)
    _dealt[written] = table
    return written


def write_clustered(
    df: DataFrame,
    columns: Sequence[str],
    path: str,
    bloom_filters: bool = False,
    folders: Sequence[str] = (),
    order: Sequence[Column] | None = None,
    made: Sequence[Column] | None = None,
) -> DataFrame:
    """``write_table`` sorted on ``columns`` (by the expressions ``order``, where given), so filters on them skip files and row groups.

    A hash of the row ends the range key: rows with one hot value spread over
    several files instead of one task. Each value of the columns ``folders`` has a
    folder of its own, so a filter on them does not look at the others. ``made`` are the
    columns to write, computed from the sorted rows: narrow rows are then what is
    shuffled and sorted, whatever long text is made from them.

    Expressions of ``order`` become columns before the sort, which would otherwise
    compute them for both rows of every comparison.
    """
    sort_by = [F.col(column) for column in columns] if order is None else order
    keys = [*(F.col(column) for column in folders), *sort_by]
    rest = F.xxhash64(*df.columns)
    dealt = df.repartitionByRange(*keys, rest)
    if order is None:
        ordered = dealt.sortWithinPartitions(*keys)
    else:
        by = {f"_order_{n}": key for n, key in enumerate(order)}
        ordered = dealt.withColumns(by).sortWithinPartitions(*folders, *by)
    written = ordered.select(*(df.columns if made is None else made))
    writer = written.write.option("compression", "zstd")
    if folders:
        writer = writer.partitionBy(*folders)
    if bloom_filters:
        for column in columns:
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.mode("errorifexists").parquet(path)
    return _read_back(df.sparkSession, written.schema, path, folders)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage of ``df`` through a table in the shared folder."""
    path = f"{scratch_root(df.sparkSession)}/steps/{label}-{uuid.uuid4().hex}"
    written = write_table(df, path)
    _written.add(written)
    return written


def is_materialized(df: DataFrame) -> bool:
    """Whether ``df`` is just what ``materialize`` returned."""
    return df in _written


_NOTE = "name string, path string, info string, entry string, at double"


def note(spark: SparkSession, folder: str, rows: Sequence[tuple[str, str | None, str]]) -> None:
    """Add an entry of ``(name, path, info)`` rows to the notes in ``folder``.

    An entry is one committed file, written last, so a half-written one is never read.
    """
    entry, at = uuid.uuid4().hex, time.time()
    noted = spark.createDataFrame([(*row, entry, at) for row in rows], _NOTE)
    noted.coalesce(1).write.json(f"{folder}/{entry}")


def notes(spark: SparkSession, folder: str) -> list:
    """Rows of all entries in ``folder``, the latest entry first; none if nothing was noted."""
    try:
        found = spark.read.schema(_NOTE).json(f"{folder}/*")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return found.orderBy(F.col("at").desc(), "entry", "name").collect()
