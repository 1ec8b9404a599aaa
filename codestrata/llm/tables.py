"""Written intermediate results and sizes, shared by the operators of this folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.scratch import scratch_root

#: Text that a task turns into arrays at a time.
SLICE_BYTES = 1 << 20


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which all executors reach."""
    return f"{scratch_root(spark)}/llm/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, **options: str | int) -> DataFrame:
    """``df`` written to the shared folder and read back: no lineage, known size."""
    path = new_folder(df.sparkSession, label)
    df.write.options(compression="zstd", **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_slices(
    batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices of at most ``limit`` bytes of ``column``.

    One longer value makes a slice of its own.
    """
    for batch in batches:
        offsets = batch.column(column).cast(pa.large_binary()).fill_null(b"")
        sizes = pc.binary_length(offsets).to_pylist()
        begin, total = 0, 0
        for row, size in enumerate(sizes):
            if row > begin and total + size > limit:
                yield batch.slice(begin, row - begin)
                begin, total = row, 0
            total += size
        if begin < batch.num_rows:
            yield batch.slice(begin)


def blocks_of(docs: DataFrame, text_column: str, block_bytes: int) -> int:
    """How many blocks of about ``block_bytes`` the texts make; at least one."""
    total = docs.agg(F.sum(F.octet_length(text_column).cast("bigint"))).first()[0]
    return max(1, -(-(total or 0) // block_bytes))
