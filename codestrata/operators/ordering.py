"""Positions within ordered groups of any size, and orders over several columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.scratch import materialize

# monotonically_increasing_id() keeps the row's offset in its low 33 bits.
_OFFSET_BITS = 33

# Bits of a column's rank in an interleaved order.
RANK_BITS = 5

# Values a column's ranks are fitted on, at most twice as many.
RANK_SAMPLE = 10_000


def with_position(
    df: DataFrame, group: Sequence[str], order: Sequence[str], position: str = "position"
) -> DataFrame:
    """``row_number()`` per ``group``, without bringing a group into one task.

    ``group + order`` must identify a row. Rows are range-partitioned and
    sorted on it, so a hot group spreads over many partitions; each row knows
    its offset there, and the sizes of the runs before it (one row per
    partition and group) give the rest.
    """
    keys = [*group, *order]
    in_chunks = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # Range bounds are sampled: write once so chunk and offset stay as they are.
    placed = materialize(
        in_chunks.withColumn("_chunk", F.spark_partition_id()).withColumn(
            "_offset",
            F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _OFFSET_BITS) - 1)),
        ),
        "ordered",
    )
    before = (
        Window.partitionBy(*group)
        .orderBy("_chunk")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    runs = materialize(
        placed.groupBy(*group, "_chunk")
        .agg(F.min("_offset").alias("_first"), F.count("*").alias("_size"))
        .select(
            *group,
            "_chunk",
            (F.coalesce(F.sum("_size").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        ),
        "runs",
    )
    return (
        placed.join(runs, [*group, "_chunk"])
        .withColumn(position, F.col("_offset") + F.col("_shift") + 1)
        .drop("_chunk", "_offset", "_shift")
    )


def interleaved_rank(df: DataFrame, columns: Sequence[str]) -> Column:
    """The bits of each column's rank in turn, the highest first.

    Ranks are the number of boundaries at or below a value. The boundaries cut a
    bounded random sample into equal parts: they decide only where a row is
    stored, never what a query returns. NULL has rank 0.
    """
    if not columns or len(columns) * RANK_BITS > 63:
        raise ValueError(f"between 1 and {63 // RANK_BITS} columns, not {len(columns)}")
    rows = df.count()
    fraction = min(1.0, RANK_SAMPLE / max(rows, 1))
    sample = df.select(*columns).sample(fraction, seed=1).limit(2 * RANK_SAMPLE).collect()
    ranks = []
    for i, column in enumerate(columns):
        values = sorted(row[i] for row in sample if row[i] is not None)
        parts = 1 << RANK_BITS
        cuts = {values[n * len(values) // parts] for n in range(1, parts)} if values else set()
        passed = [(F.col(column) >= F.lit(cut)).cast("bigint") for cut in sorted(cuts)]
        ranks.append(F.coalesce(reduce(add, passed, F.lit(0).cast("bigint")), F.lit(0)))
    bits = [
        F.shiftleft(F.shiftright(rank, bit).bitwiseAND(F.lit(1).cast("bigint")), bit * len(ranks) + place)
        for bit in range(RANK_BITS)
        for place, rank in enumerate(reversed(ranks))
    ]
    return reduce(add, bits)
