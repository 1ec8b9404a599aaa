"""Bounded, reproducible samples of labelled rows, and the folds of the contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.llm.tables import stored


def fold(id_column: str, folds: int) -> Column:
    """CRC-32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) % folds


def sample_per_class(rows: DataFrame, label: str, key: str, most: int, total: int) -> DataFrame:
    """At most ``most`` rows of every label; fewer where there are more than ``total / most`` labels.

    No label is left out: with very many each gives ``total / labels`` rows, one at
    least. Rows are taken in order of a hash of ``key``. Labels are counted first and a
    hash threshold thins them before the exact cut, so a frequent label does not
    meet in one task.
    """
    counts = stored(rows.groupBy(label).agg(F.count("*").alias("_n")), "class-counts")
    most = max(1, min(most, total // max(1, counts.count())))
    chance = F.pmod(F.xxhash64(F.lit(7), F.col(key)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # As in ``_share``.
    thinned = rows.join(counts, label).withColumn("_chance", chance).where(
        F.col("_chance") < F.lit(1.2 * most + 50) / F.col("_n")
    )
    order = Window.partitionBy(label).orderBy("_chance", key)
    return (
        thinned.withColumn("_place", F.row_number().over(order))
        .where(F.col("_place") <= most)
        .drop("_place", "_chance", "_n")
    )


def sample_rows(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` of ``rows``, in order of a hash of ``key``.

    A hash threshold from the count thins them first, so few more than ``most`` rows
    are ordered whatever the table's size.
    """
    chance = F.pmod(F.xxhash64(F.lit(7), F.col(key)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    thinned = rows.withColumn("_chance", chance).where(F.col("_chance") < _share(most, rows.count()))
    return thinned.orderBy("_chance", key).limit(most).drop("_chance")


def _share(most: int, count: int) -> float:
    """Enough of ``count`` rows that ``most`` of them remain, with few exceptions."""
    return min(1.0, (1.2 * most + 50) / max(1, count))
