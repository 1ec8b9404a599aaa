"""Natural joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def natural_join(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Inner join on all shared columns, left to right.

    Tables without a shared column are refused: the result would be a cross
    product.
    """
    return reduce(_join, others, first)


def _join(left: DataFrame, right: DataFrame) -> DataFrame:
    shared = [column for column in left.columns if column in set(right.columns)]
    if not shared:
        raise ValueError(f"no shared columns: {left.columns} and {right.columns}")
    return left.join(right, shared)


def count_over_join(
    tables: Sequence[tuple[DataFrame, Sequence[str]]], by: Sequence[str], name: str = "n"
) -> DataFrame:
    """``natural_join(*tables).groupBy(*by)`` with the number of rows as ``name``.

    The joined rows are never made. Before each join both sides keep only the
    columns that ``by`` or a later table needs, one row per combination, with
    the number of rows it stands for; joined numbers multiply. Each table comes
    with a unique key (empty: none known): a table that keeps its key is not
    grouped. Rows with a NULL in a shared column join with nothing.
    """
    if not by:
        raise ValueError("no columns to group by")
    unknown = [c for c in by if not any(c in df.columns for df, _ in tables)]
    if unknown:
        raise ValueError(f"no such columns: {unknown}")
    count = _unused_name({c for df, _ in tables for c in df.columns} | {name})

    def needed(columns: Sequence[str], others: Sequence[DataFrame]) -> list[str]:
        wanted = set(by).union(*(df.columns for df in others))
        return [c for c in columns if c in wanted]

    def counted(df: DataFrame, key: Sequence[str], others: Sequence[DataFrame]) -> DataFrame:
        kept = needed(df.columns, others)
        if key and set(key) <= set(kept):
            return df.select(*kept, F.lit(1).cast("bigint").alias(count))
        return df.groupBy(*kept).agg(F.count(F.lit(1)).alias(count))

    (df, key), *rest = tables
    left = counted(df, key, [other for other, _ in rest])
    columns, seen = list(df.columns), [df]
    while rest:
        # The order does not change the numbers: the next table shares most columns.
        shared = [len(set(left.columns) & set(df.columns)) for df, _ in rest]
        df, key = rest.pop(shared.index(max(shared)))
        later = [other for other, _ in rest]
        right = counted(df, key, seen + later).withColumnRenamed(count, f"{count}_right")
        joined = _join(left, right)
        seen.append(df)
        columns += [c for c in df.columns if c not in columns]
        kept = needed([c for c in columns if c in joined.columns], later)
        product = F.sum(F.col(count) * F.col(f"{count}_right")).alias(count)
        left = joined.groupBy(*kept).agg(product)
    return left.groupBy(*by).agg(F.sum(count).alias(name))


def _unused_name(taken: set[str]) -> str:
    name = "_count"
    while any(column.startswith(name) for column in taken):
        name = f"_{name}"
    return name


def hot_keys(df: DataFrame, keys: list[str], rows_per_group: int) -> DataFrame:
    """Keys with more than ``rows_per_group`` rows, and the ``groups`` to split them into."""
    return (
        df.groupBy(*keys)
        .agg(F.ceil(F.count("*") / rows_per_group).alias("groups"))
        .where("groups > 1")
    )


def split_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    spread_by: list[str],
    hot: DataFrame | None,
    how: str = "inner",
    unique: bool = False,
) -> DataFrame:
    """Join on ``keys`` where some keys have very many left rows.

    ``hot`` names those keys (or some of their columns) and how many ``groups``
    to split each into. Left rows go to a group by a hash of ``spread_by``; the
    right rows of a hot key, and no others, are repeated once per group, which
    is a small part of the join's own output. The result is the plain join's.
    Without ``hot`` it is the plain join.

    ``unique`` tells that the right side has one row per key, in a way the
    optimizer understands: a left join whose right columns are not read is then
    dropped from the plan. The right side is grouped on the keys it is shuffled
    by anyway, so this adds no exchange and no sort.
    """
    if hot is None:
        return left.join(_one_per_key(right, keys) if unique else right, keys, how)
    by = [column for column in hot.columns if column != "groups"]
    groups = F.coalesce("groups", F.lit(1)).cast("bigint")
    spread = (
        left.join(hot, by, "left")
        .withColumn("_group", F.pmod(F.xxhash64(*spread_by), groups))
        .drop("groups")
    )
    repeated = (
        right.join(hot, by, "left")
        .withColumn("_group", F.explode(F.sequence(F.lit(0).cast("bigint"), groups - 1)))
        .drop("groups")
    )
    keys = [*keys, "_group"]
    if unique:
        repeated = _one_per_key(repeated, keys)
    return spread.join(repeated, keys, how).drop("_group")


def _one_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    others = [F.first(column).alias(column) for column in df.columns if column not in keys]
    return df.repartition(*keys).groupBy(*keys).agg(*others)
