"""Mixing sources to target weights by Poisson replication.

Each source gets a repetition rate: its target share of the characters over its
present share. Each document draws its number of copies from a Poisson
distribution with that mean by inverting the distribution function at a number
that a hash of seed and id gives, so the draw is the same on every run and
machine. Copies are exploded and put in a global random order.

Only sizes per source are gathered. They are broadcast when there are at most
``BROADCAST_SOURCES``; with more sources documents and rates are joined on the
source and a salt, so one hot source is spread over many tasks.

Defined results: a null source is a source of its own; a null text has no
characters; a source without characters has rate 1; documents with the same id
draw the same number, a null id like an empty one. A source left out of given
``weights`` gets none. Other columns are carried along; ``copy`` and
``shuffle_key`` of the input are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.llm.tables import stored

BROADCAST_SOURCES = 10_000
SALTS = 64
#: Digits of the hash that make the draw: 13 hexadecimal ones are 52 bits.
DRAW_DIGITS = 13


def repetition_rates(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    exponent: float = 0.5,
    source_column: str = "source",
    text_column: str = "text",
) -> DataFrame:
    """``_source, rate, thresholds`` per source.

    Targets are ``weights`` if given, else characters to the power ``exponent``
    (1 keeps the mix, 0 makes all sources equal). The expected number of
    characters is that of the input. ``thresholds`` is the Poisson distribution
    function at 0, 1, 2, ... until it no longer changes.
    """
    sizes = docs.groupBy(F.col(source_column).alias("_source")).agg(
        F.coalesce(F.sum(F.char_length(text_column)), F.lit(0)).cast("double").alias("size")
    )
    sizes = stored(sizes, "source-sizes")
    if weights is None:
        target = F.pow("size", F.lit(float(exponent)))
    else:
        target = F.lit(0.0)
        for source, weight in weights.items():
            target = F.when(
                F.col("_source").eqNullSafe(F.lit(source)), F.lit(float(weight))
            ).otherwise(target)
    sizes = sizes.withColumn("target", F.when(F.col("size") > 0, target).otherwise(0.0))
    total, targets = sizes.agg(F.sum("size"), F.sum("target")).first()
    rate = F.col("target") / F.lit(targets or 1.0) * F.lit(total or 0.0) / F.col("size")
    rates = sizes.select(
        "_source", F.when(F.col("size") > 0, rate).otherwise(F.lit(1.0)).alias("rate")
    )
    thresholds = F.pandas_udf(_thresholds, "array<double>")
    return stored(rates.withColumn("thresholds", thresholds("rate")), "source-rates")


def _thresholds(rates: pd.Series) -> pd.Series:
    return rates.map(poisson_thresholds)


def poisson_thresholds(rate: float) -> list[float]:
    """P(X <= 0), P(X <= 1), ... for mean ``rate``, up to where it reaches 1."""
    if rate <= 0:
        return []
    values, total, k = [], 0.0, 0
    while True:
        step = math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))
        total += step
        values.append(total)
        if k > rate and step < 1e-18:
            return values
        k += 1


def draw(seed: int, id_column: str) -> Column:
    """A number in [0, 1) from a hash of seed and id."""
    digest = F.md5(
        F.concat(F.lit(f"mix-{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit("")))
    )
    return F.conv(F.substring(digest, 1, DRAW_DIGITS), 16, 10).cast("bigint") / F.lit(
        float(16**DRAW_DIGITS)
    )


def mix_sources(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    exponent: float = 0.5,
    seed: int = 1,
    id_column: str = "doc_id",
    source_column: str = "source",
    text_column: str = "text",
) -> DataFrame:
    """Columns of ``docs`` with ``copy`` (from 1) and ``shuffle_key``, a row per copy.

    Partitions and their order follow the key, so files read one after the other
    are a uniformly shuffled corpus.
    """
    rates = repetition_rates(docs, weights, exponent, source_column, text_column)
    columns = [F.col(name) for name in docs.columns if name not in ("copy", "shuffle_key")]
    rows = docs.withColumn("_source", F.col(source_column)).withColumn(
        "_draw", draw(seed, id_column)
    )
    if rates.count() <= BROADCAST_SOURCES:
        joined = rows.join(F.broadcast(rates), rows["_source"].eqNullSafe(rates["_source"]))
    else:
        salted = rows.withColumn("_salt", F.pmod(F.xxhash64(id_column, text_column), F.lit(SALTS)))
        repeated = rates.withColumn(
            "_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))
        )
        joined = salted.join(
            repeated,
            salted["_source"].eqNullSafe(repeated["_source"])
            & (salted["_salt"] == repeated["_salt"]),
        )
    number = F.col("_draw")
    copies = F.when(F.size("thresholds") == 0, F.lit(0)).otherwise(
        F.size(F.filter("thresholds", lambda below: below <= number))
    )
    exploded = joined.withColumn("_copies", copies).where("_copies > 0").select(
        *columns, F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("copy")
    )
    key = F.md5(
        F.concat_ws(
            ":",
            F.lit(f"order-{seed}"),
            F.coalesce(F.col(id_column).cast("string"), F.lit("")),
            F.col("copy").cast("string"),
        )
    )
    return (
        exploded.withColumn("shuffle_key", key)
        .repartition("shuffle_key")
        .sortWithinPartitions("shuffle_key")
    )


def mixed_documents(spark, sf_dir: str) -> DataFrame:
    """The registered query: sources by the square root of their characters."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs)


ORACLE_SQL = """
WITH sizes AS (
  SELECT source, CAST(sum(length(coalesce(text, ''))) AS DOUBLE) AS size FROM documents GROUP BY source
), totals AS (
  SELECT sum(size) AS size, sum(sqrt(size)) AS target FROM sizes
), rates AS (
  SELECT source, CASE WHEN s.size > 0 THEN sqrt(s.size) / t.target * t.size / s.size ELSE 1.0 END AS rate
  FROM sizes s, totals t
), steps AS (
  SELECT source, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p
  FROM rates, (SELECT unnest(generate_series(0, 80)) AS k) ks
), thresholds AS (
  SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS below FROM steps
), draws AS (
  SELECT *, CAST('0x' || substr(md5('mix-1:' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT)
            / 4503599627370496.0 AS u
  FROM documents
), copies AS (
  SELECT d.doc_id, count(*) AS n FROM draws d JOIN thresholds t
    ON d.source IS NOT DISTINCT FROM t.source AND t.below <= d.u GROUP BY d.doc_id
), numbered AS (
  SELECT doc_id, CAST(unnest(generate_series(1, n)) AS INTEGER) AS copy FROM copies
)
SELECT d.*, copy, md5('order-1:' || CAST(doc_id AS VARCHAR) || ':' || CAST(copy AS VARCHAR)) AS shuffle_key
FROM documents d JOIN numbered USING (doc_id)
"""
