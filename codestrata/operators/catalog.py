"""Table and column listings of the registered views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.schema import JSON_COLUMNS, SCHEMAS, TABLES

# Type names shown to users.
TYPE_NAMES = {
    "string": "TEXT",
    "timestamp": "TIMESTAMP",
    "timestamp_ntz": "TIMESTAMP",
    "bigint": "BIGINT",
    "binary": "BLOB",
}


def show_tables(spark: SparkSession) -> DataFrame:
    """One column with the names of the eleven tables, sorted."""
    return (
        spark.sql("SHOW TABLES")
        .where(F.col("isTemporary") & F.col("tableName").isin(*TABLES))
        .select(F.col("tableName").alias("Table"))
        .orderBy("Table")
    )


def describe_table(spark: SparkSession, name: str) -> DataFrame:
    """Columns of a table with their type names."""
    if name not in SCHEMAS:
        raise KeyError(f"table not found: {name}")
    columns = [
        (field.name, _type_name(field.name, field.dataType.simpleString()))
        for field in spark.table(name).schema
    ]
    return spark.createDataFrame(columns, "name string, type string")


def _type_name(column: str, kind: str) -> str:
    return "JSON" if column in JSON_COLUMNS else TYPE_NAMES[kind]
