"""The language of every file, without reading content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.functions.language import language_of_path, language_of_signs, shared_extension
from codestrata.scratch import materialize


def with_language(files: DataFrame, contents: DataFrame) -> DataFrame:
    """``files`` with their ``language`` (display case, NULL when unknown).

    Snapshots store it, so this only adds it to file lists that lack it. Files
    whose path says nothing are joined with the language stored next to each
    blob. Only files whose extension several languages share need content: their
    hashes are written first, so that no other content is shuffled.
    """
    if "language" in files.columns:
        return files
    named = files.withColumn("language", language_of_path()).withColumn(
        "extension", shared_extension()
    )
    by_content = contents.select("blob_hash", F.col("content_language").alias("language"))
    unnamed = named.where("language IS NULL AND extension IS NULL").drop("language", "extension")
    classified = (
        named.where("language IS NOT NULL AND extension IS NULL")
        .drop("extension")
        .unionByName(unnamed.join(by_content, "blob_hash", "left"))
    )
    shared = named.where("extension IS NOT NULL")
    key = ["blob_hash", "extension"]
    wanted = materialize(shared.select(*key).distinct(), "shared")
    if wanted.isEmpty():
        return classified
    decided = wanted.join(contents.select("blob_hash", "blob_content"), "blob_hash").select(
        *key, language_of_signs("extension").alias("decided")
    )
    # Without content, for a lost object, the path has to do.
    by_signs = shared.join(decided, key, "left").withColumn(
        "language", F.coalesce("decided", "language")
    )
    return classified.unionByName(by_signs.drop("decided", "extension"))
