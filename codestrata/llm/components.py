"""Connected components of a link table, as rounds of joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.tables import stored

#: Links that one task joins before the rounds.
LINKS_PER_TASK = 1 << 20


def _joined_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per node of the task's links a link to the least node it reaches through them."""
    parts = list(batches)
    if not parts:
        return
    table = pa.Table.from_batches(parts)
    names = pa.chunked_array([*table.column("a").chunks, *table.column("b").chunks]).combine_chunks()
    coded = names.dictionary_encode()
    # Numbers in order of the names, so the least number is the least name.
    order = pc.sort_indices(coded.dictionary).to_numpy()
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    ends = number[coded.indices.to_numpy()].reshape(2, -1)
    label = np.arange(len(order))
    while True:
        least = np.minimum(label[ends[0]], label[ends[1]])
        new = label.copy()
        np.minimum.at(new, ends[0], least)
        np.minimum.at(new, ends[1], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    sorted_names = coded.dictionary.take(pa.array(order))
    yield pa.RecordBatch.from_arrays(
        [sorted_names.take(pa.array(label)), sorted_names], names=["a", "b"]
    )


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every node in ``links`` (``a, b``); the label is the least node.

    First every task joins the links it holds, which leaves at most one link per task
    and node. Then each round takes the least label among a node and its neighbours, then the
    label of that label, so the number of rounds is logarithmic in the longest
    path. Every round is a table in the shared folder. A node with very many links
    is one key of joins that Spark splits and of sums combined before the shuffle.
    """
    held = stored(links.select("a", "b"), "links")
    tasks = -(-held.count() // LINKS_PER_TASK) or 1
    links = held.coalesce(tasks).mapInArrow(_joined_in_task, "a binary, b binary")
    both = stored(links.select("a", "b").union(links.select("b", "a")).dropDuplicates(), "links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
    labels = stored(labels.withColumn("label", F.least("node", "label")), "labels")
    while True:
        of_neighbours = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        nearest = labels.join(of_neighbours, "node").select(
            "node", F.col("label").alias("before"), F.least("label", "near").alias("label")
        )
        roots = labels.select(F.col("node").alias("label"), F.col("label").alias("root"))
        jumped = nearest.join(roots, "label", "left").select(
            "node", "before", F.least("label", F.coalesce("root", "label")).alias("label")
        )
        rounds = stored(jumped, "labels")
        labels = rounds.select("node", "label")
        if rounds.where("label <> before").isEmpty():
            return labels
