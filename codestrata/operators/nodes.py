"""The node table: one row per syntax-tree node of every distinct blob.

Nodes are numbered in document order (``pre``) and in closing order (``post``),
so tree steps are joins and comparisons: the root has no ``parent_pre``, a
child's ``parent_pre`` is its parent's ``pre``, and ``d`` is below ``a`` when
``d.pre > a.pre and d.post < a.post`` (Grust, "Accelerating XPath Location
Steps", SIGMOD 2002).
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codestrata.dataset import Dataset
from codestrata.functions import trees
from codestrata.functions.language import parser_name
from codestrata.functions.paths import role_of, steps_of
from codestrata.functions.trees import PARSERS, ROOT_TYPES, check_mode
from codestrata.operators.languages import with_language
from codestrata.scratch import materialize, write_table

NODE_COLUMNS = (
    "blob_hash string, lang string, pre int, post int, depth int, parent_pre int, type string, "
    "roles array<string>, attrs map<string,string>, token string, start_line int, end_line int"
)
BLOB_KEY = ["blob_hash", "lang"]

_ROWS_PER_BATCH = 20_000


def parsable_keys(files: DataFrame, contents: DataFrame, languages=None) -> DataFrame:
    """Distinct ``blob_hash, lang`` of files that have a parser, in a table of known size."""
    return materialize(
        with_language(files, contents)
        .select("blob_hash", parser_name(F.col("language")).alias("lang"))
        .where(F.col("lang").isin(*_accepted(languages)))
        .distinct(),
        "keys",
    )


def parsable_blobs(
    ds: Dataset, files: DataFrame, languages: Iterable[str] | None = None
) -> DataFrame:
    """``blob_hash, lang, blob_content`` of the files' distinct blobs that have a parser.

    Copies are gone before content is read, and content is not shuffled for a
    few blobs. Texts are then spread by hash over a fixed number of partitions:
    parsing is the cost here, not bytes, so small partitions must not be merged.
    """
    return (
        ds.contents.select("blob_hash", F.col("blob_content").cast("binary").alias("blob_content"))
        .join(parsable_keys(files, ds.contents, languages), "blob_hash")
        .select(*BLOB_KEY, "blob_content")
        .repartition(int(ds.spark.conf.get("spark.sql.shuffle.partitions")), "blob_hash")
    )


def code_nodes(
    ds: Dataset,
    files: DataFrame | None = None,
    languages: Iterable[str] | None = None,
    mode: str = "semantic",
) -> DataFrame:
    """Nodes of each distinct blob of ``files`` (default: all files), parsed once."""
    return _parsed(ds, files, languages, mode).where("pre >= 0")


def _parsed(
    ds: Dataset, files: DataFrame | None, languages: Iterable[str] | None, mode: str
) -> DataFrame:
    """Nodes, and for a text without a tree one row with ``pre`` -1 and the reason as token."""
    check_mode(mode)
    blobs = parsable_blobs(ds, ds.classified_blobs if files is None else files, languages)
    return blobs.mapInArrow(_node_reader(mode), NODE_COLUMNS)


def stored_nodes(ds: Dataset, languages: Iterable[str] | None = None) -> DataFrame:
    """The semantic node table of all files: written once per snapshot, then scanned.

    ``languages`` (default: all) are those the caller reads: texts of others are not
    parsed. Each language is in a folder of its own, so a filter on ``lang`` prunes the others.
    """
    return _stored(ds, languages).where("pre >= 0")


def texts_without_tree(ds: Dataset) -> DataFrame:
    """``blob_hash, lang, reason`` of the texts in ``stored_nodes`` that gave no tree.

    Every blob with a parser is either there or here.
    """
    return _stored(ds).where("pre < 0").select(*BLOB_KEY, F.col("token").alias("reason"))


def languages_of(query: str) -> list[str]:
    """Languages whose trees a path can enter: its first step may name the type of their root."""
    steps = steps_of(query)
    first = steps[0] if steps else None
    if first is None or first.descendant or first.kind is None:
        return sorted(PARSERS)
    return [language for language in sorted(PARSERS) if first.kind in ROOT_TYPES[language]]


def _stored_name(language: str) -> str:
    return f"code_nodes:{language}"


def _accepted(languages: Iterable[str] | None) -> list[str]:
    """Parsers of the given languages (default: all)."""
    return sorted(PARSERS if languages is None else {name.lower() for name in languages} & set(PARSERS))


def _has_stored(ds: Dataset, languages: Iterable[str] | None) -> bool:
    """Whether the node table has all of the languages."""
    accepted = _accepted(languages)
    return bool(accepted) and all(_stored_name(language) in ds.stored for language in accepted)


def _stored(ds: Dataset, languages: Iterable[str] | None = None) -> DataFrame:
    accepted = _accepted(languages)
    if not accepted:
        return _parsed(ds, None, (), "semantic")
    missing = [language for language in accepted if _stored_name(language) not in ds.stored]
    if missing:
        path = f"{ds.folder}/code_nodes-{uuid.uuid4().hex}"
        nodes = _parsed(ds, None, missing, "semantic")
        if len(missing) == 1:
            write_table(nodes.drop("lang"), f"{path}/lang={missing[0]}")
        else:
            # A task keeps one file open per language, so its nodes need no sort.
            with _setting(ds.spark, "spark.sql.maxConcurrentOutputFileWriters", len(missing)):
                nodes.write.option("compression", "zstd").partitionBy("lang").parquet(path)
        for language in missing:
            stored = ds.spark.read.schema(nodes.schema).parquet(path).select(*nodes.columns)
            ds.stored[_stored_name(language)] = stored.where(F.col("lang") == language)
    return reduce(DataFrame.unionByName, [ds.stored[_stored_name(language)] for language in accepted])


@contextmanager
def _setting(spark: SparkSession, key: str, value: int) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def _node_reader(mode: str):
    parse, rows_per_batch = trees.tree_or_reason, _ROWS_PER_BATCH
    schema = pa.schema(
        [
            ("blob_hash", pa.string()),
            ("lang", pa.string()),
            ("pre", pa.int32()),
            ("post", pa.int32()),
            ("depth", pa.int32()),
            ("parent_pre", pa.int32()),
            ("type", pa.string()),
            ("roles", pa.list_(pa.string())),
            ("attrs", pa.map_(pa.string(), pa.string())),
            ("token", pa.string()),
            ("start_line", pa.int32()),
            ("end_line", pa.int32()),
        ]
    )

    def offsets(parts) -> pa.Array:
        return pa.array([0, *itertools.accumulate(map(len, parts))], pa.int32())

    def batch_of(rows: dict[str, list]) -> pa.RecordBatch:
        roles, attrs = rows["roles"], rows["attrs"]
        pairs = list(itertools.chain.from_iterable(attrs))
        nested = {
            "roles": pa.ListArray.from_arrays(
                offsets(roles), pa.array(itertools.chain.from_iterable(roles), pa.string())
            ),
            "attrs": pa.MapArray.from_arrays(
                offsets(attrs),
                pa.array([name for name, _ in pairs], pa.string()),
                pa.array([value for _, value in pairs], pa.string()),
            ),
        }
        arrays = [nested[f.name] if f.name in nested else pa.array(rows[f.name], f.type) for f in schema]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[str, list] = {name: [] for name in schema.names}
        texts = (text for batch in batches for text in zip(*batch.columns, strict=True))
        for blob_hash, lang, content in texts:
            tree, reason = parse(content.as_py(), lang.as_py(), mode)
            if tree is None:
                none = {"blob_hash": blob_hash.as_py(), "lang": lang.as_py(), "type": "", "token": reason}
                none |= {"pre": -1, "post": -1, "depth": 0, "roles": (), "attrs": ()}
                for name in schema.names:
                    rows[name].append(none.get(name))
            for start in range(0, len(tree) if tree else 0, rows_per_batch):
                end = min(start + rows_per_batch, len(tree))
                rows["blob_hash"] += [blob_hash.as_py()] * (end - start)
                rows["lang"] += [lang.as_py()] * (end - start)
                rows["pre"] += range(start, end)
                for name, values in tree.columns().items():
                    rows[name] += values[start:end]
                if len(rows["pre"]) >= rows_per_batch:
                    yield batch_of(rows)
                    rows = {name: [] for name in schema.names}
        if rows["pre"]:
            yield batch_of(rows)

    return read


def nodes_selected(
    ds: Dataset, files: DataFrame, query: str, languages: Iterable[str] | None = None
) -> DataFrame:
    """Semantic nodes of the files' distinct blobs that ``query`` selects.

    Reads the stored node table if there is one. Otherwise texts are parsed
    once, and nodes that fit a step are written for the joins between steps.
    """
    if _has_stored(ds, languages):
        nodes = stored_nodes(ds, languages).join(
            parsable_keys(files, ds.contents, languages), BLOB_KEY, "left_semi"
        )
        return select_nodes(nodes, query)
    nodes, steps = code_nodes(ds, files, languages), steps_of(query)
    if len(steps) > 1:
        fits_some = reduce(Column.__or__, map(_fits, steps))
        nodes = materialize(nodes.where(fits_some), "nodes")
    return select_nodes(nodes, query)


def select_nodes(nodes: DataFrame, query: str) -> DataFrame:
    """Nodes a path query selects, as filters and joins on the node table."""
    steps = steps_of(query)
    if not steps:
        return nodes.where("parent_pre IS NULL")
    selected = None
    for step in steps:
        candidates = nodes.where(_fits(step))
        if selected is not None:
            below = _descendants if step.descendant else _children
            selected = below(candidates, selected)
        elif step.descendant:
            selected = candidates
        else:
            selected = candidates.where("parent_pre IS NULL")
    return selected


def _fits(step) -> Column:
    condition = F.lit(True) if step.kind is None else F.col("type") == step.kind
    for name, value in step.tests:
        role = role_of(name)
        if role and value is None:
            condition &= F.array_contains("roles", role)
            continue
        actual = F.col("token") if name == "token" else F.try_element_at("attrs", F.lit(name))
        condition &= actual.isNotNull() if value is None else actual == value
    return condition


def _children(candidates: DataFrame, context: DataFrame) -> DataFrame:
    parents = context.select(*BLOB_KEY, F.col("pre").alias("parent_pre"))
    return candidates.join(parents, [*BLOB_KEY, "parent_pre"], "left_semi")


def _descendants(candidates: DataFrame, context: DataFrame) -> DataFrame:
    """Candidates below some context node, in one sorted pass over each text.

    Of the context nodes that open before a candidate, one contains it exactly
    when the last to close does: no pairs are formed.
    """
    closes = candidates.withColumn("_closes", F.lit(None).cast("int")).unionByName(
        context.withColumn("_closes", F.col("post"))
    )
    opened_before = (
        Window.partitionBy(*BLOB_KEY)
        .orderBy("pre")
        .rangeBetween(Window.unboundedPreceding, -1)
    )
    return (
        closes.withColumn("_last", F.max("_closes").over(opened_before))
        .where("_closes IS NULL AND _last > post")
        .drop("_closes", "_last")
    )


def per_file(
    ds: Dataset, files: DataFrame, by_blob: DataFrame, how: str = "inner"
) -> DataFrame:
    """Join results per ``blob_hash, lang`` back to the files they came from."""
    keyed = with_language(files, ds.contents).withColumn("lang", parser_name(F.col("language")))
    return ds.join_by_blob(keyed.drop("language"), by_blob, BLOB_KEY, how)


def node_json() -> Column:
    """One node as a JSON document."""
    return F.to_json(F.struct("type", "roles", "attrs", "token", "start_line", "end_line"))


def nodes_by_blob(nodes: DataFrame) -> DataFrame:
    """``blob_hash, lang, nodes``: JSON array text of each blob's nodes in document order.

    A group holds the selected nodes of one text, never those of its copies.
    """
    entry = F.struct("pre", node_json().alias("node"))
    texts = F.transform(F.sort_array(F.collect_list(entry)), lambda n: n["node"])
    return nodes.groupBy(*BLOB_KEY).agg(
        F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]")).alias("nodes")
    )


def trees_selected(
    ds: Dataset, files: DataFrame, query: str, languages: Iterable[str] | None = None
) -> DataFrame:
    """``blob_hash, lang, pre, tree``: whole subtrees of the nodes that ``query`` selects.

    Like ``nodes_selected``, from the stored node table if there is one; otherwise
    the files' distinct blobs are parsed once and their nodes written.
    """
    if _has_stored(ds, languages):
        keys = parsable_keys(files, ds.contents, languages)
        nodes = stored_nodes(ds, languages).join(keys, BLOB_KEY, "left_semi")
    else:
        nodes = materialize(code_nodes(ds, files, languages), "nodes")
    return subtrees(nodes, select_nodes(nodes, query))


def subtrees(nodes: DataFrame, selected: DataFrame) -> DataFrame:
    """``blob_hash, lang, pre, tree``: each selected node with all below it, as JSON.

    ``nodes`` has every node of the texts. A node's last descendant is number ``post +
    depth`` in document order, so a subtree is an interval of ``pre`` and its JSON is
    written from left to right: each node opens its object, and closes as many as
    the next node is less deep. Selected nodes on one level of nesting do not
    overlap, so one sorted pass per level gives each node the root it is in: no
    pairs of roots and nodes are formed, and a row is made only for nodes inside.
    """
    roots = _nested(selected)
    levels = roots.select(*BLOB_KEY, "_level").distinct()
    root = F.struct("pre", (F.col("post") + F.col("depth")).alias("last"), "depth")
    marks = roots.select(*BLOB_KEY, "_level", "pre", "depth", root.alias("_mark"))
    rows = nodes.join(levels, BLOB_KEY).unionByName(marks, allowMissingColumns=True)
    # A mark comes before the node it marks, with the same depth.
    document = Window.partitionBy(*BLOB_KEY, "_level").orderBy("pre", F.col("_mark").isNull())
    inside = (
        rows.withColumn("_root", F.last("_mark", ignorenulls=True).over(document))
        .withColumn("_next", F.lead("depth").over(document))
        .where("_mark IS NULL AND pre <= _root.last")
    )
    first = (F.col("pre") == F.col("_root.pre")) | (F.col("pre") == F.col("parent_pre") + 1)
    next_depth = F.when(F.col("pre") < F.col("_root.last"), F.col("_next")).otherwise(F.col("_root.depth"))
    part = F.concat(
        F.when(first, F.lit("")).otherwise(F.lit(",")),
        F.expr("left(_head, length(_head) - 1)"),
        F.lit(',"children":['),
        F.repeat(F.lit("]}"), F.col("depth") - next_depth + 1),
    )
    parts = F.sort_array(F.collect_list(F.struct("pre", part.alias("part"))))
    return (
        inside.withColumn("_head", tree_head())
        .groupBy(*BLOB_KEY, F.col("_root.pre").alias("root_pre"))
        .agg(F.array_join(F.transform(parts, lambda n: n["part"]), "").alias("tree"))
        .withColumnRenamed("root_pre", "pre")
    )


def _nested(selected: DataFrame) -> DataFrame:
    """``selected`` with ``_level``: how many of the others each node lies in."""
    opens, closes = F.col("pre") * 2, (F.col("post") + F.col("depth")) * 2 + 1
    edge = F.array(
        F.struct(opens.alias("at"), F.lit(1).alias("step")),
        F.struct(closes.alias("at"), F.lit(-1).alias("step")),
    )
    edges = selected.select(*BLOB_KEY, "pre", "post", "depth", F.explode(edge).alias("_edge"))
    before = Window.partitionBy(*BLOB_KEY).orderBy("_edge.at")
    return edges.withColumn("_level", F.sum("_edge.step").over(before) - 1).where("_edge.step = 1")


def tree_head() -> Column:
    """The node's own part of its JSON in a tree; what it does not have is left out."""
    position = F.struct(F.col("start_line").alias("start"), F.col("end_line").alias("end"))
    return F.to_json(
        F.struct(
            F.col("type").alias("@type"),
            F.when(F.size("roles") > 0, F.col("roles")).alias("@role"),
            F.col("token").alias("@token"),
            F.when(F.col("start_line").isNotNull(), position).alias("@pos"),
            "attrs",
        )
    )


def trees_by_blob(trees_of: DataFrame) -> DataFrame:
    """``blob_hash, lang, nodes``: JSON array text of each blob's subtrees in document order."""
    texts = F.transform(F.sort_array(F.collect_list(F.struct("pre", "tree"))), lambda n: n["tree"])
    return trees_of.groupBy(*BLOB_KEY).agg(
        F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]")).alias("nodes")
    )


def drivers(ds: Dataset) -> DataFrame:
    """Supported languages and the version of their parser."""
    return ds.spark.createDataFrame(sorted(PARSERS.items()), "language string, version string")


def unsupported_languages(ds: Dataset, files: DataFrame | None = None) -> DataFrame:
    """Languages found that have no parser, with their file counts."""
    files = ds.classified_files if files is None else files
    return (
        with_language(files, ds.contents)
        .select(parser_name(F.col("language")).alias("language"))
        .groupBy("language")
        .agg(F.count("*").alias("num_files"))
        .where(F.col("language").isNotNull())
        .join(drivers(ds), "language", "left_anti")
    )


def check_supported(language: str) -> str:
    """Parser name for a language; the error lists the supported ones."""
    if language.lower() not in PARSERS:
        raise ValueError(f"no parser for {language}; there are {', '.join(sorted(PARSERS))}")
    return language.lower()
