"""Merkle tree over a dataset with a proof per row, by slot pivots.

A row's leaf is the digest of its columns. Leaves of a group (source) stand in the
order of their ids; a node at place ``p`` has parent ``p div fanout`` and slot ``p
mod fanout``. One aggregation per level spreads the children of each parent into
``fanout`` columns (one conditional aggregate per slot); the columns one after the
other hash to the parent. The tops of all groups, in order of the group, are the
leaves of a last tree in the same way.

The way back: a parent's row holds all its children, so for the child in slot ``i``
the columns before and after it are its siblings, without its own. They go in
front of the parent's own way to the root. The columns of a parent of leaves are
read once more to hash each proof and to fold a leaf up again.

A group with one node left is a parent row at place 0 with slot 0 alone; its node
goes up unchanged and without siblings, so trees of any heights rise together.

Nothing is brought together by group: places come from range-partitioned chunks,
and every other shuffle is on (group, parent), which has at most ``fanout`` rows.
Text does not leave the task that reads it; a leaf travels as digests. A way to
the root has ``levels * (fanout - 1)`` digests and travels once per parent of
leaves. Written levels cut the lineage.

Defined results: null and empty values differ in a leaf (``-`` and ``0:``); a null
group is a group of its own, the first. Null ids come first; equal ids stand in the
order of their leaves, and equal rows each keep their place and proof. A lone leaf
is its group's top; a lone group's top is the root; a proof without siblings hashes
no input. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm.tables import stored
from codestrata.operators.ordering import with_position

FANOUT = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

_GROUP = ["_known", "_group"]  # a null group is (false, '')
_WAY = "array<struct<before:string,after:string>>"


def field(value: Column) -> Column:
    """``-`` for null, else the bytes of the value as text, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: Sequence[Column]) -> Column:
    """Digest of a row's columns, as lowercase hexadecimal text."""
    return F.sha2(F.concat(*map(field, columns)), 256)


def _slots(fanout: int) -> list[Column]:
    return [F.col(f"slot_{i}") for i in range(fanout)]


def _joined(slots: Sequence[Column]) -> Column:
    """Digests one after the other; empty slots add nothing."""
    return F.concat(*[F.coalesce(slot, F.lit("")) for slot in slots])


def parents_of(nodes: DataFrame, group: Sequence[str], fanout: int, digest: str | None = None) -> DataFrame:
    """``group, place, slot_0 ..., alone, node`` per parent of ``nodes`` (``group, place, node``).

    ``node`` of the input may be a struct; its field ``digest`` is then hashed.
    ``alone`` tells the one node of its group, which goes up as it is.
    """
    slot = F.pmod(F.col("place"), F.lit(fanout))
    pivot = [F.max(F.when(slot == i, F.col("node"))).alias(f"slot_{i}") for i in range(fanout)]
    up = F.expr(f"place div {fanout}").alias("place")
    rows = nodes.groupBy(*group, up).agg(*pivot, F.count("*").alias("_children"))
    slots = [slot if digest is None else slot[digest] for slot in _slots(fanout)]
    alone = (F.col("place") == 0) & (F.col("_children") == 1)
    whole = F.sha2(_joined(slots), 256)
    return rows.select(
        *group,
        "place",
        *_slots(fanout),
        alone.alias("alone"),
        F.when(alone, slots[0]).otherwise(whole).alias("node"),
    )


def _rise(
    nodes: DataFrame, group: Sequence[str], fanout: int, label: str, digest: str | None = None
) -> list[DataFrame]:
    """Levels above ``nodes`` until every group has one node; the last has only place 0."""
    levels = []
    while True:
        level = stored(parents_of(nodes, group, fanout, digest), f"merkle-{label}")
        levels.append(level)
        if not (level.agg(F.max("place")).first()[0] or 0):
            return levels
        nodes, digest = level.select(*group, "place", "node"), None


def _children(level: DataFrame, group: Sequence[str], fanout: int, digest: str | None) -> DataFrame:
    """A row per child of ``level``'s parents: ``group, place, node, root, way``.

    ``way`` of the input is the parent's; the child's begins with its own siblings.
    """
    slots = [slot if digest is None else slot[digest] for slot in _slots(fanout)]
    child = F.col("_slot")
    rows = level.withColumn("_slot", F.explode(F.array(*map(F.lit, range(fanout)))))
    siblings = F.struct(
        _joined([F.when(child > i, slot) for i, slot in enumerate(slots)]).alias("before"),
        _joined([F.when(child < i, slot) for i, slot in enumerate(slots)]).alias("after"),
    )
    own = F.coalesce(*[F.when(child == i, slot) for i, slot in enumerate(_slots(fanout))])
    way = F.when(F.col("alone"), F.col("way")).otherwise(F.concat(F.array(siblings), "way"))
    carried = [name for name in ("subroot", "root") if name in level.columns]
    return rows.select(
        *group,
        (F.col("place") * fanout + child).alias("place"),
        own.alias("node"),
        *carried,
        way.alias("way"),
    ).where("node IS NOT NULL")


def _descend(levels: list[DataFrame], ways: DataFrame, group: Sequence[str], fanout: int) -> DataFrame:
    """The lowest of ``levels`` with the way of each of its nodes.

    ``ways`` (``group, place, way`` and what is carried) belongs to the highest.
    """
    for level in reversed(levels[1:]):
        here = level.join(ways, [*group, "place"])
        ways = stored(_children(here, group, fanout, None).drop("node"), "merkle-ways")
    return levels[0].join(ways, [*group, "place"])


def folded(way: Column, start: Column) -> Column:
    """The root that ``start`` gives with the siblings of ``way``."""
    return F.aggregate(
        way, start, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256)
    )


def proof_digest(way: Column) -> Column:
    """Digest of all siblings of ``way``, level by level, left to right."""
    every = F.transform(way, lambda step: F.concat(step["before"], step["after"]))
    return F.sha2(F.array_join(every, ""), 256)


def manifest(
    docs: DataFrame,
    columns: Sequence[str] = COLUMNS,
    id_column: str = "doc_id",
    group_column: str = "source",
    tampered: dict[str, Column] | None = None,
    fanout: int = FANOUT,
) -> DataFrame:
    """A row per row of ``docs``: ``id, leaf, subroot, root, way, proof_sha256, folded_root, verified``.

    ``tampered`` maps columns to what a verifier finds in their place; leaves,
    roots and proofs are those of ``docs`` as it is, and ``folded_root`` is what
    the found row leads to. ``way`` holds the siblings ``before`` and ``after`` the
    row's node, from its leaf up to the root.
    """
    values = {name: F.col(name) for name in columns}
    found = leaf([(tampered or {}).get(name, value) for name, value in values.items()])
    own = leaf(list(values.values()))
    rows = docs.select(
        F.col(group_column).isNotNull().alias("_known"),
        F.coalesce(F.col(group_column).cast("string"), F.lit("")).alias("_group"),
        F.col(id_column).alias("id"),
        own.alias("leaf"),
        (found if tampered else F.lit(None).cast("string")).alias("found"),
    )
    # A leaf that verifies needs no second digest. Equal rows differ by ``_row``, so
    # however many there are, range partitioning can tell them apart.
    rows = rows.withColumn("found", F.expr("nullif(found, leaf)"))
    rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "merkle-leaves")
    placed = with_position(rows, _GROUP, ["id", "leaf", "_row"], "_position")
    leaves = placed.select(
        *_GROUP, (F.col("_position") - 1).alias("place"), F.struct("leaf", "id", "found").alias("node")
    )
    levels = _rise(leaves, _GROUP, fanout, "level", "leaf")
    tops = with_position(
        levels[-1].select(F.lit(0).alias("_all"), *_GROUP, F.col("node")), ["_all"], _GROUP, "_position"
    )
    tops = stored(tops.withColumn("place", F.col("_position") - 1), "merkle-tops")
    above = _rise(tops.select("_all", "place", "node"), ["_all"], fanout, "top")
    root = above[-1].select("_all", "place", F.col("node").alias("root"))
    ways = _descend(above, root.withColumn("way", F.array().cast(_WAY)), ["_all"], fanout)
    ways = _children(ways, ["_all"], fanout, None).withColumnRenamed("node", "subroot")
    ways = tops.select(*_GROUP, "_all", "place").join(ways, ["_all", "place"]).select(
        *_GROUP, F.lit(0).cast("bigint").alias("place"), "subroot", "root", "way"
    )
    ways = _descend(levels, stored(ways, "merkle-tops"), _GROUP, fanout)
    rows = _children(ways, _GROUP, fanout, "leaf")
    leads_to = folded(F.col("way"), F.coalesce("node.found", "node.leaf"))
    return rows.select(
        F.col("node.id").alias(id_column),
        F.col("node.leaf").alias("leaf"),
        "subroot",
        "root",
        "way",
        proof_digest(F.col("way")).alias("proof_sha256"),
        leads_to.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def manifest_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: a verifier finds the text of one document in five in lower case."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    chosen = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    text = F.when(chosen, lower_ascii(F.col("text"))).otherwise(F.col("text"))
    return manifest(docs, tampered={"text": text}).drop("way")


#: Levels that the SQL unrolls: 16**5 rows of a source, 16**3 sources.
_SQL_LEVELS = 5
_SQL_TOP_LEVELS = 3


def _rise_sql(name: str, group: str, levels: int) -> str:
    """Tables ``{name}1 ...`` of nodes and ``{name}_run0 ...`` of their siblings."""
    steps = []
    for k in range(levels):
        run = f"(PARTITION BY {group}, place // 16 ORDER BY place ROWS BETWEEN"
        steps.append(f"""
{name}_run{k} AS (
  SELECT {group}, place,
         place < 16 AND count(*) OVER (PARTITION BY {group}, place // 16) = 1 AS alone,
         coalesce(string_agg(node, '') OVER {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
         coalesce(string_agg(node, '') OVER {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM {name}{k}
), {name}{k + 1} AS (
  SELECT {group}, place // 16 AS place,
         CASE WHEN place // 16 = 0 AND count(*) = 1 THEN min(node)
              ELSE sha256(string_agg(node, '' ORDER BY place)) END AS node
  FROM {name}{k} GROUP BY {group}, place // 16
)""")
    return ",".join(steps)


def _climb_sql(start: str, name: str, group: str, place: str, levels: int) -> str:
    """Tables ``{name}_way1 ...``: ``start`` with ``proof`` and ``digest`` taken up level by level."""
    steps, rows = [], start
    for k in range(levels):
        steps.append(f"""
{name}_way{k} AS (
  SELECT w.* REPLACE (
           CASE WHEN r.alone THEN w.proof ELSE w.proof || r.before || r.after END AS proof,
           CASE WHEN r.alone THEN w.digest ELSE sha256(r.before || w.digest || r.after) END AS digest)
  FROM {rows} w JOIN {name}_run{k} r
    ON w.{group} IS NOT DISTINCT FROM r.{group} AND w.{place} // {16**k} = r.place
)""")
        rows = f"{name}_way{k}"
    return ",".join(steps)


def _field_sql(value: str) -> str:
    text = f"CAST({value} AS VARCHAR)"
    return f"coalesce(CAST(octet_length(encode({text})) AS VARCHAR) || ':' || {text}, '-')"


def _leaf_sql(text: str) -> str:
    return f"sha256({' || '.join(map(_field_sql, ['doc_id', 'source', 'lang', 'n_chars', text]))})"


_CRC_SQL = """xor(4294967295, list_reduce(
  list_prepend(CAST(4294967295 AS BIGINT), [CAST(ascii(c) AS BIGINT) FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]),
  lambda crc, byte: xor(crc >> 8, list_reduce([xor(crc, byte) & 255, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda bits, step: CASE WHEN bits & 1 = 1 THEN xor(bits >> 1, 3988292384) ELSE bits >> 1 END))))"""

ORACLE_SQL = f"""
WITH leaves AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place,
         {_leaf_sql("text")} AS leaf,
         CASE WHEN {_CRC_SQL} % 5 = 0
              THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}
              ELSE {_leaf_sql("text")} END AS found
  FROM documents
), level0 AS (
  SELECT source, place, leaf AS node FROM leaves
),{_rise_sql("level", "source", _SQL_LEVELS)}, tops AS (
  SELECT source, node AS subroot, 0 AS whole,
         row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS top_place FROM level{_SQL_LEVELS}
), top0 AS (
  SELECT whole, top_place AS place, subroot AS node FROM tops
),{_rise_sql("top", "whole", _SQL_TOP_LEVELS)}, starts AS (
  SELECT l.doc_id, l.source, l.place, l.leaf, t.whole, t.top_place, t.subroot, '' AS proof, l.found AS digest
  FROM leaves l JOIN tops t ON l.source IS NOT DISTINCT FROM t.source
),{_climb_sql("starts", "level", "source", "place", _SQL_LEVELS)},
{_climb_sql(f"level_way{_SQL_LEVELS - 1}", "top", "whole", "top_place", _SQL_TOP_LEVELS)}
SELECT doc_id, leaf, subroot, node AS root, sha256(proof) AS proof_sha256, digest AS folded_root,
       digest = node AS verified
FROM top_way{_SQL_TOP_LEVELS - 1} w JOIN top{_SQL_TOP_LEVELS} r ON w.whole = r.whole
"""
