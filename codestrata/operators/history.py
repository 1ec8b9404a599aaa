"""All commits reachable from every ref, with their distance from its tip.

A commit graph is far deeper than it is wide, so walking it level by level
would take as many rounds as there are commits. Instead it is cut into lanes:
runs of commits along first parents. Positions in a lane are consecutive, so
whoever enters a lane reaches everything below, and a round is only needed
each time a path changes lane.

What a ref reaches is kept as entries into lanes, never as commits: an entry
with key ``distance + pos`` gives a commit at ``p``, at or below it, the
distance ``key - p``. Rounds look at entries and at the edges between lanes
only, and add entries to those found before. At the end the entries become
intervals of positions, once, and these are joined with the commits.

Lanes come from pointer doubling, which moves every commit in every round. A
large history is therefore contracted first: commits with one child, on stretches
without branches, are left out until few are left, and get their place from the
child again afterwards. Each round leaves out a quarter of those that are left, so
all rounds together move a few rows per commit, however deep the history is.

``history_index`` is the least number of parent steps from the tip.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codestrata.operators.joins import hot_keys, split_join
from codestrata.scratch import materialize

# Lane positions per join group: bounds every group, however long the lane.
SLICE = 1024

# Intervals that meet one slice of a lane in one join group.
INTERVALS_PER_GROUP = 1000

# Commits that may be left out are brought down to this number before the doubling.
DOUBLED = 1 << 18

# Tables of entries read together before they are written as one.
_TABLES = 16

_LANE = ["ref", "lane"]
_SLICE = [*_LANE, "slice"]


def walk_history(commits: DataFrame, refs: DataFrame, slice_size: int = SLICE) -> DataFrame:
    """``ref_commits`` of the given commits and refs.

    Commits and refs get numbers first: the rounds then move a few longs per
    row instead of names and hashes.
    """
    nodes = materialize(
        commits.select("repository_id", "commit_hash", "commit_parents").withColumn(
            "node", F.monotonically_increasing_id()
        ),
        "nodes",
    )
    tips = materialize(
        refs.join(nodes, ["repository_id", "commit_hash"])
        .select("ref_name", F.col("node").alias("tip"))
        .withColumn("ref", F.monotonically_increasing_id()),
        "tips",
    )
    edges = materialize(parent_edges(nodes), "edges")
    lanes = materialize(_with_starts(_with_lanes(nodes, edges)), "lanes")
    # A commit whose row comes more than once has several first parents, and lanes are no lines.
    if lanes.count() == nodes.count():
        edges = _leaving(edges, lanes)
    intervals = materialize(reach_intervals(tips, lanes, edges, slice_size), "intervals")
    hot = materialize(hot_keys(intervals, ["lane", "slice"], INTERVALS_PER_GROUP), "hot")
    named = intervals.join(tips.select("ref", "ref_name"), "ref")
    placed = lanes.join(nodes, "node").select(
        "lane", _slice_of("pos", slice_size), "pos", "repository_id", "commit_hash"
    )
    return (
        split_join(named, placed, ["lane", "slice"], ["ref", "low"], hot)
        .where("pos BETWEEN low AND high")
        .select(
            "repository_id",
            "commit_hash",
            "ref_name",
            (F.col("key") - F.col("pos")).alias("history_index"),
        )
    )


def reach_intervals(
    tips: DataFrame, lanes: DataFrame, edges: DataFrame, slice_size: int = SLICE
) -> DataFrame:
    """``ref, lane, slice, low, high, key``: what every ref reaches.

    A commit at ``pos`` between ``low`` and ``high`` of the lane is ``key - pos``
    parent steps from the ref's tip. An interval lies in one slice of the lane,
    and no two intervals of a ref overlap.
    """
    crossings = materialize(_crossings(edges, lanes), "crossings")
    found = [
        materialize(
            tips.join(lanes, F.col("tip") == F.col("node")).select(
                *_LANE, "start", "pos", F.col("pos").alias("key"), F.lit(False).alias("entered")
            ),
            "round",
        )
    ]
    entries = [found[0].limit(0)]
    while not (candidates := found[-1].where("NOT entered")).isEmpty():
        found.append(materialize(_round(candidates, entries, crossings, slice_size), "round"))
        entries.append(found[-1].where("entered"))
        if len(entries) > _TABLES:
            entries = [materialize(_union(entries), "entries")]
    return _intervals(_union(entries), slice_size)


def parent_edges(nodes: DataFrame) -> DataFrame:
    """``node, nth, parent`` from the JSON list of parents; unknown parents are left out."""
    parents = F.from_json("commit_parents", "array<string>")
    listed = nodes.select(
        "repository_id", "node", F.posexplode(parents).alias("nth", "commit_hash")
    )
    known = nodes.select("repository_id", "commit_hash", F.col("node").alias("parent"))
    return listed.join(known, ["repository_id", "commit_hash"]).select("node", "nth", "parent")


def _with_lanes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lane and position of each commit.

    First parents form a forest. A commit's lane is named by the deepest commit
    that descends from it there, its position is its depth below the root.
    """
    first = edges.where("nth = 0").select("node", F.col("parent").alias("up"))
    if edges.count() <= DOUBLED:
        return _doubled(
            nodes.select("node").join(first, "node", "left").withColumn("step", _step("up"))
        )
    forest = materialize(_forest(nodes, first), "forest")
    if forest.count() > nodes.count():
        forest = materialize(_without_repeated(forest), "forest")
    rounds = [forest.where("up IS NOT NULL").withColumn("step", _step("up"))]
    while _worth_contracting(rounds[-1]):
        rounds.append(materialize(_contracted(rounds[-1], len(rounds)), "contraction"))
    roots = forest.where("up IS NULL").select("node", "up", F.lit(0).cast("bigint").alias("step"))
    placed = [materialize(_doubled(roots.unionByName(rounds[-1].select("node", "up", "step"))), "placed")]
    for left_out in reversed(rounds[1:]):
        # A commit lies in the lane of its only child, below it.
        below = left_out.where("passed IS NOT NULL").join(_union(placed), "node")
        placed.append(
            materialize(
                below.select(
                    F.col("passed").alias("node"), (F.col("pos") - F.col("passed_step")).alias("pos"), "lane"
                ),
                "placed",
            )
        )
    return _union(placed)


def _step(up: str):
    return F.col(up).isNotNull().cast("bigint")


def _forest(nodes: DataFrame, first: DataFrame) -> DataFrame:
    """``node, up, free``: a free commit has a first parent and one child, so it can be left out."""
    children = first.groupBy(F.col("up").alias("node")).agg(F.count("*").alias("children"))
    return (
        nodes.select("node")
        .join(first, "node", "left")
        .join(children, "node", "left")
        .select("node", "up", F.expr("up IS NOT NULL AND coalesce(children, 0) = 1").alias("free"))
    )


def _without_repeated(forest: DataFrame) -> DataFrame:
    """Commits with several rows of first parents, and those parents, are not free."""
    several = forest.groupBy("node").count().where("count > 1").select("node")
    parents = forest.join(several, "node", "left_semi").select(F.col("up").alias("node"))
    bound = several.unionByName(parents).distinct().withColumn("bound", F.lit(True))
    return forest.join(bound, "node", "left").select("node", "up", F.expr("free AND bound IS NULL").alias("free"))


def _worth_contracting(left: DataFrame) -> bool:
    free = left.where("free").count()
    return free > DOUBLED and 2 * free > left.count()


def _contracted(left: DataFrame, salt: int) -> DataFrame:
    """``node, up, step, free, passed, passed_step`` without a quarter of the free commits.

    Every commit tosses a coin. A free one with heads whose parent has tails is left
    out, so never two neighbours at once. Its child has it as ``passed``,
    ``passed_step`` parent steps away, and goes on to its parent.
    """

    def heads(column: str):
        return F.xxhash64(column, F.lit(salt)).bitwiseAND(F.lit(1).cast("bigint")) == 1

    out = F.col("free") & heads("node") & ~heads("up")
    columns = ["node", "up", "step", "free"]
    leaving = left.where(out).select(
        F.col("node").alias("passed"), F.col("up").alias("next_up"), F.col("step").alias("next_step")
    )
    staying = left.where(~out).select(*columns)
    moved = (
        staying.where(heads("up"))
        .join(leaving, F.col("up") == F.col("passed"), "left")
        .select(
            "node",
            F.coalesce("next_up", "up").alias("up"),
            (F.col("step") + F.coalesce("next_step", F.lit(0))).alias("step"),
            "free",
            "passed",
            F.when(F.col("passed").isNotNull(), F.col("step")).alias("passed_step"),
        )
    )
    nothing = F.lit(None).cast("bigint")
    return moved.unionByName(
        staying.where(~heads("up")).withColumns({"passed": nothing, "passed_step": nothing})
    )


def _doubled(forest: DataFrame) -> DataFrame:
    """``node, pos, lane`` from ``node, up`` and the parent ``step``s between them.

    Doubling: after round k each node knows its ancestor 2^k edges up and what lies
    less than 2^k edges below it.
    """
    doubled = materialize(
        forest.select(
            "node",
            "up",
            F.col("step").alias("pos"),
            F.struct(
                F.lit(0).cast("bigint").alias("height"), F.col("node").alias("leaf")
            ).alias("deepest"),
        ),
        "doubling",
    )
    while not doubled.where("up IS NOT NULL").isEmpty():
        above = doubled.select(
            F.col("node").alias("above"), F.col("up").alias("next_up"), F.col("pos").alias("pos_above")
        )
        # Roots look for nodes that do not exist, each for another: nulls would meet in one task.
        up = F.coalesce("up", -1 - F.col("node"))
        below = (
            doubled.where("up IS NOT NULL")
            .groupBy(F.col("up").alias("node"))
            .agg(
                F.max(
                    F.struct(
                        (F.col("deepest.height") + F.col("pos")).alias("height"),
                        F.col("deepest.leaf").alias("leaf"),
                    )
                ).alias("deepest_below")
            )
        )
        doubled = materialize(
            doubled.join(above, up == F.col("above"), "left")
            .join(below, "node", "left")
            .select(
                "node",
                F.col("next_up").alias("up"),
                (F.col("pos") + F.coalesce("pos_above", F.lit(0))).alias("pos"),
                F.greatest("deepest", F.coalesce("deepest_below", "deepest")).alias("deepest"),
            ),
            "doubling",
        )
    return doubled.select("node", "pos", F.col("deepest.leaf").alias("lane"))


def _with_starts(lanes: DataFrame) -> DataFrame:
    """Add ``start``, the lowest position of the lane."""
    return lanes.join(lanes.groupBy("lane").agg(F.min("pos").alias("start")), "lane")


def _leaving(edges: DataFrame, lanes: DataFrame) -> DataFrame:
    """The edges that can leave a lane: first parents only do so at its lowest commit."""
    lowest = materialize(lanes.where("pos = start").select("node"), "lowest")
    first = edges.where("nth = 0").join(lowest, "node", "left_semi")
    # Written first, so the planner knows how few there are.
    return materialize(edges.where("nth > 0").unionByName(first.select(*edges.columns)), "leaving")


def _crossings(edges: DataFrame, lanes: DataFrame) -> DataFrame:
    """Parent edges that leave ``lane`` at ``pos``, and where they lead to."""
    child = lanes.select("node", "lane", "pos")
    parent = lanes.select(
        F.col("node").alias("parent"),
        F.col("lane").alias("to_lane"),
        F.col("start").alias("to_start"),
        F.col("pos").alias("to_pos"),
    )
    leaving = materialize(edges.join(child, "node"), "leaving")
    return (
        leaving.join(parent, "parent")
        .where("nth > 0 OR to_lane <> lane")
        .select("lane", "pos", "to_lane", "to_start", "to_pos")
    )


def _round(
    candidates: DataFrame, entries: list[DataFrame], crossings: DataFrame, slice_size: int
) -> DataFrame:
    """Candidates that lower a label, as ``entered``, and the candidates they lead to.

    A crossing is followed where its commit got a lower label than all entries of
    the rounds before gave it.
    """
    touched = candidates.groupBy(*_LANE).agg(F.max("pos").alias("top"))
    nothing = F.lit(None).cast("bigint")
    leading = (
        crossings.join(touched, "lane")
        .where("pos <= top")
        .select(
            *_LANE, "pos", nothing.alias("old"), nothing.alias("new"), "to_lane", "to_start", "to_pos"
        )
    )
    same_lane = [F.col("lane").alias("to_lane"), F.col("start").alias("to_start"), nothing.alias("to_pos")]
    new = candidates.select(*_LANE, "pos", nothing.alias("old"), F.col("key").alias("new"), *same_lane)
    old = (
        _union(entries)
        .join(touched.select(*_LANE), _LANE, "left_semi")
        .select(*_LANE, "pos", F.col("key").alias("old"), nothing.alias("new"), *same_lane)
    )
    rows = _union([leading, new, old]).withColumn("slice", _slice_of("pos", slice_size))
    per_slice = rows.groupBy(*_SLICE).agg(F.min("old").alias("old_above"), F.min("new").alias("new_above"))
    higher = _downwards("slice", *_LANE).rowsBetween(Window.unboundedPreceding, -1)
    carried = per_slice.select(
        *_SLICE, F.min("old_above").over(higher).alias("old_above"), F.min("new_above").over(higher).alias("new_above")
    )
    own = _downwards("pos", *_SLICE).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    lowest = rows.join(carried, _SLICE).select(
        *rows.columns,
        F.least(F.min("old").over(own), "old_above").alias("old_key"),
        F.least(F.min("new").over(own), "new_above").alias("new_key"),
    )
    lowered = lowest.where("new_key < old_key OR (new_key IS NOT NULL AND old_key IS NULL)")
    entered = F.col("to_pos").isNull()
    return (
        lowered.where("to_pos IS NOT NULL OR new = new_key")
        .select(
            "ref",
            F.col("to_lane").alias("lane"),
            F.col("to_start").alias("start"),
            F.when(entered, F.col("pos")).otherwise(F.col("to_pos")).alias("pos"),
            F.when(entered, F.col("new"))
            .otherwise(F.col("new_key") - F.col("pos") + 1 + F.col("to_pos"))
            .alias("key"),
            entered.alias("entered"),
        )
        .groupBy(*_LANE, "start", "pos", "entered")
        .agg(F.min("key").alias("key"))
    )


def _intervals(entries: DataFrame, slice_size: int) -> DataFrame:
    """The least key of all entries at or above, as intervals of positions.

    Every slice from the highest entry down to the lane's start begins with what
    higher slices carry down to it.
    """
    rows = entries.select(*_LANE, "start", "pos", "key", _slice_of("pos", slice_size))
    per_slice = rows.groupBy(*_SLICE).agg(F.min("key").alias("slice_key"))
    higher = _downwards("slice", *_LANE).rowsBetween(Window.unboundedPreceding, -1)
    size = F.lit(slice_size).cast("bigint")
    borders = (
        rows.groupBy(*_LANE)
        .agg(F.min("start").alias("start"), F.max("slice").alias("top"))
        .select(
            *_LANE,
            "start",
            F.explode(F.sequence(F.floor(F.col("start") / size), "top")).alias("slice"),
        )
        .join(per_slice, _SLICE, "left")
        .select(
            *_LANE,
            "start",
            ((F.col("slice") + 1) * size - 1).alias("pos"),
            F.min("slice_key").over(higher).alias("key"),
            "slice",
        )
        .where("key IS NOT NULL")
    )
    downwards = _downwards("pos", *_SLICE)
    above = downwards.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bottom = F.greatest("start", F.col("slice") * size)
    return (
        rows.unionByName(borders)
        .select(
            *_SLICE,
            F.coalesce(F.lead("pos").over(downwards) + 1, bottom).alias("low"),
            F.col("pos").alias("high"),
            F.min("key").over(above).alias("key"),
        )
        .where("low <= high")
    )


def _downwards(position: str, *groups: str):
    return Window.partitionBy(*groups).orderBy(F.desc(position))


def _slice_of(position: str, slice_size: int):
    return F.floor(F.col(position) / slice_size).alias("slice")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
