import json
import random

import pytest

from codestrata.operators import history
from codestrata.operators.history import walk_history

COMMITS = "repository_id string, commit_hash string, commit_parents string"
REFS = "repository_id string, ref_name string, commit_hash string"


def breadth_first(parents, tip):
    distance, queue = {tip: 0}, [tip]
    for commit in queue:
        for parent in parents[commit]:
            if parent in parents and parent not in distance:
                distance[parent] = distance[commit] + 1
                queue.append(parent)
    return distance


def check(spark, graphs, tips, slice_size):
    commits = [(r, c, json.dumps(p)) for r, graph in graphs.items() for c, p in graph.items()]
    refs = [(r, name, commit) for r, name, commit in tips]
    got = walk_history(
        spark.createDataFrame(commits, COMMITS), spark.createDataFrame(refs, REFS), slice_size
    )
    expected = {
        (r, c, name, d)
        for r, name, tip in tips
        for c, d in breadth_first(graphs[r], tip).items()
    }
    rows = [tuple(row) for row in got.collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == expected


def random_graph(rng, size):
    """Branches, merges, octopus merges and several roots, with shuffled names."""
    names = rng.sample(range(10_000), size)
    graph = {}
    for i in range(size):
        count = 0 if i == 0 or rng.random() < 0.03 else rng.choice([1, 1, 1, 2, 3])
        nearby = {max(0, i - 1 - int(rng.expovariate(0.3))) for _ in range(count)}
        graph[str(names[i])] = [str(names[j]) for j in rng.sample(sorted(nearby), len(nearby))]
    return graph


@pytest.mark.parametrize("seed, slice_size", [(1, 4), (2, 1024)])
def test_random_graphs(spark, seed, slice_size):
    rng = random.Random(seed)
    graphs = {f"r{i}": random_graph(rng, 60) for i in range(4)}
    tips = [
        (r, name, rng.choice(list(graph)))
        for r, graph in graphs.items()
        for name in ("HEAD", "refs/heads/a", "refs/tags/b")
    ]
    check(spark, graphs, tips, slice_size)


def test_long_history_and_missing_parents(spark):
    line = {f"c{i}": [f"c{i - 1}"] if i else [] for i in range(3000)}
    shallow = {"x1": ["gone"], "x2": ["x1", "gone-too"]}
    tips = [("line", "HEAD", "c2999"), ("line", "old", "c10"), ("shallow", "HEAD", "x2")]
    check(spark, {"line": line, "shallow": shallow}, tips, 256)


def test_no_refs(spark):
    commits = spark.createDataFrame([("r", "c", "[]")], COMMITS)
    walked = walk_history(commits, spark.createDataFrame([], REFS))
    assert walked.count() == 0
    assert walked.columns == ["repository_id", "commit_hash", "ref_name", "history_index"]


def test_storage_is_by_intervals(spark, monkeypatch):
    """A round writes entries into lanes, however many commits lie below them."""
    written = []
    materialize = history.materialize

    def noted(df, label):
        table = materialize(df, label)
        written.append((label, table))
        return table

    monkeypatch.setattr(history, "materialize", noted)
    graph = {f"m{i}": [f"m{i - 1}"] if i else [] for i in range(2000)}
    for i in range(100, 1900, 400):
        graph[f"s{i}"] = [f"m{i - 50}"]
        graph[f"m{i}"] = [f"m{i - 1}", f"s{i}"]
    tips = [("r", "HEAD", "m1999"), ("r", "side", "s1700"), ("r", "old", "m5")]
    check(spark, {"r": graph}, tips, 512)
    rounds = [table.count() for label, table in written if label == "round"]
    crossings = next(table.count() for label, table in written if label == "crossings")
    assert crossings == 10
    # One entry kept and one led to, per ref and place that a crossing leads to.
    assert max(rounds) <= 2 * len(tips) * (crossings + 1)
    (intervals,) = [table for label, table in written if label == "intervals"]
    assert intervals.count() <= len(tips) * (2000 // 512 + 1) + sum(rounds)
    reached = sum(len(breadth_first(graph, tip)) for _, _, tip in tips)
    assert sum(row.high - row.low + 1 for row in intervals.collect()) == reached


def test_many_refs_of_one_slice(spark, monkeypatch):
    monkeypatch.setattr(history, "INTERVALS_PER_GROUP", 5)
    monkeypatch.setattr(history, "_TABLES", 2)
    graph = random_graph(random.Random(3), 40)
    tips = [("r", f"ref{i}", commit) for i, commit in enumerate(graph)]
    check(spark, {"r": graph}, tips, 16)


def test_contracted_graphs(spark, monkeypatch):
    """What is left out before the doubling gets the lane and position it would have had."""
    rng = random.Random(4)
    graphs = {f"r{i}": random_graph(rng, 50) for i in range(3)}
    graphs["line"] = {f"c{i}": [f"c{i - 1}"] if i else [] for i in range(100)}
    commits = [(r, c, json.dumps(p)) for r, graph in graphs.items() for c, p in graph.items()]
    nodes = history.materialize(
        spark.createDataFrame(commits, COMMITS).withColumn("node", history.F.monotonically_increasing_id()),
        "nodes",
    )
    edges = history.materialize(history.parent_edges(nodes), "edges")
    doubled = sorted(map(tuple, history._with_lanes(nodes, edges).collect()))
    monkeypatch.setattr(history, "DOUBLED", 20)
    assert sorted(map(tuple, history._with_lanes(nodes, edges).collect())) == doubled
    tips = [(r, "HEAD", rng.choice(list(graph))) for r, graph in graphs.items()]
    check(spark, graphs, tips, 64)


def test_rounds_move_a_few_rows_per_commit(spark, monkeypatch):
    """The doubling moved every commit in each of its rounds, one more for every twofold depth."""
    written = []
    materialize = history.materialize

    def noted(df, label):
        table = materialize(df, label)
        written.append((label, table))
        return table

    monkeypatch.setattr(history, "materialize", noted)
    monkeypatch.setattr(history, "DOUBLED", 64, raising=False)
    size = 4000
    graph = {f"m{i}": [f"m{i - 1}"] if i else [] for i in range(size)}
    check(spark, {"r": graph}, [("r", "HEAD", f"m{size - 1}")], 512)
    steps = ("forest", "contraction", "doubling", "placed")
    assert sum(table.count() for label, table in written if label in steps) < 7 * size
    assert sum(table.count() for label, table in written if label == "doubling") < size / 2


def test_a_commit_that_comes_twice(spark, monkeypatch):
    graph = {f"m{i}": [f"m{i - 1}"] if i else [] for i in range(60)}
    rows = [("r", c, json.dumps(p)) for c, p in graph.items()] + [("r", "m30", '["m29"]')]
    commits = spark.createDataFrame(rows, COMMITS).coalesce(1)
    refs = spark.createDataFrame([("r", "HEAD", "m59")], REFS)
    doubled = sorted(map(tuple, walk_history(commits, refs).collect()))
    assert {row[1] for row in doubled} == set(graph)
    monkeypatch.setattr(history, "DOUBLED", 16)
    assert sorted(map(tuple, walk_history(commits, refs).collect())) == doubled
