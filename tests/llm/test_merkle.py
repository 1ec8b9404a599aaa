import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from codestrata.llm.merkle import COLUMNS, lower_ascii, manifest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    named = dict(zip(["doc_id", "text", "lang", "source", "n_chars"], row))
    values = [named[name] for name in COLUMNS]
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def rise(nodes, fanout):
    """The top, and for each node its siblings before and after it on every level."""
    ways, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        for way, place in zip(ways, places):
            run, slot = runs[place // fanout], place % fanout
            way.append((run[:slot], run[slot + 1 :]))
        places = [place // fanout for place in places]
        nodes = [digest(*run) for run in runs]
    return nodes[0], ways


def brute(rows, tamper, fanout):
    groups = defaultdict(list)
    for row in rows:
        groups[row[3]].append(row)
    names = sorted(groups, key=lambda name: (name is not None, (name or "").encode()))
    out, tops = [], []
    for name in names:
        groups[name].sort(key=lambda row: (row[0] is not None, row[0] or 0, leaf(row)))
        top, ways = rise([leaf(row) for row in groups[name]], fanout)
        tops.append((top, ways))
    root, upper = rise([top for top, _ in tops], fanout)
    for name, (top, ways), above in zip(names, tops, upper):
        for row, way in zip(groups[name], ways):
            node, siblings = leaf(tamper(row)), []
            for before, after in way + above:
                node = digest(*before, node, *after)
                siblings += before + after
            out.append((row[0], leaf(row), top, root, digest(*siblings), node, node == root))
    return out


def same(spark, rows, fanout=16, partitions=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    df = df.selectExpr("*", "'x' AS place", "'x' AS node", "'x' AS leaf", "'x' AS root", "'x' AS id", "'x' AS found")
    chosen = F.col("doc_id") % 3 == 0
    text = F.when(chosen, lower_ascii(F.col("text"))).otherwise(F.col("text"))
    got = manifest(df, tampered={"text": text}, fanout=fanout)
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def tamper(row):
        if row[0] is None or row[0] % 3 or row[1] is None:
            return row
        return (row[0], row[1].translate(lower), *row[2:])

    found = [tuple(row[name] for name in names) for row in got.collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, brute(rows, tamper, fanout)))
    return found


@pytest.mark.parametrize("fanout", [2, 16])
def test_trees_of_all_heights(spark, fanout):
    sizes = {"a": 1, "b": 2, "c": 16, "d": 17, "é": 33, None: 3, "": 5, "hot": 270}
    rows, i = [], 0
    for source, size in sizes.items():
        for _ in range(size):
            rows.append((i, f"Text {i} É", "en", source, i))
            i += 1
    found = same(spark, rows, fanout)
    assert {row[-1] for row in found} == {True, False}


def test_many_sources(spark):
    same(spark, [(i, "T", None, f"s{i % 40}", None) for i in range(90)], 4)


def test_odd_rows(spark, odd):
    rows = [(i, text, None if i == 3 else "en", None if i in (1, 4) else "s", None) for i, text in odd]
    same(spark, rows)


def test_repeated_rows(spark):
    same(spark, [(1, "A", "en", "s", 1)] * 40 + [(2, "b", "en", "s", 1)] * 5)


def test_lone_row_and_empty_table(spark):
    ((_, own, top, root, proof, led, ok),) = same(spark, [(3, "abc", "en", "s", 3)])
    assert own == top == root == led and proof == digest() and ok
    df = spark.createDataFrame([], SCHEMA)
    assert manifest(df).count() == 0


def test_clean_rows_verify(spark):
    df = spark.createDataFrame([(i, "A", "en", "s", 1) for i in range(20)], SCHEMA)
    assert manifest(df).where("verified").count() == 20
