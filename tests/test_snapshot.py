"""Relations of a snapshot are made when a question first reads them, narrow until they are written."""

import datetime
import hashlib

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from codestrata.dataset import Dataset
from codestrata.functions.trees import ROOT_TYPES, parse
from codestrata.operators.nodes import languages_of, select_nodes, stored_nodes
from codestrata.scratch import write_clustered
from codestrata.sources import snapshot, star_schema
from codestrata.sources.star_schema import open_star_schema


@pytest.fixture
def star(spark, tmp_path):
    """Two repositories, one author without a repository; null and repeated keys."""
    day = datetime.date(2020, 1, 1)
    tables = {
        "nation": ("n_nationkey int", [(0,), (1,)]),
        "customer": (
            "c_custkey long, c_nationkey int, c_name string, c_mktsegment string",
            [(1, 0, "Customer#1", "A"), (2, 1, "Customer#2", "B"), (3, None, "Customer#3", "A")],
        ),
        "orders": (
            "o_orderkey long, o_custkey long, o_orderdate date, o_orderpriority string, o_orderstatus string",
            [(1, 1, day, "1", "O"), (2, 1, day, "1", "O"), (3, 2, None, "2", "F"), (4, 3, day, "1", "O"),
             (3, 2, None, "2", "F"), (None, 2, day, "1", "O")],
        ),
        "lineitem": (
            "l_orderkey long, l_partkey long",
            [(1, 0), (1, 2), (1, 2), (2, 1), (3, 3), (3, None), (4, 2), (None, 2)],
        ),
        "documents": (
            "doc_id long, text string, source string",
            [(0, "x", "s"), (1, "y", "s"), (2, "z", None), (3, "w", "s"), (3, "w", "s"), (None, "v", "s")],
        ),
        "pages": ("page_id long, html string", [(0, "<p>")]),
        "events": ("event_id long, props string", [(0, "{}"), (1, "{}")]),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_only_what_is_asked_for_is_made(spark, star, monkeypatch):
    made = []
    for name in ("_owned_orders", "_contents", "_tree_files", "_commits", "_ref_commits"):
        def noted(*arguments, name=name, real=getattr(star_schema, name)):
            made.append(name)
            return real(*arguments)

        monkeypatch.setattr(star_schema, name, noted)
    ds = open_star_schema(spark, star)
    assert ds.sql("SELECT * FROM remotes").count() == 2 and made == []
    assert ds.sql("SELECT * FROM refs").count() == 4 and set(made) == {"_owned_orders"}
    ds.sql("SELECT file_path FROM files").collect()
    assert "_commits" not in made and "_ref_commits" not in made
    assert made.count("_tree_files") == 1
    ds.table("files").count()
    assert made.count("_tree_files") == 1


def test_views_follow_the_dataset(spark, star):
    ds, other = open_star_schema(spark, star), Dataset.empty(spark)
    count = "SELECT count(*) FROM {}"
    assert ds.sql(count.format("REMOTES")).first()[0] == 2
    other.sql(count.format("refs"))
    assert spark.sql(count.format("remotes")).first()[0] == 0
    ds.sql(count.format("refs"))
    assert spark.sql(count.format("remotes")).first()[0] == 2
    assert ds.sql(count.format("IDENTIFIER('com' || 'mits')")).first()[0] == 5


def test_file_rows_of_odd_keys(spark, star):
    ds = open_star_schema(spark, star)
    digest = lambda kind, n: hashlib.md5(f"{kind}-{n}".encode()).hexdigest()
    files = [
        ("repo-0", 1, "LICENSE", "blob", 0, "Text"),
        ("repo-0", 1, None, "blob", 2, None),
        ("repo-0", 2, "README.md", "blob", 1, "Markdown"),
        # Two rows of the order and of the document.
        *[("repo-1", 3, "src/s/f3.rb", "blob", 3, "Ruby")] * 4,
        ("repo-0", 1, "site/p0.html", "page", 0, "HTML"),
        ("repo-0", 1, "data/e1.json", "event", 1, "JSON"),
        ("repo-0", 2, "site/p0.html", "page", 0, "HTML"),
        ("repo-0", 2, "data/e0.json", "event", 0, "JSON"),
        *[("repo-1", 3, "site/p0.html", "page", 0, "HTML")] * 4,
        *[("repo-1", 3, "data/e1.json", "event", 1, "JSON")] * 4,
    ]
    expected = [(r, p, digest(kind, n), digest("tree", o), lang) for r, o, p, kind, n, lang in files]
    got = ds.classified_files.select("repository_id", "file_path", "blob_hash", "tree_hash", "language")
    key = lambda row: tuple(map(str, row))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(expected, key=key)
    reached = ds.table("ref_commits").where("ref_name = 'HEAD'")
    assert sorted((r["repository_id"], r["history_index"]) for r in reached.collect()) == [
        ("repo-0", 0), ("repo-0", 1), ("repo-1", 0), ("repo-1", 1), ("repo-1", 2)]


def test_only_the_languages_of_a_path_are_parsed(spark, star):
    ds = Dataset(spark, open_star_schema(spark, star).stored)
    selected = select_nodes(stored_nodes(ds, languages_of("/Document//p")), "/Document//p")
    assert selected.count() == 1
    assert {name for name in ds.stored if name.startswith("code_nodes")} == {"code_nodes:html"}
    assert languages_of("//p") == languages_of("/") == ["html", "json", "python"]
    assert languages_of("/Map/Pair") == ["json"] and languages_of("/Other") == []
    assert stored_nodes(ds, []).isEmpty()
    # Both ways of writing give one table.
    assert {row[0] for row in stored_nodes(ds).select("lang").distinct().collect()} == {"html", "json"}
    assert stored_nodes(ds, ["html"]).count() == stored_nodes(ds).where("lang = 'html'").count() == 2


def test_nodes_are_made_without_lists_and_sort(spark, star, monkeypatch):
    """Blobs and their languages are enough; texts of several languages are written as they come."""
    real, writers = DataFrameWriter.parquet, []

    def noted(self, path, *arguments, **options):
        if "code_nodes" in path:
            writers.append(spark.conf.get("spark.sql.maxConcurrentOutputFileWriters"))
        return real(self, path, *arguments, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    monkeypatch.setattr(snapshot, "_opened", {})
    ds = open_star_schema(spark, star)
    nodes = stored_nodes(ds)
    assert not ds.stored.made("tree_files") and writers == ["3"]
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
    expected = Dataset(spark, {n: df for n, df in ds.stored.items() if n != "blob_languages" and "code" not in n})
    assert sorted(map(str, nodes.collect())) == sorted(map(str, stored_nodes(expected).collect()))
    pairs = ds.classified_files.select("blob_hash", "language").distinct()
    assert sorted(map(str, ds.stored["blob_languages"].collect())) == sorted(map(str, pairs.collect()))


def test_roots_have_the_types_listed():
    texts = {"python": ["", "x = 1"], "html": ["", "<p>a", "text"],
             "json": ["{}", "[1]", "1", '"a"', "true", "null", '{"k": [2]}']}
    for lang, contents in texts.items():
        assert {parse(text, lang).type[0] for text in contents if parse(text, lang)} <= ROOT_TYPES[lang]
    assert {parse(text, "json").type[0] for text in texts["json"]} == ROOT_TYPES["json"]


def test_clustered_rows_are_sorted_by_columns(spark, tmp_path, monkeypatch):
    """An expression in a sort is computed for both rows of every comparison."""
    df = spark.createDataFrame([(n * 7 % 20,) for n in range(20)], "n long")
    plans, kind = [], type(df)
    real = kind.sortWithinPartitions

    def noted(self, *keys, **options):
        made = real(self, *keys, **options)
        plans.append(made._jdf.queryExecution().analyzed().toString().splitlines()[0])
        return made

    monkeypatch.setattr(kind, "sortWithinPartitions", noted)
    order = [F.concat(F.lit("p"), F.lpad(F.col("n").cast("string"), 3, "0"))]
    written = write_clustered(df, ["n"], f"{tmp_path}/sorted", order=order, made=[F.col("n").alias("m")])
    (plan,) = plans
    assert plan.startswith("Sort [") and "concat" not in plan
    assert written.columns == ["m"] and sorted(row.m for row in written.collect()) == list(range(20))
    for (rows,) in written.groupBy(F.input_file_name()).agg(F.collect_list("m")).select("collect_list(m)").collect():
        assert rows == sorted(rows)
