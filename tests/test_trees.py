import json
import random
import time

import pytest
from pyspark.sql import functions as F

from codestrata.dataset import Dataset
from codestrata.functions import paths, trees
from codestrata.functions.sql import uast
from codestrata.operators.nodes import (
    NODE_COLUMNS,
    check_supported,
    code_nodes,
    drivers,
    nodes_by_blob,
    parsable_blobs,
    select_nodes,
    subtrees,
    trees_by_blob,
    unsupported_languages,
)
from codestrata.plans import analyses

PYTHON = b"import os\ndef f(a):\n    return a.trim(trim(1), 'x')\nclass C:\n    async def g(self): pass\n"
HTML = b"<!doctype html><p class='a'>one<br><b>two</p><ul><li>x<li>y</ul><!-- c -->"
JSON = b'{"a": [1, 2.50, true, null, {"b": "x"}], "a": "again"}'


def dataset(spark, blobs, files):
    """``blobs``: hash -> bytes; ``files``: (repository, path, hash)."""
    empty = Dataset.empty(spark)
    contents = spark.createDataFrame(
        [(h, len(c), bytearray(c)) for h, c in blobs.items()],
        "blob_hash string, blob_size long, blob_content binary",
    )
    listed = spark.createDataFrame(
        [(r, p, h, f"tree-{r}") for r, p, h in files],
        "repository_id string, file_path string, blob_hash string, tree_hash string",
    )
    commits = listed.select("repository_id", "tree_hash").distinct()
    for name in empty.table("commits").columns:
        if name not in commits.columns:
            value = F.concat(F.lit("c-"), "repository_id") if name == "commit_hash" else F.lit(None)
            commits = commits.withColumn(name, value.cast("string"))
    refs = commits.select("repository_id", F.lit("HEAD").alias("ref_name"), "commit_hash")
    stored = {**empty.stored, "contents": contents, "tree_files": listed}
    return Dataset(spark, {**stored, "commits": commits, "refs": refs})


def types_of(tree):
    return list(zip(tree.type, tree.parent, strict=True))


def test_python_tree():
    tree = trees.parse(PYTHON, "python")
    assert [tree.attrs[i] for i in paths.matches(tree, "//FunctionGroup")] == [
        (("Name", "f"),),
        (("Name", "g"),),
    ]
    assert len(paths.matches(tree, '//*[@roleCallee]/Identifier[@Name="trim"]')) == 2
    assert len(paths.matches(tree, "//Import")) == 1
    assert paths.matches(tree, "/") == paths.matches(tree, "/Module") == [0]
    assert len(paths.matches(tree, '//String[@token="x"]')) == 1
    assert len(paths.matches(tree, "//ClassDef//FunctionGroup/Identifier[@Name='g']")) == 1
    assert paths.matches(tree, "//Nothing") == []


def test_html_tree_closes_elements():
    tree = trees.parse(HTML, "html")
    kinds = types_of(tree)
    assert kinds[:3] == [("Document", None), ("p", 0), ("String", 1)]
    assert ("br", 1) in kinds and ("b", 1) in kinds and ("ul", 0) in kinds
    assert len(paths.matches(tree, "//ul//li")) == 2
    assert len(paths.matches(tree, "//p[@class='a']")) == 1
    assert len(paths.matches(tree, "/Document/Comment")) == 1


def test_json_tree_keeps_repeated_names_and_digits():
    tree = trees.parse(JSON, "json")
    assert len(paths.matches(tree, '/Map/Pair[@Name="a"]')) == 2
    numbers = paths.matches(tree, "//Number")
    assert [tree.token[i] for i in numbers] == ["1", "2.50"]


@pytest.mark.parametrize(
    "content, lang",
    [
        (b'print "Hello World"\n', "python"),
        (b"a\0b", "python"),
        (b"{bad", "json"),
        (b"NaN", "json"),
        (b"[" * 200_000, "json"),
        (b"x", "cobol"),
        (b"x", None),
        (None, "html"),
    ],
)
def test_no_tree(content, lang):
    assert trees.parse(content, lang) is None


@pytest.mark.parametrize("mode", trees.MODES)
@pytest.mark.parametrize("content, lang", [(PYTHON, "python"), (HTML, "html"), (JSON, "json")])
@pytest.mark.parametrize("query", ["", "/"])
def test_rendered_nodes_are_json(mode, content, lang, query):
    tree = trees.parse(content, lang, mode)
    roots = paths.matches(tree, query) if query else [0]
    (root,) = json.loads(trees.render(tree, roots))

    def count(node):
        return 1 + sum(count(child) for child in node["children"])

    assert count(root) == len(tree)
    assert ("@role" in root) == (mode != "native")


def test_modes_differ():
    names = {mode: trees.parse(PYTHON, "python", mode).type for mode in trees.MODES}
    assert "FunctionDef" in names["native"] and names["native"] == names["annotated"]
    assert "FunctionGroup" in names["semantic"] and "FunctionDef" not in names["semantic"]
    with pytest.raises(ValueError, match="semantic, annotated, native"):
        trees.check_mode("other")


def test_deep_text_is_whole():
    depth = 30_000
    tree = trees.parse(b"<b>" * depth, "html")
    assert len(tree) == depth + 1 and max(tree.depth) == depth
    assert trees.render(tree, [0]).count("@type") == depth + 1


def test_numbering():
    for content, lang in [(PYTHON, "python"), (HTML, "html"), (JSON, "json")]:
        tree = trees.parse(content, lang)
        assert sorted(tree.post) == list(range(len(tree)))
        for node, parent in enumerate(tree.parent):
            if parent is not None:
                assert parent < node and tree.post[parent] > tree.post[node]
                assert tree.depth[node] == tree.depth[parent] + 1


@pytest.mark.parametrize("query", ["", "x", "//", "//a[", "//a[@b=c]", "/a//", "//a/text()"])
def test_bad_query(query):
    with pytest.raises(ValueError, match="not a path"):
        paths.steps_of(query)


def random_json(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        return rng.choice([1, "s", True, None])
    if rng.random() < 0.5:
        return [random_json(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {rng.choice("abc"): random_json(rng, depth - 1) for _ in range(rng.randrange(4))}


QUERIES = [
    "/",
    "//Number",
    "/Map/Pair",
    "//List//Pair//Number",
    '//Pair[@Name="a"]//List//*',
    "//Map//Map",
    "//*[@roleLiteral]",
    '/*/*//Pair[@Name="b"]/*',
]


def test_relational_steps_equal_single_text_steps(spark):
    rng = random.Random(7)
    blobs = {f"b{i}": json.dumps(random_json(rng, 7)).encode() for i in range(40)}
    ds = dataset(spark, blobs, [("r", f"{h}.json", h) for h in blobs])
    nodes = code_nodes(ds).cache()
    assert nodes.select("blob_hash").distinct().count() == len(blobs)
    for query in QUERIES:
        got = {(r.blob_hash, r.pre) for r in select_nodes(nodes, query).collect()}
        expected = {
            (h, node)
            for h, content in blobs.items()
            for node in paths.matches(trees.parse(content, "json"), query)
        }
        assert got == expected, query


def test_each_blob_is_parsed_once(spark):
    files = [(f"r{i}", f"dir/f{i % 5}.py", "b1") for i in range(50)]
    files += [("r0", "tool", "b1"), ("r0", "page.html", "b2"), ("r1", "same.json", "b2")]
    files += [("r1", "Main.java", "b3"), ("r2", "script", "b4"), ("r2", "copy.py", "b4")]
    script = b"#!/usr/bin/env python\ndef f(): pass\n"
    blobs = {"b1": PYTHON, "b2": b"{}", "b3": b"class A {}", "b4": script}
    ds = dataset(spark, blobs, files)
    got = sorted((r.blob_hash, r.lang) for r in parsable_blobs(ds, ds.classified_files).collect())
    assert got == [("b1", "python"), ("b2", "html"), ("b2", "json"), ("b4", "python")]
    calls = analyses.files_calling(ds, "trim").collect()
    assert len(calls) == 50
    assert all(len(json.loads(r.functionCall)) == 2 for r in calls)
    functions = analyses.functions_of_language(ds, "Java").collect()
    assert [(r.file_path, r.functions) for r in functions] == [("Main.java", None)]
    with_tree = analyses.uast_at_head(ds)
    assert with_tree.where("file_path = 'script'").count() == 1
    assert with_tree.count() == 50 + 2 + 2


def test_nodes_by_blob_keeps_document_order(spark):
    ds = dataset(spark, {"b": b"[3, 1, 2]"}, [("r", "x.json", "b")])
    (row,) = nodes_by_blob(select_nodes(code_nodes(ds), "//Number")).collect()
    assert [n["token"] for n in json.loads(row.nodes)] == ["3", "1", "2"]


def test_uast_column(spark):
    df = spark.createDataFrame([(PYTHON, "Python"), (b"x", "Java")], "c binary, l string")
    query = "//FunctionGroup"
    found = [r[0] for r in df.select(uast(F.col("c"), F.col("l"), query)).collect()]
    assert len(json.loads(bytes(found[0]))) == 2 and found[1] is None


def test_sql_functions(spark, ds):
    ds.register()
    row = spark.sql(
        "SELECT array_length(uast('[1,2]', 'json')) one, Array_Length(UAST('[1,2]', 'JSON', '//Number')) two, "
        "UAST('x', Language('a.java', '')) none, LANGUAGE('a.java', '') java"
    ).first()
    assert (row.one, row.two, row.none, row.java) == (1, 2, None, "Java")


def test_drivers(spark, ds):
    assert [r.language for r in drivers(ds).collect()] == ["html", "json", "python"]
    assert check_supported("Python") == "python"
    with pytest.raises(ValueError, match="html, json, python"):
        check_supported("cobol")
    found = {r.language for r in unsupported_languages(ds).collect()}
    assert "bash" in found and "python" not in found


def test_mode_changes_the_node_table(spark):
    ds = dataset(spark, {"b": PYTHON}, [("r", "a.py", "b")])
    native = code_nodes(ds, mode="native")
    assert native.where("type = 'FunctionDef'").count() == 1
    assert native.where("size(roles) > 0").count() == 0
    with pytest.raises(ValueError):
        code_nodes(ds, mode="other")


def test_depth_and_length_of_json_do_not_matter():
    deep = b"[" * 100_000 + b"]" * 100_000
    assert len(trees.parse(deep, "json")) == 100_000
    assert len(trees.parse(b'{"a":' * 50_000 + b"1" + b"}" * 50_000, "json")) == 100_001
    assert trees.parse(b"[" + b"7" * 5000 + b"]", "json").token[1] == "7" * 5000


def test_long_integers_in_python():
    tree = trees.parse(b"x = " + b"7" * 5000, "python")
    assert "7" * 5000 in tree.token


@pytest.mark.parametrize(
    ("content", "lang", "reason"),
    [
        (b"x = " + b"+".join([b"1"] * 20_000), "python", "too deep"),
        (b"-" * 100_000 + b"1", "python", "too deep"),
        (b"(" * 1000, "python", "too deep"),
        (b"def", "python", "invalid"),
        (b"[1,]", "json", "invalid"),
        (b"NaN", "json", "invalid"),
        (b"x", "java", "no parser"),
        (None, "json", "no content"),
    ],
)
def test_reason_of_texts_without_tree(content, lang, reason):
    assert trees.tree_or_reason(content, lang) == (None, reason)


def test_running_out_of_memory_is_raised(monkeypatch):
    def fail(content, tree):
        raise MemoryError

    monkeypatch.setattr(trees, "_json", fail)
    with pytest.raises(MemoryError):
        trees.parse(b"1", "json")


def test_stray_end_tags_take_linear_time():
    def seconds(count):
        begin = time.process_time()
        trees.parse(b"<p>" * count + b"</x>" * count, "html")
        return time.process_time() - begin

    seconds(100)
    assert seconds(20_000) < 2


NESTED = """
class A:
    def f(self):
        def g(x):
            return h(x, lambda y: y)
        return g

def last(): return [1, "two", {"k": None}]
"""


def node_table(spark, texts):
    """The nodes of ``texts`` (key -> (text, language)) and their parsed trees."""
    parsed, rows = {key: trees.parse(*text) for key, text in texts.items()}, []
    for key, tree in parsed.items():
        columns = {**tree.columns(), "roles": map(list, tree.roles), "attrs": map(dict, tree.attrs)}
        rows += [(key, texts[key][1], pre, *values) for pre, values in enumerate(zip(*columns.values()))]
    names = ["blob_hash", "lang", "pre", *tree.columns()]
    table = spark.createDataFrame(rows, ", ".join(_column(name) for name in names))
    return table.repartition(3), parsed


def _column(name):
    return next(part for part in NODE_COLUMNS.split(", ") if part.split()[0] == name)


@pytest.mark.parametrize("path", ["/", "//FunctionGroup", "//*", "//Identifier", "//Nothing"])
def test_subtrees_are_what_render_gives(spark, path):
    table, parsed = node_table(
        spark,
        {
            "a": (NESTED, "python"),
            "b": ("x = f(f(f(1)))\n", "python"),
            "c": ('{"k": [1, {"l": "é\\""}]}', "json"),
            "d": ("<p>a<b>c</b></p><!-- x --><i>y", "html"),
        },
    )
    rows = trees_by_blob(subtrees(table, select_nodes(table, path))).collect()
    expected = {key: json.loads(trees.render(tree, paths.matches(tree, path))) for key, tree in parsed.items()}
    assert {row.blob_hash: json.loads(row.nodes) for row in rows} == {k: v for k, v in expected.items() if v}


@pytest.mark.parametrize("text", ["[" * 200 + "]" * 200, "[" + ",".join(["[1]"] * 5000) + "]"])
def test_subtrees_of_a_deep_and_a_wide_text(spark, text):
    table, parsed = node_table(spark, {"x": (text, "json")})
    (row,) = trees_by_blob(subtrees(table, select_nodes(table, "/"))).collect()
    assert json.loads(row.nodes) == json.loads(trees.render(parsed["x"], [0]))
