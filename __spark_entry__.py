
from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from codestrata.functions.language import CONTENT_SIGNS, language_of_content, parser_name  # noqa: E402
from codestrata.operators.history import walk_history  # noqa: E402
from codestrata.operators.joins import natural_join  # noqa: E402
from codestrata.operators.languages import with_language  # noqa: E402
from codestrata.operators.layout import clustered, interleaved  # noqa: E402
from codestrata.operators.nodes import (  # noqa: E402
    languages_of,
    node_json,
    nodes_by_blob,
    select_nodes,
    stored_nodes,
    subtrees,
    texts_without_tree,
    trees_by_blob,
    unsupported_languages,
)
from codestrata.plans import analyses  # noqa: E402
from codestrata.sources.star_schema import open_star_schema  # noqa: E402
from fixture_sql import WITH_TABLES  # noqa: E402

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def _add(name: str, build: Callable, oracle: str | None = None) -> None:
    """Register ``build(dataset)``; ``oracle`` is SQL over the eleven tables."""
    _QUERIES[name] = lambda spark, sf_dir: build(open_star_schema(spark, sf_dir))
    if oracle is not None:
        _ORACLES[name] = WITH_TABLES + oracle


def _add_sql(name: str, text: str, oracle: str | None = None) -> None:
    """Register SQL that runs through the registered views, unchanged in the oracle."""
    _add(name, lambda ds: ds.sql(text), oracle or text)


def entry(spark: SparkSession) -> DataFrame:
    """Flagship query: the ten repositories with most commits in HEAD."""
    return analyses.top_repositories_by_commits(open_star_schema(spark, "/root/testdata/sf0.001"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


# Scans. Content is read whole and compared by digest.


def _digested(df: DataFrame) -> DataFrame:
    return df.withColumn("blob_content", F.md5(F.col("blob_content").cast("binary")))


for _table in (
    "repositories",
    "commits",
    "refs",
    "ref_commits",
    "commit_files",
    "commit_blobs",
    "commit_trees",
    "tree_entries",
    "remotes",
):
    _add(f"scan_{_table}", lambda ds, t=_table: ds.table(t), f"SELECT * FROM {_table}")
for _table in ("files", "blobs"):
    _add(
        f"scan_{_table}",
        lambda ds, t=_table: _digested(ds.table(t)),
        f"SELECT * REPLACE (md5(blob_content) AS blob_content) FROM {_table}",
    )

_add(
    "history_walk",
    lambda ds: walk_history(ds.table("commits"), ds.table("refs")),
    "SELECT * FROM ref_commits",
)

# Clustered copy: the filter skips files and row groups.


def _lookup(ds) -> DataFrame:
    copy = clustered(ds, "ref_commits", ["repository_id", "ref_name"])
    return copy.where("repository_id = 'repo-7' AND ref_name = 'HEAD'")


_add(
    "clustered_lookup",
    _lookup,
    "SELECT * FROM ref_commits WHERE repository_id = 'repo-7' AND ref_name = 'HEAD'",
)
_add(
    "interleaved_lookup",
    lambda ds: interleaved(ds, "commits", ["repository_id", "commit_author_name"]).where(
        "commit_author_name = 'Customer#000000007'"
    ),
    "SELECT * FROM commits WHERE commit_author_name = 'Customer#000000007'",
)

# Projection, filter, predicates.

_add_sql("project_columns", "SELECT repository_id, commit_hash, commit_message FROM commits")
_add_sql("project_all_columns", "SELECT * FROM refs")
_add_sql(
    "column_aliases",
    "SELECT f.repository_id id, f.file_path AS path, f.blob_size size_in_bytes FROM files f",
)
_add_sql(
    "qualified_names",
    "SELECT commit_files.file_path, r.ref_name FROM ref_commits AS r NATURAL JOIN commit_files "
    "WHERE r.ref_name = 'HEAD'",
)
_add_sql(
    "equal_to_text",
    "SELECT repository_id, commit_hash, history_index FROM ref_commits WHERE ref_name = 'HEAD'",
)
_add_sql(
    "equal_to_number",
    "SELECT repository_id, commit_hash, ref_name FROM ref_commits WHERE history_index = 0",
)
_add_sql(
    "both_conditions",
    "SELECT repository_id, commit_hash FROM ref_commits WHERE ref_name = 'HEAD' AND history_index = 0",
)
_add_sql(
    "either_condition",
    "SELECT repository_id, file_path, blob_hash FROM files "
    "WHERE file_path = 'LICENSE' OR file_path = 'README.md'",
)
_add_sql(
    "content_not_empty",
    "SELECT repository_id, blob_hash FROM blobs WHERE blob_content != ''",
)
_add_sql(
    "function_value_above",
    "SELECT repository_id, commit_hash FROM commits WHERE ARRAY_LENGTH(commit_parents) > 0",
    "SELECT repository_id, commit_hash FROM commits WHERE json_array_length(commit_parents) > 0",
)
_add_sql(
    "function_in_predicate",
    "SELECT repository_id, file_path, tree_hash FROM files WHERE LANGUAGE(file_path, blob_content) = 'Java'",
    "SELECT repository_id, file_path, tree_hash FROM languages WHERE language = 'Java'",
)
_add_sql(
    "derived_table",
    "SELECT author FROM (SELECT DISTINCT commit_author_email AS author FROM commits) AS t",
)
_add_sql(
    "filter_computed_alias",
    "SELECT * FROM (SELECT repository_id, file_path, LANGUAGE(file_path, blob_content) AS language "
    "FROM files) t WHERE language != 'Python'",
    "SELECT * FROM (SELECT repository_id, file_path, language FROM languages) t WHERE language != 'Python'",
)

# Joins.

_add(
    "natural_join_two_tables",
    lambda ds: natural_join(ds.table("refs"), ds.table("commits")).select(
        "repository_id", "ref_name", "commit_hash", "commit_message"
    ),
    "SELECT repository_id, ref_name, commit_hash, commit_message FROM refs NATURAL JOIN commits",
)
_add(
    "natural_join_three_tables",
    lambda ds: ds.joined("ref_commits", "commit_files", "files")
    .where("ref_name = 'HEAD'")
    .select("repository_id", "commit_hash", "file_path", "history_index"),
    "SELECT repository_id, commit_hash, file_path, history_index "
    "FROM ref_commits NATURAL JOIN commit_files NATURAL JOIN files WHERE ref_name = 'HEAD'",
)
_add_sql(
    "natural_join_four_tables",
    "SELECT files.repository_id, files.file_path, files.blob_hash, refs.ref_name "
    "FROM files NATURAL JOIN commit_files NATURAL JOIN commits NATURAL JOIN refs",
    "SELECT repository_id, file_path, blob_hash, ref_name "
    "FROM files NATURAL JOIN commit_files NATURAL JOIN commits NATURAL JOIN refs",
)
_add(
    "tip_of_ref_files",
    lambda ds: analyses.tip_files(ds).select("repository_id", "file_path", "blob_hash"),
    "SELECT repository_id, file_path, blob_hash FROM ref_commits NATURAL JOIN commit_files "
    "WHERE ref_name = 'HEAD' AND history_index = 0",
)

# Aggregations.

_add_sql(
    "count_by_one_key",
    "SELECT ref_name, COUNT(*) AS commits FROM ref_commits GROUP BY ref_name",
)
_add_sql(
    "count_by_two_keys",
    "SELECT repository_id, ref_name, COUNT(*) AS commits FROM ref_commits GROUP BY repository_id, ref_name",
)
_add_sql(
    "count_distinct",
    "SELECT repository_id, COUNT(DISTINCT blob_hash) AS blobs FROM commit_files GROUP BY repository_id",
)
_add_sql(
    "files_of_language_in_sql",
    "SELECT repository_id, file_path, blob_hash FROM classified_files WHERE language = 'Java'",
    "SELECT repository_id, file_path, blob_hash FROM languages WHERE language = 'Java'",
)
_ROWS_OVER_JOIN = (
    "SELECT repository_id, COUNT(*) num_files "
    "FROM ref_commits NATURAL JOIN commit_files NATURAL JOIN files GROUP BY repository_id"
)
_add(
    "count_rows_over_join",
    lambda ds: ds.count_joined(
        ["ref_commits", "commit_files", "files"], ["repository_id"], "num_files"
    ),
    _ROWS_OVER_JOIN,
)
_add_sql(
    "count_rows_over_join_in_sql",
    "SELECT f.repository_id, COUNT(*) num_files "
    "FROM ref_commits r NATURAL JOIN commit_files cf NATURAL JOIN files f GROUP BY f.repository_id",
    _ROWS_OVER_JOIN,
)
_add(
    "count_commits_per_path",
    lambda ds: ds.count_joined(
        ["files", "commit_files", "ref_commits"],
        ["repository_id", "file_path"],
        "num_commits",
        where={"ref_commits": "ref_name = 'HEAD'"},
    ),
    "SELECT repository_id, file_path, COUNT(*) AS num_commits "
    "FROM files NATURAL JOIN commit_files NATURAL JOIN ref_commits WHERE ref_name = 'HEAD' "
    "GROUP BY repository_id, file_path",
)

# Sort, limit, top-k.

_add_sql(
    "sort_descending",
    "SELECT repository_id, ref_name, COUNT(*) AS n FROM ref_commits "
    "GROUP BY repository_id, ref_name ORDER BY n DESC, repository_id, ref_name",
)
_add_sql("sort_ascending", "SELECT * FROM repositories ORDER BY repository_id")
_add_sql(
    "top_k",
    "SELECT commit_hash, history_index, ref_name FROM ref_commits "
    "ORDER BY history_index DESC, ref_name, commit_hash LIMIT 25",
)
_add("limit_any_rows", lambda ds: ds.table("commit_files").limit(10))

# Language.

_add(
    "language_per_repository",
    lambda ds: ds.classified_files
    .groupBy("repository_id", "language")
    .agg(F.count("*").alias("num_files")),
    "SELECT repository_id, language, COUNT(*) AS num_files FROM languages GROUP BY repository_id, language",
)
_add(
    "language_of_files",
    lambda ds: ds.classified_files.select("repository_id", "file_path", "language"),
    "SELECT repository_id, file_path, language FROM languages",
)
_add(
    "classify_files",
    lambda ds: ds.classified_files.select(
        "file_path", "tree_hash", F.lower("language").alias("lang")
    ),
    "SELECT file_path, tree_hash, lower(language) AS lang FROM languages",
)
_add(
    "parser_of_files",
    lambda ds: ds.classified_files.select(
        "file_path", "tree_hash", parser_name(F.col("language")).alias("parser")
    ),
    "SELECT file_path, tree_hash, CASE lower(language) WHEN 'shell' THEN 'bash' ELSE lower(language) END "
    "AS parser FROM languages",
)

_add(
    "unsupported_languages",
    unsupported_languages,
    "SELECT CASE language WHEN 'Shell' THEN 'bash' ELSE lower(language) END AS language, "
    "COUNT(*) AS num_files FROM languages "
    "WHERE language NOT IN ('Python', 'HTML', 'JSON') GROUP BY language",
)

# Syntax trees: every distinct blob, whole.

# Extensions that several languages share. The tables hold no such files, so every blob
# gets one of those extensions and the beginning of some language, by digits of its hash.

_OPENINGS = (
    "",
    "#import <x.h>\n",
    "namespace n {\n",
    "use strict;\n",
    ":- module(m, []).\n",
    "<?xml version=1.0?>\n",
    "% note\nfunction f(x)\n",
)


def _language_by_content(ds) -> DataFrame:
    def by_digit(place: int, values) -> Column:
        digit = F.instr(F.lit("0123456789abcdef"), F.substring("blob_hash", place, 1))
        return F.element_at(F.array(*map(F.lit, values)), digit % len(values) + 1)

    blobs = ds.contents.select("blob_hash", F.concat(by_digit(2, _OPENINGS), "blob_content").alias("blob_content"))
    path = F.concat(F.lit("src/"), "blob_hash", F.lit("."), by_digit(1, CONTENT_SIGNS))
    files = blobs.select(path.alias("file_path"), "blob_hash")
    return with_language(files, blobs.withColumn("content_language", language_of_content())).select(
        "file_path", "language"
    )


def _language_by_content_sql() -> str:
    def by_digit(place: int, values) -> str:
        listed = ", ".join("'" + value.replace("\n", "' || chr(10) || '") + "'" for value in values)
        digit = f"instr('0123456789abcdef', substr(blob_hash, {place}, 1))"
        return f"[{listed}][{digit} % {len(values)} + 1]"

    cases = []
    for extension, languages in CONTENT_SIGNS.items():
        weights = [
            " + ".join(["0", *(f"{n} * CAST(regexp_matches(t, '{sign}') AS INT)" for sign, n in signs)])
            for signs in languages.values()
        ]
        whens = []
        for place, name in enumerate(languages):
            beaten = [f"({weights[place]}) >= ({other})" for other in weights[place + 1 :]]
            whens.append(f"WHEN {' AND '.join(beaten)} THEN '{name}'" if beaten else f"ELSE '{name}'")
        cases.append(f"WHEN e = '{extension}' THEN CASE {' '.join(whens)} END")
    return (
        f"SELECT 'src/' || blob_hash || '.' || e AS file_path, CASE {' '.join(cases)} END AS language "
        f"FROM (SELECT blob_hash, {by_digit(1, CONTENT_SIGNS)} AS e, "
        f"{by_digit(2, _OPENINGS)} || blob_content AS t FROM contents)"
    )


_add("language_by_content", _language_by_content, _language_by_content_sql())

_DISTINCT_FILES = "(SELECT DISTINCT blob_hash, language FROM languages)"
_TAGS = (
    "regexp_extract_all(regexp_replace({}, '<script>.*?</script>', '<script>', 'gs'), "
    "'<([a-z][a-z0-9]*)', 1)"
)
_COMMENTS = "len(regexp_extract_all(blob_content, '<!--(?s:.*?)-->'))"
# Runs of text with a visible character; comments split text, a script is one run.
_TEXTS = (
    "len(regexp_extract_all(regexp_replace(regexp_replace(blob_content, '<!--.*?-->', '<!>', 'gs'), "
    "'<script>.*?</script>', '<script>x</script>', 'gs'), '>[^<]*[^<\\s][^<]*'))"
)


def _count_by_blob(ds, language: str, path: str) -> DataFrame:
    nodes = stored_nodes(ds, [language]).where(F.col("lang") == language.lower())
    selected = select_nodes(nodes, path)
    return selected.groupBy("blob_hash").agg(F.count("*").alias("num_nodes"))


def _selected(ds, path: str) -> DataFrame:
    return select_nodes(stored_nodes(ds, languages_of(path)), path)


_add(
    "nodes_per_type",
    lambda ds: stored_nodes(ds).groupBy("lang", "type").agg(F.count("*").alias("num_nodes")),
    "SELECT lang, type, CAST(sum(n) AS BIGINT) AS num_nodes FROM ("
    "  SELECT 'python' AS lang, unnest(['Module', 'FunctionGroup', 'arguments', 'Argument', 'Return', "
    "    'List', 'Call', 'QualifiedIdentifier', 'Identifier']) AS type, "
    "    unnest([1, functions, functions, functions, functions, functions, calls, calls, "
    "    functions + 2 * calls]) AS n FROM python_source SEMI JOIN languages USING (blob_hash) "
    "  UNION ALL SELECT 'json', unnest(['Map', 'Pair', 'Number']), 1 "
    f"  FROM {_DISTINCT_FILES} l JOIN contents USING (blob_hash) WHERE language = 'JSON' "
    "  UNION ALL SELECT 'html', 'Document', 1 "
    f"  FROM {_DISTINCT_FILES} l JOIN contents USING (blob_hash) WHERE language = 'HTML' "
    f"  UNION ALL SELECT 'html', unnest(['String', 'Comment']), unnest([{_TEXTS}, {_COMMENTS}]) "
    f"  FROM {_DISTINCT_FILES} l JOIN contents USING (blob_hash) WHERE language = 'HTML'"
    f"  UNION ALL SELECT 'html', unnest({_TAGS.format('blob_content')}), 1 "
    f"  FROM {_DISTINCT_FILES} l JOIN contents USING (blob_hash) WHERE language = 'HTML'"
    ") x GROUP BY lang, type",
)
_add(
    "blobs_parsed_or_reported",
    lambda ds: stored_nodes(ds)
    .where("parent_pre IS NULL")
    .select("blob_hash", "lang")
    .unionByName(texts_without_tree(ds).select("blob_hash", "lang")),
    "SELECT blob_hash, lower(language) AS lang "
    f"FROM {_DISTINCT_FILES} l WHERE language IN ('Python', 'HTML', 'JSON')",
)
_add(
    "functions_per_blob",
    lambda ds: _count_by_blob(ds, "Python", "//FunctionGroup"),
    "SELECT blob_hash, functions AS num_nodes FROM python_source SEMI JOIN languages USING (blob_hash)",
)
_add(
    "calls_of_trim_per_blob",
    lambda ds: _count_by_blob(ds, "Python", '//*[@roleCallee]/Identifier[@Name="trim"]'),
    "SELECT blob_hash, calls AS num_nodes FROM python_source SEMI JOIN languages USING (blob_hash) WHERE trims",
)
_add(
    "links_below_navigation",
    lambda ds: _count_by_blob(ds, "HTML", "//nav//a[@href]"),
    "SELECT blob_hash, CAST(len(regexp_extract_all(regexp_extract(blob_content, '<nav>.*</nav>'), "
    "'<a href=')) AS BIGINT) AS num_nodes "
    f"FROM {_DISTINCT_FILES} l JOIN contents USING (blob_hash) "
    "WHERE language = 'HTML' AND blob_content LIKE '%<nav>%<a href=%</nav>%'",
)
_add(
    "root_nodes",
    lambda ds: select_nodes(stored_nodes(ds), "/").select("blob_hash", "lang", "type"),
    "SELECT blob_hash, lower(language) AS lang, "
    "CASE language WHEN 'Python' THEN 'Module' WHEN 'HTML' THEN 'Document' ELSE 'Map' END AS type "
    f"FROM {_DISTINCT_FILES} l WHERE language IN ('Python', 'HTML', 'JSON')",
)
_add(
    "nodes_as_json",
    lambda ds: _selected(ds, '/Map/Pair[@Name="k"]/Number').select(
        "blob_hash", node_json().alias("node")
    ),
    """SELECT blob_hash, '{"type":"Number","roles":["Literal","Number"],"attrs":{},"token":"' ||
       json_extract_string(blob_content, '$.k') || '"}' AS node """
    f"FROM {_DISTINCT_FILES} l JOIN contents USING (blob_hash) WHERE language = 'JSON'",
)
_add(
    "node_arrays_per_blob",
    lambda ds: nodes_by_blob(_selected(ds, "/Module/FunctionGroup[@Name]")).select("blob_hash", F.json_array_length("nodes").cast("bigint").alias("num_nodes")),
    "SELECT blob_hash, functions AS num_nodes FROM python_source SEMI JOIN languages USING (blob_hash)",
)


def _subtrees_per_blob(ds) -> DataFrame:
    nodes = stored_nodes(ds, ["python"]).where(F.col("lang") == "python")
    trees = trees_by_blob(subtrees(nodes, select_nodes(nodes, "/Module/FunctionGroup[@Name]")))
    return trees.select("blob_hash", F.length("nodes").alias("chars"), F.md5("nodes").alias("nodes"))


_add(
    "subtrees_per_blob",
    _subtrees_per_blob,
    "SELECT blob_hash, CAST(length(functions) AS INTEGER) AS chars, md5(functions) AS nodes "
    "FROM python_trees SEMI JOIN languages USING (blob_hash)",
)
_add_sql(
    "tree_function_in_sql",
    "SELECT repository_id, blob_hash, CAST(ARRAY_LENGTH(UAST(blob_content, "
    "LANGUAGE(file_path, blob_content), '//Number')) AS BIGINT) AS numbers "
    "FROM files WHERE LANGUAGE(file_path, blob_content) = 'JSON'",
    "SELECT repository_id, blob_hash, CAST(1 AS BIGINT) AS numbers FROM languages WHERE language = 'JSON'",
)

# Documented analyses.

_HEAD_PYTHON = (
    "FROM ref_commits NATURAL JOIN commit_files JOIN python_source USING (blob_hash) "
    "WHERE ref_name = 'HEAD' AND history_index = 0"
)
_add("uast_at_head", analyses.uast_at_head)
_add(
    "files_with_tree_at_head",
    lambda ds: analyses.uast_at_head(ds).select("file_path"),
    "SELECT file_path FROM ref_commits NATURAL JOIN languages WHERE ref_name = 'HEAD' "
    "AND history_index = 0 AND language IN ('Python', 'HTML', 'JSON')",
)
_add(
    "functions_of_python_files",
    lambda ds: analyses.functions_of_language(ds, "Python").select(
        "repository_id",
        "file_path",
        "functions",
        F.json_array_length("functions").cast("bigint").alias("num_functions"),
    ),
    "SELECT repository_id, file_path, t.functions, python_source.functions AS num_functions "
    f"{_HEAD_PYTHON.replace('WHERE', 'JOIN python_trees t USING (blob_hash) WHERE')}",
)
_add(
    "functions_of_java_files",
    lambda ds: analyses.functions_of_language(ds, "Java"),
    "SELECT repository_id, file_path, CAST(NULL AS VARCHAR) AS functions "
    "FROM ref_commits NATURAL JOIN languages WHERE ref_name = 'HEAD' AND history_index = 0 "
    "AND language = 'Java'",
)
_add(
    "files_calling_trim",
    lambda ds: analyses.files_calling(ds, "trim").select(
        "repository_id",
        "file_path",
        "functionCall",
        F.json_array_length("functionCall").cast("bigint").alias("num_calls"),
    ),
    'SELECT repository_id, file_path, t.calls AS "functionCall", python_source.calls AS num_calls '
    f"{_HEAD_PYTHON.replace('WHERE', 'JOIN trim_calls t USING (blob_hash) WHERE')} AND trims",
)

_add(
    "top_repositories_by_commits",
    analyses.top_repositories_by_commits,
    "SELECT repository_id, commit_count FROM (SELECT r.repository_id, COUNT(*) AS commit_count "
    "FROM ref_commits r WHERE r.ref_name = 'HEAD' GROUP BY r.repository_id) AS q "
    "ORDER BY commit_count DESC, repository_id LIMIT 10",
)
_add(
    "files_at_head",
    analyses.files_at_head,
    "SELECT file_path, blob_content FROM ref_commits NATURAL JOIN commit_files NATURAL JOIN files "
    "WHERE ref_name = 'HEAD' AND history_index = 0",
)
_add(
    "license_and_readme_blobs",
    analyses.license_and_readme_blobs,
    "SELECT repository_id, blob_content FROM files WHERE file_path = 'LICENSE' OR file_path = 'README.md'",
)
_add(
    "last_commit_messages",
    analyses.last_commit_messages,
    "SELECT commit_message FROM refs NATURAL JOIN commits WHERE ref_name = 'HEAD'",
)
_add(
    "top_repositories_by_contributors",
    analyses.top_repositories_by_contributors,
    "SELECT repository_id, COUNT(DISTINCT commit_author_email) AS contributor_count FROM commits "
    "GROUP BY repository_id ORDER BY contributor_count DESC, repository_id LIMIT 10",
)
_add("approximate_contributors", analyses.approximate_contributors)
_add(
    "license_blobs",
    analyses.license_blobs,
    "SELECT blob_content FROM files WHERE file_path = 'LICENSE'",
)
_add(
    "top_repositories_by_files",
    analyses.top_repositories_by_files,
    "SELECT repository_id, COUNT(*) AS num_files FROM ref_commits NATURAL JOIN commit_files "
    "NATURAL JOIN files WHERE ref_name = 'HEAD' GROUP BY repository_id "
    "ORDER BY num_files DESC, repository_id LIMIT 10",
)
_add(
    "committers_per_repository",
    analyses.committers_per_repository,
    "SELECT commit_author_email AS author, repository_id AS id, count(*) AS num_commits "
    "FROM commits GROUP BY commit_author_email, repository_id",
)
_add(
    "committers",
    analyses.committers,
    "SELECT commit_author_email AS author, count(*) AS num_commits FROM commits GROUP BY commit_author_email",
)

# Training-data operators, where they are installed.

try:
    import codestrata.llm.queries as _llm
    import corpus_pipeline
except ModuleNotFoundError as error:
    # The folder may be left out, and so may what only its operators use.
    if error.name not in (
        "codestrata.llm",
        "codestrata.llm.queries",
        "corpus_pipeline",
        "numpy",
        "tokenizers",
        "xxhash",
        "zstandard",
    ):
        raise
else:
    _QUERIES.update(_llm.QUERIES)
    _ORACLES.update(_llm.ORACLES)
    _QUERIES["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL is not None:
        _ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
