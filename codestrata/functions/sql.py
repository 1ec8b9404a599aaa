"""The code functions of the SQL surface: LANGUAGE, ARRAY_LENGTH and UAST."""

from __future__ import annotations

import weakref

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from codestrata.functions import paths, trees
from codestrata.functions.language import language_sql

_NO_QUERY = ""

# Sessions that have the functions.
_registered: weakref.WeakSet[SparkSession] = weakref.WeakSet()


def _uast(content: pd.Series, lang: pd.Series, query: pd.Series = None) -> pd.Series:
    """JSON array of the nodes selected (the whole tree without a query), as bytes.

    NULL when the text has no tree. Copies within a batch are parsed once.
    """
    known: dict = {}
    queries = [_NO_QUERY] * len(content) if query is None else query
    out = []
    for key in zip(content, lang, queries, strict=True):
        if key not in known:
            known[key] = _uast_of(*key)
        out.append(known[key])
    return pd.Series(out, dtype=object)


def _uast_of(content, lang, query) -> bytes | None:
    tree = trees.parse(content, lang)
    if tree is None or query is None:
        return None
    roots = paths.matches(tree, query) if query else [0]
    return trees.render(tree, roots).encode()


def _uast_function():
    # Parsing is costly: declared so, Spark neither repeats it nor moves it
    # below joins and filters that leave fewer texts.
    return F.pandas_udf(_uast, "binary").asNondeterministic()


def uast(content: Column, lang: Column, query: str | None = None) -> Column:
    """Tree of each text as JSON bytes; use on distinct blobs."""
    function = _uast_function()
    arguments = [content.cast("binary"), lang]
    return function(*arguments) if query is None else function(*arguments, F.lit(query))


def register_functions(spark: SparkSession) -> None:
    if spark in _registered:
        return
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION language(path STRING, content STRING) "
        f"RETURNS STRING RETURN {language_sql('path', 'content')}"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION array_length(x STRING) "
        "RETURNS INT RETURN json_array_length(x)"
    )
    spark.udf.register("uast", _uast_function())
    _registered.add(spark)
