import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs(spark):
    """``docs([(id, text), ...])`` as a table like ``documents``, with clashing extra columns."""

    def make(rows, partitions=3):
        full = [
            (i, text, "en", None if i is None else f"s{i % 3}", None if text is None else len(text))
            for i, text in rows
        ]
        df = spark.createDataFrame(full, SCHEMA).repartition(partitions)
        return df.selectExpr(
            "*", "'x' AS n_words", "'x' AS kept", "'x' AS score", "'x' AS copy", "'x' AS node", "'x' AS held_out"
        )

    return make


@pytest.fixture
def rows_of():
    def collect(df, *columns):
        return sorted(
            (tuple(row[c] for c in columns) for row in df.collect()),
            key=lambda row: [(x is not None, x) for x in row],
        )

    return collect


ODD = [
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, "one"),
    (4, "one"),
    (None, "no id at all"),
    (5, "Ünïcode “quotes” — ß 中文 😀 12 ½ x y"),
    (6, "word " * 30_000),
    (7, "x" * 200_000),
    (8, "a\n\n\nb\r\nc\x0bd\x0ce"),
]


@pytest.fixture
def odd():
    """Nulls, empty and very long texts, repeated rows, a null id."""
    return list(ODD)
