import math

import pytest

from codestrata.llm import mixing
from codestrata.llm.mixing import mix_sources, poisson_thresholds, repetition_rates


def test_thresholds():
    for rate in (0.01, 0.5, 1.0, 3.0, 40.0, 900.0):
        values = poisson_thresholds(rate)
        assert values[0] == pytest.approx(math.exp(-rate), rel=1e-9)
        assert all(a <= b for a, b in zip(values, values[1:])) and values[-1] == pytest.approx(1, abs=1e-9)
        mean = sum(1 - value for value in values)
        assert mean == pytest.approx(rate, rel=1e-6)
    assert poisson_thresholds(0) == []


def test_rates_reach_targets(docs):
    table = docs([(i, "x" * (100 if i % 3 == 0 else 10)) for i in range(300)])
    rates = {row["_source"]: row["rate"] for row in repetition_rates(table, {"s0": 1, "s1": 1, "s2": 2}).collect()}
    sizes = {"s0": 10_000, "s1": 1000, "s2": 1000}
    total = sum(sizes.values())
    assert rates == pytest.approx({"s0": total / 4 / 10_000, "s1": total / 4 / 1000, "s2": total / 2 / 1000})


def test_copies(docs, rows_of, monkeypatch):
    texts = [(i, f"text {i}") for i in range(600)]
    table = docs(texts)
    found = mix_sources(table, {"s0": 8, "s1": 1, "s2": 0})
    rows = found.collect()
    assert found.columns == [*(c for c in table.columns if c != "copy"), "copy", "shuffle_key"]
    counts = {}
    for row in rows:
        assert row["text"] == f"text {row['doc_id']}"
        counts.setdefault(row["doc_id"], []).append(row["copy"])
    assert all(sorted(own) == list(range(1, len(own) + 1)) for own in counts.values())
    by_source = [sum(len(own) for i, own in counts.items() if i % 3 == k) for k in range(3)]
    assert by_source[2] == 0 and by_source[0] == pytest.approx(600 * 8 / 9, rel=0.15)
    assert {i for i in counts if counts[i] == []} == set()
    order = [row["shuffle_key"] for row in mix_sources(table.coalesce(1), {"s0": 8, "s1": 1, "s2": 0}).coalesce(1).collect()]
    assert sorted(order) == sorted(row["shuffle_key"] for row in rows)
    # The way for very many sources gives the same rows.
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    salted = mix_sources(table, {"s0": 8, "s1": 1, "s2": 0})
    assert rows_of(salted, "doc_id", "copy") == rows_of(found, "doc_id", "copy")


def test_odd_rows(docs, odd):
    rows = mix_sources(docs(odd)).collect()
    own = [row["copy"] for row in rows if row["doc_id"] == 4]
    assert len(own) % 2 == 0  # equal rows draw the same number
    assert mix_sources(docs([])).count() == 0
    assert mix_sources(docs([(1, None), (2, "")])).count() >= 0
