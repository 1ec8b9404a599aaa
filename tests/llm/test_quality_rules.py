import re

from codestrata.llm.quality_rules import (
    POLICIES,
    RULES,
    ablations,
    apply_policy,
    ledger,
    rule_mask,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measured(text):
    text = text or ""
    words = WORD.findall(text)
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = {}
    for triple in triples:
        seen[triple] = seen.get(triple, 0) + 1
    covered = {i + k for i, triple in enumerate(triples) if seen[triple] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(covered),
    )


def test_measurements(docs, odd, rows_of):
    texts = [*odd, (9, "a b c a b c a"), (10, "x y\nx y\n z\nx y"), (11, "# * $ %|<>& !"), (12, "a a a a")]
    found = ledger(docs(texts))
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    expected = sorted(
        ((i, *measured(text)) for i, text in texts), key=lambda row: [(x is not None, x) for x in row]
    )
    assert rows_of(found, *names) == expected


def test_policies_and_ablations(docs, rows_of):
    clean = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    texts = [(1, clean), (2, "short"), (3, "same words " * 40), (4, clean.upper()), (5, clean.replace(" ", " | "))]
    rows = ledger(docs(texts))
    judged = apply_policy(rows, "v2")
    assert rows_of(judged, "doc_id", "base_failed", "kept") == [
        (1, False, True),
        (2, True, False),
        (3, True, False),
        (4, False, False),
        (5, False, False),
    ]
    older = apply_policy(rows, "v1")
    assert dict(rows_of(older, "doc_id", "kept"))[4]  # capitals came with v2
    bits = dict(rows_of(rows, "doc_id", "failed_rules"))
    for row in ablations(rows, "v2").collect():
        bit, mask = 1 << list(RULES).index(row["rule"]), rule_mask(POLICIES["v2"])
        assert row["n_failed"] == sum(b & bit != 0 for b in bits.values())
        assert row["n_failed_alone"] == sum(b & mask == bit for b in bits.values())
        assert row["n_kept_without"] == sum(b & mask & ~bit == 0 for b in bits.values())


def test_empty_table(docs):
    assert apply_policy(ledger(docs([])), "v2").count() == 0


def test_no_python_or_shuffle_in_the_plan(docs):
    plan = apply_policy(ledger(docs([(1, "a")], 1)), "v2")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange") <= 1
