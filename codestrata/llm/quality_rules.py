"""Quality rules as a ledger of failure bits.

``ledger`` evaluates every rule once per document and keeps what it measured
together with one bit per failed rule. Policies are versioned sets of rules; they
are applied to the stored bits (``apply_policy``), and what each rule contributes
is a bitwise aggregation of the ledger (``ablations``), so neither reads a text
again.

Everything is a projection of one row: no shuffle, no Python in the tasks. The
cost of a document of n words is that of sorting n numbers.

Defined results: a null text counts as empty, so it has no words and fails
``too_few_words``. Repeated rows get a ledger row each. Other columns of the
input, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"

#: Rule -> condition of failure over the measurements. Bit i belongs to the i-th
#: rule; new rules go to the end so that stored ledgers stay readable.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "many_symbols": "10 * n_symbols > n_words",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
    "short_or_long_words": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
    "capitals": "2 * n_capitals > n_letters",
    "few_letters": "2 * n_letters < word_chars",
    "exclamations": "10 * n_exclamations > 3 * n_words",
}

#: Policy version -> rules it enforces. ``base`` decides ``base_failed``.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("too_few_words", "repeated_words"),
    "v1": ("too_few_words", "repeated_words", "many_symbols", "repeated_lines"),
    "v2": tuple(RULES),
}

MEASUREMENTS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_letters",
    "n_capitals",
    "n_exclamations",
)


def rule_mask(rules) -> int:
    """The bits of ``rules``."""
    names = list(RULES)
    return sum(1 << names.index(rule) for rule in rules)


def ledger(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column``, all ``MEASUREMENTS`` (bigint) and ``failed_rules`` (bigint bits)."""
    rows = docs.select(
        F.col(id_column).alias("_id"), F.coalesce(F.col(text_column), F.lit("")).alias("_text")
    )
    # Each step is a projection of its own: a lambda refers to finished arrays.
    rows = (
        rows.withColumn("_words", F.regexp_extract_all("_text", F.lit(WORD), 0))
        .withColumn("_lines", F.filter(F.split("_text", "\n"), lambda line: line.rlike(WORD)))
        .withColumn("_triples", _triples())
        .withColumn("_sorted", _sorted_if_repeated())
        .withColumn("_repeats", _repeated_starts())
    )
    measured = rows.select(
        F.col("_id"),
        _count(F.size("_words"), "n_words"),
        _count(F.char_length(F.array_join("_words", "")), "word_chars"),
        _count(_characters(r"[#*$%&|<>]+"), "n_symbols"),
        _count(F.size("_lines") - F.size(F.array_distinct("_lines")), "n_dup_lines"),
        _count(F.size(_covered()), "n_repeat_words"),
        _count(F.size("_lines"), "n_lines"),
        _count(_characters(r"\p{L}+"), "n_letters"),
        _count(_characters(r"\p{Lu}+"), "n_capitals"),
        _count(
            F.char_length("_text") - F.char_length(F.replace(F.col("_text"), F.lit("!"), F.lit(""))),
            "n_exclamations",
        ),
    )
    bits = [
        F.when(F.expr(condition), F.lit(1 << bit)).otherwise(F.lit(0)).cast("bigint")
        for bit, condition in enumerate(RULES.values())
    ]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measured.select(
        F.col("_id").alias(id_column), *MEASUREMENTS, failed.alias("failed_rules")
    )


def _count(value: Column, name: str) -> Column:
    return value.cast("bigint").alias(name)


def _characters(runs: str) -> Column:
    """Number of characters in the matches of ``runs``."""
    return F.char_length("_text") - F.char_length(F.regexp_replace("_text", runs, ""))


def _triples() -> Column:
    """Hash of each window of three words, in order."""
    words = F.col("_words")
    starts = F.sequence(F.lit(0), F.size(words) - 3)
    hashes = F.transform(
        starts, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    )
    return F.when(F.size(words) >= 3, hashes).otherwise(F.array().cast("array<bigint>"))


def _sorted_if_repeated() -> Column:
    """Windows with their starts in order of hash; empty if no window comes twice."""
    triples = F.col("_triples")
    pairs = F.transform(triples, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return F.when(
        F.size(F.array_distinct(triples)) < F.size(triples), F.sort_array(pairs)
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))


def _repeated_starts() -> Column:
    """Starts of the windows that come twice: equal windows are neighbours when sorted."""
    ordered = F.col("_sorted")
    none = F.array().cast("array<int>")
    both = F.transform(
        ordered,
        lambda x, k: F.when(
            F.get(ordered, k + 1)["h"] == x["h"], F.array(x["i"], F.get(ordered, k + 1)["i"])
        ).otherwise(none),
    )
    return F.flatten(both)


def _covered() -> Column:
    """Positions of the words in those windows."""
    return F.array_distinct(
        F.flatten(F.transform(F.col("_repeats"), lambda i: F.array(i, i + 1, i + 2)))
    )


def passes(policy: str) -> Column:
    """Whether a ledger row fails none of the rules of ``policy``."""
    return F.col("failed_rules").bitwiseAND(F.lit(rule_mask(POLICIES[policy]))) == 0


def apply_policy(rows: DataFrame, policy: str) -> DataFrame:
    """Ledger rows with ``base_failed`` and ``kept`` under a policy version."""
    return rows.withColumn("base_failed", ~passes("base")).withColumn(
        "kept", passes("base") & passes(policy)
    )


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """One row per rule of ``policy``: what it fails, and what only it fails.

    ``rule, n_failed, n_failed_alone, n_kept_without``. The ledger is first counted
    per bit pattern, of which there are at most two to the number of rules.
    """
    mask = rule_mask(POLICIES[policy])
    patterns = (
        rows.select(F.col("failed_rules").bitwiseAND(F.lit(mask)).alias("bits"))
        .groupBy("bits")
        .agg(F.count("*").alias("n"))
    )
    names = list(RULES)
    rules = F.array(
        *[
            F.struct(F.lit(rule).alias("rule"), F.lit(1 << names.index(rule)).cast("bigint").alias("bit"))
            for rule in POLICIES[policy]
        ]
    )
    each = patterns.withColumn("r", F.explode(rules)).select("bits", "n", "r.rule", "r.bit")
    n = F.col("n")
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, n).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), n).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0, n).otherwise(0)).alias(
            "n_kept_without"
        ),
    )


def quality_of_documents(spark, sf_dir: str) -> DataFrame:
    """The registered query: base measurements and the newest policy's verdict."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return apply_policy(ledger(docs), "v2").select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "failed_rules",
    )


ORACLE_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), starts AS (
  SELECT doc_id, words, unnest(generate_series(1, len(words) - 2)) AS i FROM docs WHERE len(words) >= 3
), triples AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS triple FROM starts
), twice AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, triple) AS n FROM triples) t WHERE n > 1
), repeats AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice CROSS JOIN (VALUES (0), (1), (2)) v(k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs
), line_counts AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), measured AS (
  SELECT d.doc_id,
         CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
         coalesce(n_lines, 0) AS n_lines,
         len(regexp_extract_all(text, '\p{L}')) AS n_letters,
         len(regexp_extract_all(text, '\p{Lu}')) AS n_capitals,
         len(regexp_extract_all(text, '!')) AS n_exclamations
  FROM docs d LEFT JOIN repeats r USING (doc_id) LEFT JOIN line_counts USING (doc_id)
), judged AS (
  SELECT *, CAST(
    CASE WHEN n_words < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
    + CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 16 ELSE 0 END
    + CASE WHEN 2 * n_capitals > n_letters THEN 32 ELSE 0 END
    + CASE WHEN 2 * n_letters < word_chars THEN 64 ELSE 0 END
    + CASE WHEN 10 * n_exclamations > 3 * n_words THEN 128 ELSE 0 END AS BIGINT) AS failed_rules
  FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       failed_rules = 0 AS kept, failed_rules
FROM judged
"""
