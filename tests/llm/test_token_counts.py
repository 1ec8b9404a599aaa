import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from codestrata.llm import token_counts
from codestrata.llm.token_counts import TokenCounter, count_tokens, token_counts_of_documents, whole_tokens

SF = "/root/testdata/sf0.001"
FILES = ("word_bpe_49k.json", "byte_bpe_50k.json")
COUNTERS, LIBRARY = {}, {}


@pytest.fixture(scope="module", autouse=True)
def counters():
    for name in FILES:
        path = public_tokenizers.path(name)
        LIBRARY[name] = Tokenizer.from_file(path)
        COUNTERS[name] = TokenCounter(path, whole_tokens(path))


def expected(name, text):
    return len(LIBRARY[name].encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("name", FILES)
def test_proof(name):
    whole = whole_tokens(public_tokenizers.path(name))
    assert len(whole) > 30_000
    for string in sorted(whole)[::997]:
        assert len(LIBRARY[name].model.tokenize(string)) == 1


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aAbestr  \n'0<|>É")), max_size=60))
def test_any_text(text):
    for name in FILES:
        assert COUNTERS[name].count(text)[0] == expected(name, text)


@pytest.mark.parametrize("name", FILES)
def test_special_strings_and_long_texts(name):
    for text in (
        "a <|endoftext|>b<|STARTOFTEXT|> x",
        "İstanbul's ß 12 中 ΑΣ Σ \x00 \x85 é x́ ﬁ",
        "the quick brown fox " * 80_000,
        "x" * 50_000,
        " " * 3000 + "a" + "\n" * 3000,
    ):
        assert COUNTERS[name].count(text)[0] == expected(name, text)


def test_small_table(monkeypatch):
    monkeypatch.setattr(token_counts, "TABLE_WORDS", 3)
    path = public_tokenizers.path(FILES[0])
    counter = TokenCounter(path, whole_tokens(path))
    for text in ("qzxv wjkq vvbn zzxq qwzj", "ünqz 中文字 qzxv", "qzxv"):
        assert counter.count(text)[0] == expected(FILES[0], text)


def test_whole_words_are_counted_directly():
    assert COUNTERS[FILES[0]].count("The hello of the world") == (5, 5)
    assert COUNTERS[FILES[0]].count("The qzxvwjk")[1] == 1


def test_odd_rows(spark, docs, odd, rows_of):
    found = count_tokens(docs(odd), public_tokenizers.path(FILES[0]), limit=10)
    assert rows_of(found, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(
        (
            (i, len((t or "").encode()), expected(FILES[0], t or ""), expected(FILES[0], t or "") > 10)
            for i, t in odd
        ),
        key=lambda row: [(x is not None, x) for x in row],
    )
    assert count_tokens(docs([]), public_tokenizers.path(FILES[0])).count() == 0


def test_query_against_the_library(spark):
    texts = {row.doc_id: row.text or "" for row in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = token_counts_of_documents(spark, SF).collect()
    assert len(rows) == len(texts)
    for row in rows:
        n = expected(FILES[0], texts[row.doc_id])
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len(texts[row.doc_id].encode()), n, n > 2048)
