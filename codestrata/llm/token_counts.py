"""Token counts without encoding: most words are proven to be one token beforehand.

``whole_tokens`` runs every string of the vocabulary that can be a whole pre-token
through the model once, on the driver and before any text is read. Those that come
back as their own single token are proven: wherever such a string is a pre-token,
it counts one, and neither merges nor ids are needed. The set has at most as many
strings as the vocabulary and is broadcast.

Texts are cut into pre-tokens as the library does it. Members of the proven set
are counted directly; only the rest is merged by the library's model, each
distinct string once as long as it stays in a table of ``TABLE_WORDS`` strings per
process. A text that holds the string of an added token goes through the library
whole, since such strings are cut out before anything else.

Every text is counted whole, where it lies: no shuffle.

Defined results: a null or empty text has 0 bytes and 0 tokens. Rows are
independent, so null or repeated ids and repeated rows each give their row; an
empty table gives none. Other columns are not read. A file whose pre-tokens the
library does not tell (no pre-tokenizer, or a model that is no BPE) is counted
through the library whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import BPE

from codestrata.llm import token_ids
from codestrata.llm.process import kept_in_process
from codestrata.llm.tables import text_slices

LIMIT = 2048
#: Merged strings kept per process; when full the table starts anew.
TABLE_WORDS = 500_000

_COUNTS = "_id {id}, n_bytes bigint, n_tokens bigint, n_whole bigint"


def whole_tokens(path: str) -> frozenset[str]:
    """Strings, as the model sees pre-tokens, that encode alone as exactly one token."""
    tokenizer = Tokenizer.from_file(path)
    model = tokenizer.model
    if not isinstance(model, BPE) or tokenizer.pre_tokenizer is None or model.dropout:
        return frozenset()
    suffix = model.end_of_word_suffix or ""
    candidates = (
        (string[: len(string) - len(suffix)], number)
        for string, number in tokenizer.get_vocab(with_added_tokens=False).items()
        if string.endswith(suffix)
    )
    return frozenset(
        string for string, number in candidates if string and _ids(model, string) == [number]
    )


def _ids(model: BPE, string: str) -> list[int]:
    return [token.id for token in model.tokenize(string)]


class TokenCounter:
    """Counts tokens of texts with one file and its proven strings."""

    def __init__(self, path: str, whole: frozenset[str]):
        words = token_ids.Encoder(path)
        self.tokenizer, self.model = words.tokenizer, words.model
        self.letters, self.by_word = words.letters, words.by_word
        self.whole = whole
        self.merged: dict[str, int] = {}
        self.plain_merged: dict[str, int] = {}
        bytes_of = {ord(letter): byte for byte, letter in self.letters.items()}
        self.plain_whole = set(_as_text(whole, bytes_of)) if self.by_word else set()
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [token.content for token in added]
        normalizer = self.tokenizer.normalizer
        self.normalize = normalizer.normalize_str if normalizer else str
        splitter = self.tokenizer.pre_tokenizer
        self.split = splitter.pre_tokenize_str if splitter and isinstance(self.model, BPE) else None

    def count(self, text: str) -> tuple[int, int]:
        """Tokens, and pre-tokens among them that were counted directly."""
        if self.split is None or any(content in text for content in self.added):
            return self._by_library(text)
        if not self.by_word:
            return self._part(text)
        parts = [self._part(part) for part in token_ids.segments(text)]
        return sum(n for n, _ in parts), sum(n for _, n in parts)

    def _part(self, text: str) -> tuple[int, int]:
        if self.by_word and token_ids.is_plain(text):
            words = token_ids.PLAIN_WORDS.findall(text.lower())
            rest = [word for word in words if word not in self.plain_whole]
            return self._counted(len(words), rest, self.plain_merged, self._plain_letters)
        normal = self.normalize(text)
        if normal != text and any(content in normal for content in self.added):
            return self._by_library(text)
        words = [word for word, _ in self.split(normal)]
        rest = [word for word in words if word not in self.whole]
        return self._counted(len(words), rest, self.merged, str)

    def _counted(self, n_words: int, rest: list[str], table: dict[str, int], letters) -> tuple[int, int]:
        """``rest`` through ``table``; strings it lacks are merged by the model."""
        n_whole = n_words - len(rest)
        try:
            return n_whole + sum(map(table.__getitem__, rest)), n_whole
        except KeyError:
            if len(table) > TABLE_WORDS:
                table.clear()
            for word in rest:
                if word not in table:
                    table[word] = len(self.model.tokenize(letters(word)))
            return n_whole + sum(map(table.__getitem__, rest)), n_whole

    def _plain_letters(self, word: str) -> str:
        return word.encode().decode("latin-1").translate(self.letters)

    def _by_library(self, text: str) -> tuple[int, int]:
        encoding = self.tokenizer.encode(text, add_special_tokens=False)
        return len(encoding.ids), 0


def _as_text(strings: Iterable[str], bytes_of: dict[int, int]) -> Iterator[str]:
    """Byte-level strings as the text they stand for, where it is text by itself."""
    for string in strings:
        try:
            yield bytes(bytes_of[ord(letter)] for letter in string).decode()
        except (KeyError, UnicodeDecodeError):
            continue


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    limit: int = LIMIT,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``id, n_bytes, n_tokens, n_whole, over_limit`` for every row of ``docs``.

    ``n_whole`` pre-tokens were counted directly; ``over_limit`` tells more than
    ``limit`` tokens.
    """
    proven = docs.sparkSession.sparkContext.broadcast(whole_tokens(tokenizer_path))
    rows = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept_in_process(
            ("token counter", tokenizer_path), lambda: TokenCounter(tokenizer_path, proven.value)
        )
        for batch in text_slices(batches, "_text"):
            texts = batch.column("_text").fill_null("")
            pairs = [counter.count(text.as_py()) for text in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id"),
                    pc.binary_length(texts.cast(pa.large_binary())),
                    pa.array([n for n, _ in pairs], pa.int64()),
                    pa.array([n for _, n in pairs], pa.int64()),
                ],
                names=["_id", "n_bytes", "n_tokens", "n_whole"],
            )

    counted = rows.mapInArrow(count, _COUNTS.format(id=kind))
    return counted.select(
        F.col("_id").alias(id_column),
        "n_bytes",
        "n_tokens",
        "n_whole",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )


def token_counts_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: all documents, more than 2,048 tokens over the limit."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
