"""Subword lattice language model: a text's probability over all its segmentations.

The pieces of an existing vocabulary file, with its own scores to begin with, are
drawn independently; a text is its words (after a word mark each) and one end. The
probability of a word is the sum over every segmentation into pieces, by forward
recursion in logarithms; a character may always be spelled by its byte pieces, so
no word is impossible. The probability of a text is the product over its words and
the end.

Learning goes over all training texts: they become a table of distinct words with
counts, and ``ROUNDS`` steps of expectation maximisation (forward and backward over
each distinct word, weighted by its count) re-estimate the pieces. Sums per piece
are bounded by the vocabulary and are all that reaches the driver, with the total
numbers of tokens and words.

Scoring: texts are dealt to blocks of about ``BLOCK_BYTES``; each block asks once
for every distinct word it has, the answers (count and probability) come back to
the block by joins on the word and the block, and the block adds them up. A word
in every text is asked for once per block, so no word makes a hot key. No table of
words is broadcast or collected.

Defined results: a null text is empty and has the end alone. A-Z are folded. Rows
are independent, so equal rows get equal scores; extra columns are not read.
Without any training text all counts are 0 and the file's scores stay.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm.process import kept_in_process
from codestrata.llm.samples import fold
from codestrata.llm.tables import blocks_of, stored, text_slices
from codestrata.llm.word_hashes import mix

ROUNDS = 2
SMOOTHING = 0.1
BLOCK_BYTES = 8 << 20
FLUSH_WORDS = 300_000
CHUNK = 4096
LONG_WORD = 64
WORD_MARK = "▁"
_NEVER = -1e30
_SLOT_BITS = 20


class Pieces(NamedTuple):
    """The vocabulary, prepared to look up many character sequences at once."""

    longest: int
    bytes_at: np.ndarray  # number of the piece that spells each byte
    tables: tuple[Table, Table]
    by_text: dict[str, int]
    count: int


class Vocabulary(NamedTuple):
    path: str
    weights: np.ndarray  # natural logarithms, one per piece; the last is the end


def _character_codes(codes: np.ndarray) -> np.ndarray:
    return mix(codes.astype(np.uint64) + np.uint64(0x51ED270B))


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, size: int) -> np.ndarray:
    values = np.full(size, base, np.uint64)
    values[:1] = 1
    return np.multiply.accumulate(values)


def _load(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def pieces_of(path: str) -> Pieces:
    """One prepared vocabulary per process and file."""
    return kept_in_process(("pieces", path), lambda: _prepare(path))


def _prepare(path: str) -> Pieces:
    model = _load(path)
    size = model.get_piece_size()
    bytes_at = np.full(256, -1)
    texts, numbers = [], []
    for number in range(size):
        if model.is_byte(number):
            bytes_at[int(model.id_to_piece(number)[3:-1], 16)] = number
        elif not (model.is_control(number) or model.is_unknown(number) or model.is_unused(number)):
            texts.append(model.id_to_piece(number))
            numbers.append(number)
    if (bytes_at < 0).any():
        raise ValueError(f"{path}: not every byte has a piece")
    hashes = np.array([_hash_text(text) for text in texts], np.uint64)
    tables = next(filter(None, (_tables(hashes, numbers, salt) for salt in range(64))))
    by_text = dict(zip(texts, numbers, strict=True))
    return Pieces(max(map(len, texts), default=1), bytes_at, tables, by_text, size)


class Table(NamedTuple):
    factor: np.uint64
    hashes: np.ndarray
    numbers: np.ndarray

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes * self.factor) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)


def _tables(hashes: np.ndarray, numbers: list[int], salt: int) -> tuple[Table, Table] | None:
    """Each hash in its slot of the first table or, if that is taken, of the second."""
    factors = mix(np.array([2 * salt + 1, 2 * salt + 2], np.uint64)) | np.uint64(1)
    rest, values, tables = hashes, np.array(numbers), []
    for factor in factors:
        table = Table(factor, np.zeros(1 << _SLOT_BITS, np.uint64), np.full(1 << _SLOT_BITS, -1))
        slots, first = np.unique(table.slots(rest), return_index=True)
        table.hashes[slots], table.numbers[slots] = rest[first], values[first]
        left = np.ones(len(rest), bool)
        left[first] = False
        rest, values = rest[left], values[left]
        tables.append(table)
    return None if len(rest) else (tables[0], tables[1])


def _hash_text(text: str) -> int:
    codes = _character_codes(np.array([ord(x) for x in text]))
    return int(mix((codes * _powers(_BASE, len(codes))).sum(keepdims=True, dtype=np.uint64))[0])


def file_weights(path: str) -> np.ndarray:
    """Logarithms of probabilities from the file's scores; the end gets one of a frequent piece.

    Scores that are logarithms are used as they are. A file made by merging has
    ranks instead; those become probabilities that fall with the rank.
    """
    model = _load(path)
    scores = np.array([model.get_score(number) for number in range(model.get_piece_size())])
    if (scores == np.round(scores)).all():
        scores = -np.log(2.0 + np.maximum(0.0, -scores))
    weights = np.append(scores, scores.max())
    return weights - np.log(np.exp(weights).sum())


class Lattice:
    """The lattices of words of one length, a row each."""

    def __init__(self, pieces: Pieces, weights: np.ndarray, words: list[str]):
        self.pieces, self.weights = pieces, weights
        text = "".join(WORD_MARK + word for word in words)
        self.codes = np.frombuffer(text.encode("utf-32-le"), "<u4").reshape(len(words), -1).T
        self.length = len(self.codes)
        hashed = _character_codes(self.codes) * _powers(_BASE, self.length)[:, None]
        self.sums = np.zeros((self.length + 1, len(words)), np.uint64)
        np.cumsum(hashed, axis=0, out=self.sums[1:])
        self.inverse = _powers(_INVERSE, self.length)
        self.spelled = self._spelled()
        self.edges = self._edges()

    def _bytes(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers of the byte pieces of each character, byte after byte, and which have one."""
        codes = self.codes
        size = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])
        for place in range(int(size.max(initial=0))):
            shift = 6 * (size - 1 - place)
            value = np.where(place == 0, (codes >> np.maximum(shift, 0)) | lead[size], 0x80 | ((codes >> np.maximum(shift, 0)) & 0x3F))
            yield self.pieces.bytes_at[np.minimum(value, 255)], size > place

    def _spelled(self) -> np.ndarray:
        return sum(np.where(has, self.weights[number], 0.0) for number, has in self._bytes())

    def _piece(self, begin: int, end: int) -> np.ndarray:
        """Number of the piece that is characters begin:end of each word, or -1."""
        value = mix((self.sums[end] - self.sums[begin]) * self.inverse[begin])
        number = np.full(len(value), -1)
        for table in self.pieces.tables:
            slot = table.slots(value)
            # Most character sequences are no piece.
            found = np.flatnonzero(table.hashes[slot] == value)
            number[found] = table.numbers[slot[found]]
        return number

    def _edges(self) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
        """For each end the begins, pieces and weights of what ends there in any word."""
        out: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[]]
        for end in range(1, self.length + 1):
            out.append([])
            for begin in range(max(0, end - self.pieces.longest), end):
                number = self._piece(begin, end)
                has = number >= 0
                if has.any():
                    out[end].append((begin, number, np.where(has, self.weights[number], _NEVER)))
        return out

    def forward(self) -> np.ndarray:
        """Logarithm of the summed probability of each prefix, a row per length."""
        ahead = np.full((self.length + 1, self.codes.shape[1]), _NEVER)
        ahead[0] = 0
        for end in range(1, self.length + 1):
            terms = [ahead[end - 1] + self.spelled[end - 1]]
            terms += [ahead[begin] + weight for begin, _, weight in self.edges[end]]
            ahead[end] = _log_sum(terms)
        return ahead

    def expected(self, times: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over all segmentations, words weighted by ``times``."""
        ahead = self.forward()
        back = np.full(ahead.shape, _NEVER)
        back[-1] = 0
        total, uses = ahead[-1], np.zeros(self.pieces.count)
        by_begin: dict[int, list] = {}
        for end, edges in enumerate(self.edges):
            for begin, _, weight in edges:
                by_begin.setdefault(begin, []).append((end, weight))
        for begin in range(self.length - 1, -1, -1):
            terms = [back[begin + 1] + self.spelled[begin]]
            terms += [back[end] + weight for end, weight in by_begin.get(begin, [])]
            back[begin] = _log_sum(terms)
        for end, edges in enumerate(self.edges):
            for begin, number, weight in edges:
                has = number >= 0
                share = np.exp((ahead[begin] + weight + back[end] - total)[has]) * times[has]
                np.add.at(uses, number[has], share)
        spelled = np.exp(ahead[:-1] + self.spelled + back[1:] - total) * times
        for number, has in self._bytes():
            uses += np.bincount(number[has], spelled[has], self.pieces.count)
        return uses


def _log_sum(terms: list[np.ndarray]) -> np.ndarray:
    if len(terms) == 1:
        return terms[0]
    stacked = np.stack(terms)
    most = stacked.max(0)
    return most + np.log(np.exp(stacked - most).sum(0))


class LongWord:
    """The lattice of one word of many characters, position by position."""

    def __init__(self, pieces: Pieces, weights: np.ndarray, word: str):
        text = WORD_MARK + word
        self.pieces, self.length = pieces, len(text)
        self.spelling = [[int(pieces.bytes_at[byte]) for byte in x.encode()] for x in text]
        self.spelled = [float(weights[numbers].sum()) for numbers in self.spelling]
        self.edges: list[list[tuple[int, int, float]]] = [[] for _ in range(self.length + 1)]
        for begin in range(self.length):
            for end in range(begin + 1, min(self.length, begin + pieces.longest) + 1):
                number = pieces.by_text.get(text[begin:end])
                if number is not None:
                    self.edges[end].append((begin, number, float(weights[number])))

    def forward(self) -> list[float]:
        ahead = [0.0]
        for end in range(1, self.length + 1):
            terms = [ahead[-1] + self.spelled[end - 1]]
            terms += [ahead[begin] + weight for begin, _, weight in self.edges[end]]
            most = max(terms)
            ahead.append(most + math.log(sum(math.exp(x - most) for x in terms)))
        return ahead

    def expected(self, times: float) -> np.ndarray:
        ahead, uses = self.forward(), np.zeros(self.pieces.count)
        back: list[list[float]] = [[] for _ in range(self.length)] + [[0.0]]
        for end in range(self.length, 0, -1):
            most = max(back[end])
            after = most + math.log(sum(math.exp(x - most) for x in back[end]))
            back[end - 1].append(after + self.spelled[end - 1])
            share = times * math.exp(ahead[end - 1] + self.spelled[end - 1] + after - ahead[-1])
            for number in self.spelling[end - 1]:
                uses[number] += share
            for begin, number, weight in self.edges[end]:
                back[begin].append(after + weight)
                uses[number] += times * math.exp(ahead[begin] + weight + after - ahead[-1])
        return uses


def _by_length(words: list[str]) -> Iterator[np.ndarray]:
    """Places of words of equal length, at most ``CHUNK`` together; long words are left out."""
    lengths = np.array([len(word) for word in words], np.int64)
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] <= LONG_WORD]
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for group in np.split(order, cuts):
        for begin in range(0, len(group), CHUNK):
            yield group[begin : begin + CHUNK]


def word_scores(vocabulary: Vocabulary, words: list[str]) -> np.ndarray:
    """Natural logarithm of the probability of each word."""
    pieces, out = pieces_of(vocabulary.path), np.zeros(len(words))
    for group in _by_length(words):
        out[group] = Lattice(pieces, vocabulary.weights, [words[i] for i in group]).forward()[-1]
    for place, word in enumerate(words):
        if len(word) > LONG_WORD:
            out[place] = LongWord(pieces, vocabulary.weights, word).forward()[-1]
    return out


def word_table(docs: DataFrame, trains: Column, text_column: str) -> DataFrame:
    """``word, n``: every distinct word, and how often training texts have it."""
    rows = docs.select(F.col(text_column).alias("_text"), trains.alias("_trains"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        others: set[bytes] = set()
        for batch in text_slices(batches, "_text"):
            for text, learn in zip(batch.column("_text"), batch.column("_trains").to_pylist(), strict=True):
                words = (text.as_py() or "").encode().lower().split()
                if learn:
                    counts.update(words)
                else:
                    others.update(words)
            if len(counts) + len(others) > FLUSH_WORDS:
                yield _word_rows(counts, others)
                counts, others = Counter(), set()
        yield _word_rows(counts, others)

    return rows.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _word_rows(counts: Counter, others: set[bytes]) -> pa.RecordBatch:
    only = [word for word in others if word not in counts]
    words = pa.array([*counts, *only], pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays(
        [words, pa.array([*counts.values(), *[0] * len(only)], pa.int64())], names=["word", "n"]
    )


def learn(words: DataFrame, n_texts: int, path: str, rounds: int = ROUNDS) -> Vocabulary:
    """Weights of the pieces after ``rounds`` of expectation maximisation over ``words``."""
    vocabulary = Vocabulary(path, file_weights(path))
    seen = words.where("n > 0")
    for _ in range(rounds if n_texts else 0):
        sums = _expected_uses(seen, vocabulary).collect()
        uses = np.full(len(vocabulary.weights), SMOOTHING)
        for row in sums:
            uses[row["piece"]] += row["uses"]
        uses[-1] += n_texts
        vocabulary = Vocabulary(path, np.log(uses / uses.sum()))
    return vocabulary


def _expected_uses(words: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``piece, uses``, a row per piece that is used at all."""

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(vocabulary.path)
        uses = np.zeros(pieces.count)
        for batch in batches:
            texts, times = batch.column("word").to_pylist(), batch.column("n").to_numpy().astype(float)
            for group in _by_length(texts):
                lattice = Lattice(pieces, vocabulary.weights, [texts[i] for i in group])
                uses += lattice.expected(times[group])
            for text, number in zip(texts, times, strict=True):
                if len(text) > LONG_WORD:
                    uses += LongWord(pieces, vocabulary.weights, text).expected(number)
        used = np.flatnonzero(uses)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(uses[used])], names=["piece", "uses"]
        )

    found = words.select("word", "n").mapInArrow(expect, "piece int, uses double")
    return found.groupBy("piece").agg(F.sum("uses").alias("uses"))


def score_texts(
    docs: DataFrame,
    held_out: Column,
    vocabulary_path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Rows that are not ``held_out`` are learned from. Scores are base-10 logarithms;
    ``base_score`` is that of single words with one added to every count.
    """
    words = stored(word_table(docs, ~held_out, text_column), "lm-words")
    n_texts = docs.where(~held_out).count()
    total, distinct = words.agg(F.sum("n"), F.count_if(F.col("n") > 0)).first()
    n_train = (total or 0) + n_texts
    below = n_train + distinct + (n_texts > 0) + 1
    vocabulary = learn(words, n_texts, vocabulary_path)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = word_scores(vocabulary, batch.column("word").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), batch.column("n"), pa.array(scores / math.log(10))],
                names=["word", "n", "score"],
            )

    scored = words.mapInArrow(look_up, "word string, n bigint, score double")
    blocks = blocks_of(docs, text_column, BLOCK_BYTES)
    rows = docs.select(
        F.pmod(F.xxhash64(id_column, text_column), F.lit(blocks)).alias("_block"),
        F.col(id_column).alias("_id"),
        held_out.alias("_held_out"),
        F.coalesce(F.col(text_column), F.lit("")).alias("_text"),
    )

    def asked(key, table):
        found: set[bytes] = set()
        for text in table.column("_text"):
            found.update(text.as_py().encode().lower().split())
        words = pa.array(list(found), pa.binary()).cast(pa.string())
        return pa.table([pa.array([key[0].as_py()] * len(words), pa.int64()), words], names=["_block", "word"])

    end = (math.log10((n_texts + 1) / below), float(vocabulary.weights[-1]) / math.log(10))

    def add_up(table, answers):
        place = {word: i for i, word in enumerate(answers.column("word").cast(pa.binary()).to_pylist())}
        counts = answers.column("n").to_numpy()
        base = np.log10((counts + 1) / below)
        known, lattice = counts > 0, answers.column("score").to_numpy()
        out: list[list] = [[], [], [], []]
        for text in table.column("_text"):
            words = text.as_py().encode().lower().split()
            at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
            out[0].append(len(words) + 1)
            out[1].append(int(known[at].sum()) + (n_texts > 0))
            out[2].append(float(base[at].sum()) + end[0])
            out[3].append(float(lattice[at].sum()) + end[1])
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
        arrays = [pa.array(values, kind) for values, kind in zip(out, kinds, strict=True)]
        return pa.table(
            [table.column("_id"), table.column("_held_out"), *arrays],
            names=["_id", "_held_out", "n_tokens", "n_known", "base_score", "score"],
        )

    requests = rows.groupBy("_block").applyInArrow(asked, "_block bigint, word string")
    answers = requests.join(scored, "word").select("_block", "word", "n", "score")
    kind = rows.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, _held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    summed = rows.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(add_up, schema)
    return summed.select(
        F.col("_id").alias(id_column),
        F.col("_held_out").alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(n_train).cast("bigint").alias("train_tokens"),
        "base_score",
        "score",
    )


def scores_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: learns from six folds of seven, scores all."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_texts(docs, fold("doc_id", 7) == 2, public_tokenizers.path("piece_bpe_32k.model"))
