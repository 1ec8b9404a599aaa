"""Toxicity with a subsequence-string-kernel support vector machine.

Units are the letters of each word of a text, in lower case, with marks for the
word's ends, and the beginnings ("stems") of longer words, since insults take
endings; a longer unit is looked at in overlapping windows of ``UNIT_CHARS``.
Signs and digits inside a word are tried left out, as an unknown character, and as
the letter they look like; three or more single letters in a row make one unit. Two
units are compared by the subsequence kernel of order ``ORDER``: it counts common
subsequences of that many characters and multiplies by ``DECAY`` for every character
they span, so an insult keeps most of its similarity when characters are put in or a
gap is left. The kernel is normalised and approximated with Nystroem landmarks; on
those features linear support vector machines are trained in numpy, with disguised
copies of the insults into which up to ``INSERTIONS`` characters were put, or of which
one was dropped, repeated or hidden. As the kernel is a sum over subsequences, all landmarks
together become one weight per subsequence for scoring (``Margin``).

Labels are given per document. A unit counts as toxic if it is in far more toxic
documents than chance gives and its rate in toxic documents is surely ``LEANING``
times that in clean ones; it is *sure* if that rate is surely ``SURE`` times as high.
Of units that begin alike the shortest stands for those it explains. Units of the
other documents are examples of the rest, with those the machine mistakes, found
among all units of the sample, added in rounds. One machine learns the sure units,
one all toxic ones.

A document's features are the highest margin of the first machine, and of the units
that one leaves alone the highest margin of the second and the number above
``FOUND``. So one sure insult decides in a text of any length, and weaker signs must
add up. A logistic fit on a part of the sample that gave no examples turns them into
the score; new disguised copies of the sure insults, as if each were all that a text
has, count as half of its toxic documents. There each class weighs what it has among
all labels, so a score of 0.5 means the same whether or not the sample was cut.

Learning uses at most ``SAMPLE_TOXIC`` and ``SAMPLE_CLEAN`` labelled documents, and of
their units at most ``TOXIC_UNITS``, ``CLEAN_UNITS`` and, per round, ``MISTAKEN_UNITS``: a
part of the corpus that does not grow with it. Scoring reads every text whole,
where it lies: no shuffle. Margins are computed once per distinct unit and kept in
the worker, up to ``TABLE_UNITS``.

Defined results: null and empty texts, and texts without units, get the score of
a document in which nothing was found. Without examples of both labels every score
is the share of toxic labels. Rows are independent; extra columns are not read.
"""

from __future__ import annotations

import itertools
import math
import re
import uuid
import warnings
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm.process import kept_in_process
from codestrata.llm.samples import fold, sample_rows
from codestrata.llm.tables import stored, text_slices
from codestrata.llm.word_hashes import words_of

ORDER = 3
DECAY = 0.6
UNIT_CHARS = 16
UNIT_STEP = 8
SAMPLE_TOXIC = 3000
SAMPLE_CLEAN = 20_000
STEMS = range(4, 9)
CHANCE = 1e-5
LEANING = 5.0
SURE = 100.0
DOUBT = 0.05
EXPLAINED = 0.9
INSERTIONS = 3
FOUND = 0.5
MOST = 2.0
FEATURES = 5
TOXIC_UNITS = 400
CLEAN_UNITS = 3000
MISTAKEN_UNITS = 1000
TOXIC_LANDMARKS = 96
CLEAN_LANDMARKS = 48
LANDMARK_POOL = 1000
COPIES = 3
MINING_ROUNDS = 3
RIDGE = 1e-5
TABLE_UNITS = 2_000_000
CHUNK = 4096
DENSE_CODES = 1 << 20

_NO_LETTER = re.compile(r"[\W\d_]+")
_LETTER = re.compile(r"^[^\W\d_]$")
_BEGIN, _END, _UNKNOWN = "\2", "\3", "\4"

# Letters that digits and signs stand for.
_LOOKS_LIKE = str.maketrans({
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "i", "+": "t", "\u20ac": "e",
})


class Margin(NamedTuple):
    """A weighted sum of normalised kernel values as a weight per subsequence."""

    alphabet: np.ndarray  # sorted characters of the landmarks
    codes: np.ndarray  # sorted subsequences, as numbers to the base len(alphabet) + 1
    weights: np.ndarray
    bias: float


class Model(NamedTuple):
    name: str
    sure: Margin | None
    leaning: Margin | None
    stems: tuple[int, ...]  # lengths of word beginnings to look at
    logistic: np.ndarray  # on ``document_features``
    prior: float


def unit(word: bytes) -> str:
    """The letters of a word in lower case."""
    return _NO_LETTER.sub("", word.decode("utf-8", "replace").lower())


def readings(word: bytes) -> list[str]:
    """The word's letters; with signs or digits inside also what those may hide."""
    plain = unit(word)
    text = word.decode("utf-8", "replace").lower()
    if plain == text:
        return [plain]
    core = text.strip("!?.,;:\"'()[]{}<>-\u2013\u2014\u201e\u201c\u201d\u00ab\u00bb\u2026")
    hidden = _NO_LETTER.sub(_UNKNOWN, core)
    alike = _NO_LETTER.sub("", core.translate(_LOOKS_LIKE))
    return [x for x in dict.fromkeys([plain, hidden, alike]) if x.strip(_UNKNOWN)]


def marked(text_unit: str) -> str:
    """With marks for its beginning and end, which count as characters of the kernel."""
    return f"{_BEGIN}{text_unit}{_END}"


def stems_of(text_unit: str, lengths) -> list[str]:
    """The unit's proper beginnings of the given lengths, open at the end."""
    return [_BEGIN + text_unit[:n] for n in lengths if n < len(text_unit)]


def _codes(units: list[str]) -> np.ndarray:
    """Characters as numbers, a row per unit, 0 after the end."""
    width = max(map(len, units), default=1) or 1
    text = "".join(x.ljust(width, "\0") for x in units)
    return np.frombuffer(text.encode("utf-32-le"), "<u4").reshape(len(units), width).astype(np.int32)


def _own_kernel(units: list[str]) -> np.ndarray:
    """Kernel of each unit with itself."""
    codes = _codes(units).T
    width, number = codes.shape
    tails = np.zeros((ORDER, width + 1, number), np.float32)
    tails[0] = 1
    total = np.zeros(number, np.float32)
    for i in range(width):
        same = ((codes == codes[i]) & (codes[i] != 0)).astype(np.float32)
        total += DECAY * DECAY * (tails[ORDER - 1][:-1] * same).sum(0)
        live = codes[i] != 0
        for order in range(ORDER - 1, 0, -1):
            run = np.zeros(number, np.float32)
            lower, own = tails[order - 1], tails[order]
            own *= np.where(live, DECAY, 1)
            for j in range(width):
                run = DECAY * (run + DECAY * same[j] * lower[j])
                own[j + 1] += run
    return total


def _subsequences(landmarks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Alphabet, sorted subsequences as numbers, and a row per subsequence with its weight in each landmark."""
    alphabet = np.unique(_codes(landmarks))
    alphabet = alphabet[alphabet > 0]
    base, found = len(alphabet) + 1, {}
    for column, landmark in enumerate(landmarks):
        letters = np.searchsorted(alphabet, [ord(x) for x in landmark]) + 1
        for places in itertools.combinations(range(len(letters)), ORDER):
            code = 0
            for place in places:
                code = code * base + int(letters[place])
            own = found.setdefault(code, {})
            own[column] = own.get(column, 0.0) + DECAY ** (places[-1] - places[0] + 1)
    codes = np.array(sorted(found), np.int64)
    weights = np.zeros((len(codes), len(landmarks)), np.float32)
    for row, code in enumerate(codes.tolist()):
        for column, weight in found[code].items():
            weights[row, column] = weight
    return alphabet, codes, weights


def _by_length(units: list[str]) -> Iterator[np.ndarray]:
    """Places of the units long enough, like lengths together, so little padding is computed."""
    lengths = np.array([len(x) for x in units], np.int64)
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] >= ORDER]
    for begin in range(0, len(order), CHUNK):
        yield order[begin : begin + CHUNK]


def _letters(alphabet: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Characters as places in ``alphabet`` from 1; 0 for others."""
    place = np.minimum(np.searchsorted(alphabet, codes), len(alphabet) - 1)
    return np.where(alphabet[place] == codes, place + 1, 0)


def similarities(units: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernel, a row per unit; 0 for units too short for the order."""
    out = np.zeros((len(units), len(landmarks)), np.float32)
    if not landmarks or not units:
        return out
    alphabet, known, weights = _subsequences(landmarks)
    base = len(alphabet) + 1
    if not len(known):
        return out
    own_landmarks = np.sqrt(np.maximum(_own_kernel(landmarks), 1e-12))
    for rows in _by_length(units):
        some = [units[i] for i in rows]
        letters = _letters(alphabet, _codes(some).T).astype(np.int64)
        total = np.zeros((len(rows), len(landmarks)), np.float32)
        for places in itertools.combinations(range(len(letters)), ORDER):
            code = letters[places[0]]
            for place in places[1:]:
                code = code * base + letters[place]
            at = np.minimum(np.searchsorted(known, code), len(known) - 1)
            same = np.flatnonzero(known[at] == code)
            total[same] += np.float32(DECAY ** (places[-1] - places[0] + 1)) * weights[at[same]]
        own = np.sqrt(np.maximum(_own_kernel(some), 1e-12))
        out[rows] = total / own[:, None] / own_landmarks[None, :]
    return out


def margin_of(landmarks: list[str], weights: np.ndarray, bias: float) -> Margin:
    """``similarities(units, landmarks) @ weights + bias``, prepared for many units."""
    alphabet, codes, parts = _subsequences(landmarks)
    scale = np.asarray(weights) / np.sqrt(np.maximum(_own_kernel(landmarks), 1e-12))
    return Margin(alphabet, codes, (parts @ scale).astype(np.float32), bias)


def margins_of(margin: Margin, units: list[str]) -> np.ndarray:
    """The margin of each unit: its subsequences' weights over its own norm."""
    out = np.full(len(units), margin.bias, np.float32)
    base = len(margin.alphabet) + 1
    dense = None
    if base**ORDER <= DENSE_CODES:
        dense = np.zeros(base**ORDER, np.float32)
        dense[margin.codes] = margin.weights
    for rows in _by_length(units):
        some = [units[i] for i in rows]
        out[rows] += _weighted(margin, dense, _codes(some).T) / np.sqrt(
            np.maximum(_own_kernel(some), 1e-12)
        )
    return out


def _weighted(margin: Margin, dense: np.ndarray | None, codes: np.ndarray) -> np.ndarray:
    """Sum over all subsequences of ``ORDER`` characters, a column per unit."""
    base = len(margin.alphabet) + 1
    letters = _letters(margin.alphabet, codes)
    width, number = letters.shape
    total = np.zeros(number, np.float32)
    # Prefixes are kept by their first position; a subsequence ends at ``last``.
    for first in range(width - ORDER + 1):
        prefixes = [(first, letters[first])]
        for _ in range(ORDER - 2):
            prefixes = [
                (at, code * base + letters[at]) for before, code in prefixes for at in range(before + 1, width)
            ]
        for last in range(first + ORDER - 1, width):
            part = np.zeros(number, np.float32)
            for before, code in prefixes:
                if before < last:
                    whole = code * base + letters[last]
                    part += dense[whole] if dense is not None else _found(margin, whole)
            total += DECAY ** (last - first + 1) * part
    return total


def _found(margin: Margin, codes: np.ndarray) -> np.ndarray:
    place = np.minimum(np.searchsorted(margin.codes, codes), len(margin.codes) - 1)
    return np.where(margin.codes[place] == codes, margin.weights[place], 0)


def windows(text_unit: str) -> list[str]:
    """The marked unit, or overlapping parts of a long one."""
    text_unit = marked(text_unit)
    if len(text_unit) <= UNIT_CHARS:
        return [text_unit]
    return [text_unit[i : i + UNIT_CHARS] for i in range(0, len(text_unit) - UNIT_STEP, UNIT_STEP)]


def parts_of(text_unit: str, stems: tuple[int, ...]) -> list[str]:
    """All that is compared for a unit: its windows and its beginnings."""
    return windows(text_unit) + stems_of(text_unit, stems)


def units_of(word_units: list[str]) -> Iterator[str]:
    """Joined runs of three or more single letters."""
    run: list[str] = []
    for word in [*word_units, ""]:
        if len(word) == 1 and _LETTER.match(word):
            run.append(word)
        else:
            if len(run) >= ORDER:
                yield "".join(run)
            run = []


class _Margins:
    """Margins of words with both machines, computed once per distinct word and process."""

    def __init__(self, model: Model):
        self.model = model
        self.hashes = np.zeros(0, np.uint64)
        self.values = np.zeros((0, 2), np.float32)

    def of_readings(self, words: list[list[str]]) -> np.ndarray:
        """The highest margins over all parts of all readings of each word."""
        best = np.full((len(words), 2), -np.inf, np.float32)
        owners, parts = [], []
        for owner, texts in enumerate(words):
            own = [part for text in texts for part in parts_of(text, self.model.stems)]
            owners += [owner] * len(own)
            parts += own
        if not parts:
            return best
        distinct, place = np.unique(np.array(parts), return_inverse=True)
        units = distinct.tolist()
        for column, margin in enumerate((self.model.sure, self.model.leaning)):
            if margin is not None:
                np.maximum.at(best[:, column], owners, margins_of(margin, units)[place.reshape(-1)])
        return best

    def of_words(self, words) -> np.ndarray:
        """Margins of each word of ``words`` (see ``words_of``)."""
        distinct, first, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.hashes, distinct)
        known = np.zeros(len(distinct), bool)
        inside = place < len(self.hashes)
        known[inside] = self.hashes[place[inside]] == distinct[inside]
        values = np.empty((len(distinct), 2), np.float32)
        values[known] = self.values[place[known]]
        new = np.flatnonzero(~known)
        data = words.data.tobytes()
        starts, ends = words.starts[first[new]], words.ends[first[new]]
        values[new] = self.of_readings([readings(data[a:b]) for a, b in zip(starts, ends)])
        if len(self.hashes) + len(new) > TABLE_UNITS:
            self.hashes, self.values = distinct, values
        else:
            merged = np.concatenate([self.hashes, distinct[new]])
            order = np.argsort(merged, kind="stable")
            self.hashes = merged[order]
            self.values = np.concatenate([self.values, values[new]])[order]
        return values[inverse.reshape(-1)]


def document_features(model: Model, texts: pa.Array) -> np.ndarray:
    """1, highest sure margin; of the other units highest leaning margin, number above ``FOUND`` and that per 100 words.

    Margins count from 0 to ``MOST``, as what lies below is no evidence either way, and
    numbers as log(1 + n). What is sure does not fade in long texts.
    """
    margins = _margins_of(model)
    words = words_of(texts, lower=True)
    values = margins.of_words(words)
    text = np.repeat(np.arange(len(texts)), np.diff(words.offsets))
    short = np.flatnonzero(words.ends - words.starts <= 6)
    spelled = list(_spelled(words, short))
    if spelled:
        values = np.concatenate([values, margins.of_readings([[joined] for _, joined in spelled])])
        text = np.concatenate([text, [place for place, _ in spelled]])
    features = np.zeros((len(texts), FEATURES))
    features[:, 0] = 1
    np.maximum.at(features[:, 1], text, values[:, 0])
    rest = values[:, 0] <= FOUND
    np.maximum.at(features[:, 2], text[rest], values[rest, 1])
    np.add.at(features[:, 3], text[rest & (values[:, 1] > FOUND)], 1)
    features[:, 1:3] = np.minimum(features[:, 1:3], MOST)
    features[:, 4] = np.log1p(100 * features[:, 3] / np.maximum(np.diff(words.offsets), 1))
    features[:, 3] = np.log1p(features[:, 3])
    return features


def _margins_of(model: Model) -> _Margins:
    """The process keeps the margins of one model, the last it was asked for."""
    kept = kept_in_process("toxicity", dict)
    if model.name not in kept:
        kept.clear()
        kept[model.name] = _Margins(model)
    return kept[model.name]


def _spelled(words, short: np.ndarray) -> Iterator[tuple[int, str]]:
    """Runs of at least ``ORDER`` short words in a row that spell a unit, with their text."""
    if len(short) < ORDER:
        return
    text = np.searchsorted(words.offsets, short, "right") - 1
    size = words.ends[short] - words.starts[short]
    letter = size <= 2  # one character and at most a mark, or one of two bytes
    short, text = short[letter], text[letter]
    if len(short) < ORDER:
        return
    breaks = np.flatnonzero((np.diff(short) != 1) | (np.diff(text) != 0)) + 1
    for run in np.split(np.arange(len(short)), breaks):
        if len(run) >= ORDER:
            parts = [
                unit(words.data[words.starts[i] : words.ends[i]].tobytes()) for i in short[run]
            ]
            for joined in units_of(parts):
                yield int(text[run[0]]), joined


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
) -> Model:
    """Fit on the texts in ``docs`` of a bounded sample of ``labels`` (id, 0 or 1).

    The sample is drawn from the labels alone; its at most ``SAMPLE_TOXIC +
    SAMPLE_CLEAN`` ids are broadcast, so texts are not shuffled to find theirs.
    """
    known = labels.where(F.col(label_column).isin(0, 1) & F.col(id_column).isNotNull()).select(
        F.col(label_column).cast("int").alias("_label"),
        F.xxhash64(F.col(id_column)).alias("_key"),
        F.col(id_column).alias("_id"),
    )
    toxic = sample_rows(known.where("_label = 1"), "_key", SAMPLE_TOXIC)
    clean = sample_rows(known.where("_label = 0"), "_key", SAMPLE_CLEAN)
    chosen = stored(toxic.unionByName(clean), "toxicity-labels")
    texts = docs.where(F.col(text_column).isNotNull()).select(
        F.col(id_column).alias("_id"), F.col(text_column).alias("_text")
    )
    sample = stored(texts.join(F.broadcast(chosen), "_id").drop("_id"), "toxicity-sample")
    # One document in four only calibrates.
    calibrates = F.pmod(F.col("_key"), F.lit(4)) == 0
    total = _per_label(sample)
    prior = total.get(1, 0) / max(1, sum(total.values()))
    labelled, drawn = _per_label(known), _per_label(chosen)
    weight = {label: labelled[label] / drawn[label] for label in total}
    whole = {label: weight[label] * n for label, n in total.items()}
    share = whole.get(1, 0) / max(1, sum(whole.values()))
    name = uuid.uuid4().hex
    nothing = Model(name, None, None, (), np.zeros(FEATURES), share)
    if len(total) < 2:
        return nothing
    counts = _unit_counts(sample.where(~calibrates))
    sure, leaning, clean_units = _examples(counts, prior)
    if not leaning or not clean_units:
        warnings.warn(
            f"toxicity: no unit tells the {total[1]} toxic documents from the {total[0]} others; nothing is rejected",
            stacklevel=2,
        )
        return nothing
    # Beginnings are looked at where stems were learnt, and longer by what may be put in.
    open_ended = {len(x) - 1 for x in {*sure, *leaning} if x[0] == _BEGIN and x[-1] != _END and len(x) - 1 in STEMS}
    stems = tuple(sorted({n + more for n in open_ended for more in range(3)}))
    mistakes = counts.where(f"n_clean >= 1 AND NOT {_leans(prior)}")
    first = _machine(sure, clean_units, mistakes, stems, COPIES) if sure else None
    second = _machine(leaning, clean_units, mistakes, stems, 1 if sure else COPIES)
    model = Model(name, first, second, stems, np.zeros(FEATURES), share)
    return model._replace(logistic=_calibrate(model, sample.where(calibrates), weight, sure))


def _per_label(rows: DataFrame) -> dict[int, int]:
    return {row["_label"]: row["n"] for row in rows.groupBy("_label").agg(F.count("*").alias("n")).collect()}


def _unit_counts(sample: DataFrame) -> DataFrame:
    """``unit, n_toxic, n_clean``: documents of each label with the marked unit or stem."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "_text"):
            found: dict[str, list[int]] = {}
            for label, text in zip(batch.column("_label").to_pylist(), batch.column("_text").to_pylist()):
                names = {unit(word) for word in text.encode().lower().split()}
                every = {marked(name) for name in names if len(name) >= ORDER}
                every.update(stem for name in names for stem in stems_of(name, STEMS))
                for name in every:
                    found.setdefault(name, [0, 0])[label] += 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(found), pa.string()),
                    pa.array([pair[1] for pair in found.values()], pa.int64()),
                    pa.array([pair[0] for pair in found.values()], pa.int64()),
                ],
                names=["unit", "n_toxic", "n_clean"],
            )

    counted = sample.mapInArrow(count, "unit string, n_toxic bigint, n_clean bigint")
    summed = counted.groupBy("unit").agg(
        F.sum("n_toxic").alias("n_toxic"), F.sum("n_clean").alias("n_clean")
    )
    return stored(summed, "toxicity-units")


def _improbable(share: float, chance: float) -> str:
    """SQL: documents of which ``share`` is toxic give a unit's counts with at most ``chance``.

    Chernoff's bound, which is ``share ** n_toxic`` for a unit without clean documents.
    """
    part = "n_{0} * ln(greatest(n_{0}, 1) / ((n_toxic + n_clean) * {1!r}D))"
    divergence = f"{part.format('toxic', share)} + {part.format('clean', 1 - share)}"
    return f"(n_toxic > {share!r}D * (n_toxic + n_clean) AND {divergence} >= {-math.log(chance)!r}D)"


def _share_at(ratio: float, prior: float) -> float:
    """Toxic share of a unit's documents if its rate in toxic ones is ``ratio`` times that in clean ones."""
    return ratio * prior / (ratio * prior + 1 - prior)


def _leans(prior: float) -> str:
    """SQL: the unit's rate in toxic documents is at least ``LEANING`` times that in clean ones."""
    return f"(n_toxic >= {_share_at(LEANING, prior)!r}D * (n_toxic + n_clean))"


def _examples(counts: DataFrame, prior: float) -> tuple[list[str], list[str], list[str]]:
    """Sure and all toxic units, and frequent and random ones of the others.

    A toxic unit's counts are what ``prior`` alone gives with a probability of at most
    ``CHANCE``, and what a rate ``LEANING`` (or ``SURE``) times that in clean documents
    gives with at most ``DOUBT``.
    """
    prior = min(0.999, max(prior, 1e-3))
    telling = counts.where("n_toxic >= 3").where(
        f"{_improbable(prior, CHANCE)} AND {_improbable(_share_at(LEANING, prior), DOUBT)}"
    )
    sure = F.expr(_improbable(_share_at(SURE, prior), DOUBT)).alias("sure")
    ranked = telling.select("unit", "n_toxic", sure).orderBy(F.col("n_toxic").desc(), "unit")
    rows = ranked.limit(20 * TOXIC_UNITS).collect()
    toxic = _roots({row["unit"]: row["n_toxic"] for row in rows})[:TOXIC_UNITS]
    surely = _roots({row["unit"]: row["n_toxic"] for row in rows if row["sure"]})[:TOXIC_UNITS]
    others = counts.where(f"n_clean >= 2 AND NOT {_leans(prior)}")
    frequent = others.orderBy(F.col("n_clean").desc(), "unit").limit(CLEAN_UNITS // 3).collect()
    random = others.orderBy(F.xxhash64("unit"), "unit").limit(CLEAN_UNITS).collect()
    clean = dict.fromkeys(row["unit"] for row in [*frequent, *random])
    return surely, toxic, list(dict.fromkeys(part for text in clean for part in _cut(text)))


def _roots(units: dict[str, int]) -> list[str]:
    """Of units that begin alike those that stand for the others, by documents.

    A unit goes if a beginning of it is in clearly more documents, and a beginning goes
    if a longer unit is in nearly all of its documents. Long units count by their parts.
    """
    own = [
        text
        for text, number in units.items()
        if not any(units.get(text[:n], 0) * EXPLAINED > number for n in range(2, len(text)))
    ]
    kept = [
        text
        for text in own
        if not any(
            longer != text and longer.startswith(text) and units[longer] >= EXPLAINED * units[text]
            for longer in own
        )
    ]
    return list(dict.fromkeys(part for text in kept for part in _cut(text)))


def _cut(marked_unit: str) -> list[str]:
    """The windows of a unit that may have marks already."""
    if len(marked_unit) <= UNIT_CHARS:
        return [marked_unit]
    return windows(marked_unit.strip(_BEGIN + _END))


def _mistaken(units: DataFrame, margin: Margin, stems: tuple[int, ...]) -> list[str]:
    """Those of ``units``, which are no insults, nearest to the toxic side."""
    open_ended = [length + 1 for length in stems]

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = (text for text in batch.column("unit").to_pylist())
            seen = [text for text in known if text.endswith(_END) or len(text) in open_ended]
            texts = [part for text in seen for part in _cut(text)]
            values = margins_of(margin, texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, pa.string()), pa.array(values, pa.float64())], names=["unit", "m"]
            )

    found = units.select("unit").mapInArrow(margins, "unit string, m double").where("m > -0.7").distinct()
    return [row["unit"] for row in found.orderBy(F.col("m").desc(), "unit").limit(MISTAKEN_UNITS).collect()]


def _farthest(units: list[str], number: int) -> list[str]:
    """Landmarks: each the unit least like those chosen before, the first the most frequent."""
    pool = units[:: -(-len(units) // LANDMARK_POOL)]
    alike = similarities(pool, pool)
    chosen, nearest = [0], alike[0].copy()
    while len(chosen) < min(number, len(pool)):
        place = int(nearest.argmin())
        if nearest[place] > 0.95:
            break
        chosen.append(place)
        nearest = np.maximum(nearest, alike[place])
    return [pool[place] for place in chosen]


def disguised(units: list[str], letters: list[str], copies: int, seed: int) -> list[str]:
    """Copies of marked units with characters put in, dropped, repeated or hidden.

    Nothing is dropped or hidden of very short units, as the rest is in many words.
    """
    rng = np.random.default_rng(seed)
    pick = lambda: letters[rng.integers(len(letters))]
    out = []
    for text in units * copies:
        first, last = 1, len(text) - text.endswith(_END)
        if last - first < ORDER:
            continue
        for number in range(1, INSERTIONS + 1):
            for _ in range(2):
                copy = text
                for at in sorted(rng.integers(first + 1, last, number), reverse=True):
                    copy = copy[:at] + (pick() if rng.random() < 0.7 else _UNKNOWN) + copy[at:]
                out.append(copy)
        for at in rng.permutation(np.arange(first, last))[:3]:
            out.append(text[:at] + text[at] * int(rng.integers(1, INSERTIONS + 1)) + text[at:])
            if last - first > ORDER:
                out.append(text[:at] + text[at + 1 :])
                out.append(text[:at] + _UNKNOWN + text[at + 1 :])
    return list(dict.fromkeys(out))


def _letters_of(units: list[str]) -> list[str]:
    return sorted({x for text in units for x in text} - {_BEGIN, _END, _UNKNOWN})


def _machine(
    toxic: list[str], clean: list[str], others: DataFrame, stems: tuple[int, ...], copies: int
) -> Margin:
    """Nystroem features, then a linear machine; mistaken clean units join in rounds.

    Disguised copies and the mistaken ones also give landmarks, since they differ
    least from the other side.
    """
    clean, known = list(clean), set(clean)
    hidden = [x for x in disguised(toxic, _letters_of(clean), copies, seed=0) if x not in known]
    landmarks = _farthest(toxic, TOXIC_LANDMARKS)
    if hidden:
        landmarks = landmarks + _farthest(hidden, TOXIC_LANDMARKS)
    landmarks = list(dict.fromkeys(landmarks + _farthest(clean[:500], CLEAN_LANDMARKS)))
    toxic, alike = toxic + hidden, [np.zeros((0, 0), np.float32)] * 2
    for mining in range(MINING_ROUNDS + 1):
        alike = [_extended(*pair, landmarks) for pair in zip(alike, (toxic, clean))]
        values, vectors = np.linalg.eigh(similarities(landmarks, landmarks).astype(np.float64))
        # Symmetric inverse root of the landmarks' own kernel, without its null space.
        inverse = np.where(values > 1e-6, 1 / np.sqrt(np.maximum(values, 1e-6)), 0)
        root = vectors @ np.diag(inverse) @ vectors.T
        weights, bias = _support_vectors(alike[0] @ root, alike[1] @ root)
        margin = margin_of(landmarks, root @ weights, float(bias))
        if mining == MINING_ROUNDS:
            break
        wrong = [text for text in _mistaken(others, margin, stems) if text not in known]
        if not wrong:
            break
        clean += wrong
        known.update(wrong)
        if mining < 2:
            landmarks = list(dict.fromkeys(landmarks + _farthest(wrong, CLEAN_LANDMARKS)))
    return margin


def _extended(known: np.ndarray, units: list[str], landmarks: list[str]) -> np.ndarray:
    """``similarities(units, landmarks)``, of which the first rows and columns are known."""
    rows, columns = known.shape
    right = similarities(units[:rows], landmarks[columns:])
    return np.concatenate([np.concatenate([known, right], 1), similarities(units[rows:], landmarks)])


def _support_vectors(toxic: np.ndarray, clean: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared hinge loss with both classes weighing the same, by Newton steps."""
    x = np.concatenate([toxic, clean]).astype(np.float64)
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    y = np.concatenate([np.ones(len(toxic)), -np.ones(len(clean))])
    share = np.concatenate([np.full(len(toxic), 0.5 / len(toxic)), np.full(len(clean), 0.5 / len(clean))])
    weights = np.zeros(x.shape[1])
    for _ in range(30):
        inside = y * (x @ weights) < 1
        part = x[inside] * share[inside, None]
        curve = part.T @ x[inside] + RIDGE * np.eye(len(weights))
        step = np.linalg.solve(curve, part.T @ y[inside])
        if np.allclose(step, weights, atol=1e-8):
            break
        weights = step
    return weights[:-1], float(weights[-1])


def _calibrate(model: Model, sample: DataFrame, weight: dict[int, float], sure: list[str]) -> np.ndarray:
    """Logistic regression of the labels on the documents' features.

    ``weight`` is how many labels one row of each class stands for. Disguised copies
    of the ``sure`` units weigh as much as the toxic documents.
    """

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "_text"):
            found = document_features(model, batch.column("_text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_label"), *[pa.array(found[:, k]) for k in range(1, FEATURES)]],
                names=["label", *names],
            )

    names = ["sure", "leaning", "found", "density"]
    rows = sample.mapInArrow(features, ", ".join(["label int", *[f"{name} double" for name in names]]))
    rows = rows.orderBy("label", *names).collect()
    weights = np.zeros(FEATURES)
    if not len(rows):
        return np.array([0.0, *[1.0] * (FEATURES - 1)])
    x = np.array([[1.0, *[row[name] for name in names]] for row in rows])
    y = np.array([row["label"] for row in rows], float)
    stands = np.array([weight[row["label"]] for row in rows])
    copies = disguised(sure, _letters_of(sure), 1, seed=1)
    if model.sure is not None and copies and y.any():
        alone = np.zeros((len(copies), FEATURES))
        alone[:, 0] = 1
        alone[:, 1] = np.clip(margins_of(model.sure, copies), 0, MOST)
        stands = np.concatenate([stands, np.full(len(copies), stands[y == 1].sum() / len(copies))])
        x, y = np.concatenate([x, alone]), np.concatenate([y, np.ones(len(copies))])
    stands /= stands.mean()
    for _ in range(100):  # Newton steps with a small ridge
        chance = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        curve = (x * (stands * chance * (1 - chance))[:, None]).T @ x + 0.1 * np.eye(FEATURES)
        weights = weights - np.linalg.solve(curve, x.T @ (stands * (chance - y)) + 0.1 * weights)
    return weights


def score_texts(model: Model, texts: pa.Array) -> np.ndarray:
    if model.leaning is None:
        return np.full(len(texts), min(model.prior, math.nextafter(0.5, 0)))
    values = document_features(model, texts) @ model.logistic
    return 1 / (1 + np.exp(-np.clip(values, -30, 30)))


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    held_out: Column,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
    train_docs: DataFrame | None = None,
) -> DataFrame:
    """``id, held_out, score, predicted`` for every row of ``docs``.

    ``labels`` are those to learn from, for texts in ``train_docs`` (default: ``docs``).
    """
    texts = docs if train_docs is None else train_docs
    model = train(texts, labels, id_column, text_column, label_column)
    rows = docs.select(
        F.col(id_column).alias("_id"), held_out.alias("_held_out"), F.col(text_column).alias("_text")
    )
    kind = rows.schema["_id"].dataType.simpleString()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "_text"):
            score = score_texts(model, batch.column("_text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_held_out"), pa.array(score)],
                names=["_id", "_held_out", "score"],
            )

    scored = rows.mapInArrow(predict, f"_id {kind}, _held_out boolean, score double")
    return scored.select(
        F.col("_id").alias(id_column),
        F.col("_held_out").alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_clean(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    model = train(docs, labels, id_column, text_column, label_column)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, text_column):
            yield batch.filter(pa.array(score_texts(model, batch.column(text_column)) < 0.5))

    return docs.mapInArrow(keep, docs.schema)


def labels_to_learn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.where(fold("doc_id", 5) != 0)


def toxicity_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: learns from four folds of five, scores all."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return toxicity(docs, labels_to_learn(spark, sf_dir), fold("doc_id", 5) == 0)
