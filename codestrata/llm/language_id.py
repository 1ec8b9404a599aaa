"""Language identification with averaged subword embeddings.

A text is its lower-cased UTF-8 bytes with everything that is no letter folded to
one blank. Subwords are the byte sequences of ``SIZES`` within a word, edges
included; each is hashed to one of ``BUCKETS`` embeddings. The embeddings of all
subwords of the whole text are averaged and go through a linear softmax. Both
layers are trained together by stochastic gradient descent in numpy, on the driver,
on at most ``SAMPLE_PER_LANGUAGE`` rows of every label, and of so many labels that those
would pass ``SAMPLE_ROWS`` on fewer each; the rows come as counts per bucket. A fifth of the sample is kept from
training to fit the temperature of the softmax and the confidence from which a
prediction is accepted with at least ``ACCEPTED_ACCURACY``.

Averaging and softmax are linear up to the exponential, so prediction uses one
table of a weight per bucket and language; it is as small as the sample's labels
allow and travels with the tasks. No shuffle of texts.

Defined results: a null text or one without a letter is ``und`` with score 0, not
accepted; without any labelled row all texts are. Rows are independent, so
repeated rows and null ids are just predicted. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm.samples import fold, sample_per_class
from codestrata.llm.tables import text_slices
from codestrata.llm.word_hashes import texts_as_bytes

SIZES = (2, 3, 4)
BUCKETS = 1 << 13
DIMENSIONS = 16
SAMPLE_PER_LANGUAGE = 500
SAMPLE_ROWS = 20_000
EPOCHS = 12
BATCH = 32
RATE = 0.5
ACCEPTED_ACCURACY = 0.99
DOUBT = 0.01
SLICE_BYTES = 1 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[: ord("a")] = 0x20
_FOLD[ord("A") : ord("Z") + 1] += 32
_FOLD[ord("z") + 1 : 0x80] = 0x20


class Model(NamedTuple):
    languages: list[str]
    weights: np.ndarray  # float32 [BUCKETS, languages], bias included
    temperature: float
    accepted_from: float


def subwords(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the subwords of all texts, and the text each belongs to."""
    data, bounds = texts_as_bytes(pc.utf8_lower(texts.cast(pa.large_string())))
    letters = np.zeros(len(data) + 2 * len(texts), np.uint8)
    # A blank before and after each text keeps texts apart and marks word edges.
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    letters[np.arange(len(data)) + 2 * owner + 1] = _FOLD[data] if len(data) else data
    letters[letters == 0] = 0x20
    of = np.repeat(np.arange(len(texts)), np.diff(bounds) + 2)
    blank = letters == 0x20
    buckets, owners = [], []
    wide = letters.astype(np.uint64)
    for size in SIZES:
        count = len(letters) - size + 1
        if count <= 0:
            continue
        inside = np.ones(count, bool)
        code = np.full(count, size, np.uint64)
        for k in range(size):
            code = (code << np.uint64(8)) | wide[k : k + count]
            if 0 < k < size - 1:
                inside &= ~blank[k : k + count]
        inside &= ~(blank[:count] & blank[size - 1 :])
        code = (code[inside] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 13)
        buckets.append(code.astype(np.int32))
        owners.append(of[:count][inside])
    if not buckets:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate(buckets), np.concatenate(owners)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text the buckets it has and how often."""
    for batch in text_slices(batches, "_text", SLICE_BYTES):
        buckets, owners = subwords(batch.column("_text"))
        pairs, times = np.unique(owners * np.int64(BUCKETS) + buckets, return_counts=True)
        cuts = np.searchsorted(pairs // BUCKETS, np.arange(batch.num_rows + 1))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("_label"),
                batch.column("_key"),
                pa.array([(pairs[a:b] % BUCKETS).astype("<u2").tobytes() for a, b in zip(cuts, cuts[1:])]),
                pa.array([times[a:b].astype("<u4").tobytes() for a, b in zip(cuts, cuts[1:])]),
            ],
            names=["label", "key", "buckets", "counts"],
        )


def train(labelled: DataFrame, id_column: str, text_column: str, lang_column: str) -> Model:
    """Fit on a bounded sample of ``labelled``; rows without a label are left out."""
    rows = labelled.where(F.col(lang_column).isNotNull() & F.col(text_column).isNotNull()).select(
        F.col(lang_column).cast("string").alias("_label"),
        F.xxhash64(F.col(id_column)).alias("_key"),
        F.col(text_column).alias("_text"),
    )
    sample = sample_per_class(rows, "_label", "_key", SAMPLE_PER_LANGUAGE, SAMPLE_ROWS)
    found = sample.mapInArrow(_counts, "label string, key bigint, buckets binary, counts binary")
    return fit(sorted(found.collect(), key=lambda row: (row["key"], row["label"])))


def fit(rows) -> Model:
    """``rows``: label, key, buckets, counts. Every fifth row of a label calibrates."""
    rows = [row for row in rows if len(row["buckets"])]
    languages = sorted({row["label"] for row in rows})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), 1.0, 1.0)
    seen = dict.fromkeys(languages, 0)
    parts: tuple[list, list] = ([], [])
    for row in rows:
        seen[row["label"]] += 1
        parts[seen[row["label"]] % 5 == 0].append(row)
    weights = _descend(parts[0], languages)
    held = parts[1] or parts[0]
    labels = np.array([languages.index(row["label"]) for row in held])
    logits = np.concatenate([_dense(held[at : at + 256]) @ weights for at in range(0, len(held), 256)])
    # Targets are smoothed: without an error in the held rows no temperature would be too low.
    target = np.full(logits.shape, DOUBT / logits.shape[1])
    target[np.arange(len(held)), labels] += 1 - DOUBT
    temperature = min(
        np.geomspace(0.02, 5, 60), key=lambda t: -(target * _log_softmax(logits / t)).sum()
    )
    chances = np.exp(_log_softmax(logits / temperature))
    best, right = chances.max(1), chances.argmax(1) == labels
    order = np.argsort(-best)
    accuracy = np.cumsum(right[order]) / np.arange(1, len(held) + 1)
    good = np.flatnonzero(accuracy >= ACCEPTED_ACCURACY)
    accepted_from = float(best[order][good[-1]]) if len(good) else 1.0
    return Model(languages, weights.astype(np.float32), float(temperature), accepted_from)


def _dense(rows) -> np.ndarray:
    """Share of each bucket in each text."""
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for line, row in zip(x, rows, strict=True):
        line[np.frombuffer(row["buckets"], "<u2")] = np.frombuffer(row["counts"], "<u4")
    return x / x.sum(1, keepdims=True)


def _descend(rows, languages: list[str]) -> np.ndarray:
    """Train embeddings and softmax; returns their product."""
    rng = np.random.default_rng(0)
    embeddings = rng.normal(0, 0.3, (BUCKETS, DIMENSIONS)).astype(np.float32)
    softmax = rng.normal(0, 0.3, (DIMENSIONS, len(languages))).astype(np.float32)
    labels = np.array([languages.index(row["label"]) for row in rows])
    steps = EPOCHS * -(-len(rows) // BATCH)
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for begin in range(0, len(rows), BATCH):
            some = order[begin : begin + BATCH]
            x = _dense([rows[i] for i in some])
            hidden = x @ embeddings
            error = np.exp(_log_softmax(hidden @ softmax))
            error[np.arange(len(some)), labels[some]] -= 1
            error /= len(some)
            rate = RATE * (1 - step / steps)
            back = error @ softmax.T
            softmax -= rate * hidden.T @ error
            # Shares are small numbers, so their layer takes larger steps.
            embeddings -= 100 * rate * (x.T @ back)
            step += 1
    return embeddings @ softmax


def _log_softmax(logits: np.ndarray) -> np.ndarray:
    shifted = logits - logits.max(1, keepdims=True)
    return shifted - np.log(np.exp(shifted).sum(1, keepdims=True))


def _predict(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    number = len(texts)
    has_letter = pc.match_substring_regex(texts.fill_null(""), r"\p{L}").to_numpy(zero_copy_only=False)
    if not model.languages:
        return ["und"] * number, np.zeros(number), np.zeros(number, bool)
    buckets, owners = subwords(texts)
    sums = np.stack(
        [np.bincount(owners, model.weights[buckets, k], number) for k in range(len(model.languages))], 1
    )
    mean = sums / np.maximum(1, np.bincount(owners, minlength=number))[:, None]
    chances = np.exp(_log_softmax(mean / model.temperature))
    best = chances.argmax(1)
    score = np.where(has_letter, chances.max(1), 0.0)
    names = [model.languages[k] if known else "und" for k, known in zip(best, has_letter)]
    return names, score, has_letter & (score >= model.accepted_from)


def identify(
    docs: DataFrame,
    labelled: DataFrame,
    held_out: Column,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
) -> DataFrame:
    """``id, held_out, lang_pred, score, accepted`` for every row of ``docs``.

    ``labelled`` has the rows to learn from. ``score`` is the calibrated
    probability of ``lang_pred``; ``accepted`` is false where the model should be
    taken as undecided.
    """
    model = train(labelled, id_column, text_column, lang_column)
    rows = docs.select(
        F.col(id_column).alias("_id"), held_out.alias("_held_out"), F.col(text_column).alias("_text")
    )

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "_text", SLICE_BYTES):
            names, score, accepted = _predict(model, batch.column("_text"))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id"),
                    batch.column("_held_out"),
                    pa.array(names, pa.string()),
                    pa.array(score, pa.float64()),
                    pa.array(accepted, pa.bool_()),
                ],
                names=["_id", "_held_out", "lang_pred", "score", "accepted"],
            )

    kind = rows.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, _held_out boolean, lang_pred string, score double, accepted boolean"
    return rows.mapInArrow(predict, schema).select(
        F.col("_id").alias(id_column), F.col("_held_out").alias("held_out"), "lang_pred", "score", "accepted"
    )


def languages_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: learns from two folds of three, predicts all."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = fold("doc_id", 3) == 1
    return identify(docs, docs.where(~held_out), held_out)
