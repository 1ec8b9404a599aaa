import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from codestrata.llm import language_id, lattice_lm, toxicity
from codestrata.llm.samples import fold, sample_per_class
from codestrata.llm.word_hashes import window_hashes, words_of

SF = "/root/testdata/sf0.01"
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_fold(docs):
    rows = docs([(i, "x") for i in range(50)]).select("doc_id", fold("doc_id", 3).alias("f")).collect()
    assert all(row["f"] == zlib.crc32(str(row["doc_id"]).encode()) % 3 for row in rows)


def test_sample_is_bounded(spark):
    table = spark.range(5000).select("id", F.when(F.col("id") < 40, "rare").otherwise("common").alias("label"))
    counts = Counter(row["label"] for row in sample_per_class(table, "label", "id", 100, 10_000).collect())
    assert counts == {"rare": 40, "common": 100}


def test_no_label_is_left_out(spark):
    table = spark.range(5000).select("id", F.when(F.col("id") < 4000, 0).otherwise(F.col("id") % 250).alias("label"))
    counts = Counter(row["label"] for row in sample_per_class(table, "label", "id", 100, 500).collect())
    assert set(counts) == set(range(250)) and max(counts.values()) == 2
    assert sample_per_class(table.limit(0), "label", "id", 100, 500).count() == 0


def test_languages_of_many_labels(docs):
    """Each of 250 labels writes its own letters; every one is learnt and returned."""
    rng = random.Random(2)
    alphabets = ["".join(chr(0x4E00 + 4 * k + i) for i in range(4)) for k in range(250)]
    text = lambda k: " ".join("".join(rng.choices(alphabets[k], k=3)) for _ in range(30))
    table = docs([(i, text(i % 250)) for i in range(1250)])
    labelled = table.withColumn("lang", F.format_string("l%d", (F.col("doc_id") % 250).cast("int")))
    model = language_id.train(labelled, "doc_id", "text", "lang")
    assert sorted(model.languages) == sorted(f"l{k}" for k in range(250))


def test_words_and_windows(monkeypatch):
    monkeypatch.setattr("codestrata.llm.word_hashes.BLOCK_BYTES", 64)
    rng = random.Random(0)
    texts = ["".join(rng.choice("abÄ \t\n\x0b\x1f ") for _ in range(rng.randrange(300))) for _ in range(50)]
    texts += [None, "", "x" * 500, "a " * 200]
    for lower in (False, True):
        words = words_of(pa.array(texts), lower=lower)
        split = [(t or "").encode() for t in texts]
        split = [(t.lower() if lower else t).split() for t in split]
        assert np.diff(words.offsets).tolist() == list(map(len, split))
        by_hash = {}
        for value, word in zip(words.hashes.tolist(), itertools.chain(*split), strict=True):
            assert by_hash.setdefault(value, word) == word
        assert len(by_hash) == len(set(itertools.chain(*split)))
        flat = list(itertools.chain(*split))
        for width in (1, 3, 7):
            seen = {}
            for place, value in enumerate(window_hashes(words.hashes, width).tolist()):
                assert seen.setdefault(value, flat[place : place + width]) == flat[place : place + width]


# Language


def test_held_out_languages(spark):
    rows = language_id.languages_of_documents(spark, SF)
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    found = rows.join(truth, "doc_id").where("held_out").collect()
    assert sum(row["lang"] == row["lang_pred"] for row in found) / len(found) > 0.97
    assert all(0 <= row["score"] <= 1 for row in found)
    accepted = [row for row in found if row["accepted"]]
    assert len(accepted) > 0.9 * len(found)
    assert sum(row["lang"] == row["lang_pred"] for row in accepted) / len(accepted) >= 0.985


def test_language_of_odd_rows(docs, odd, rows_of):
    texts = [*odd, (20, "12 !? 3"), *((100 + i, "das ist ein deutscher text") for i in range(9))]
    table = docs(texts).withColumn("lang", F.when(F.col("doc_id") >= 100, "de").when(F.col("doc_id") == 6, "en"))
    found = language_id.identify(table, table, F.lit(False))
    names = dict(rows_of(found, "doc_id", "lang_pred"))
    assert found.count() == len(texts)
    assert names[1] == names[2] == names[3] == names[20] == "und"
    assert names[100] == "de" and names[4] in ("de", "en")
    assert language_id.identify(docs([]), docs([]), F.lit(True)).count() == 0
    unlabelled = table.withColumn("lang", F.lit(None).cast("string"))
    assert {row["lang_pred"] for row in language_id.identify(table, unlabelled, F.lit(False)).collect()} == {"und"}


def test_subwords_stay_in_their_text():
    buckets, owners = language_id.subwords(pa.array(["ab", "", "cd ef", None]))
    alone = [language_id.subwords(pa.array([t]))[0] for t in ("ab", "", "cd ef", None)]
    for place, expected in enumerate(alone):
        assert sorted(buckets[owners == place]) == sorted(expected)


# Toxicity


def brute_kernel(s, t, order, decay):
    total = 0.0
    for a in itertools.combinations(range(len(s)), order):
        for b in itertools.combinations(range(len(t)), order):
            if all(s[i] == t[j] for i, j in zip(a, b)):
                total += decay ** (a[-1] - a[0] + b[-1] - b[0] + 2)
    return total


def test_kernel_and_margin():
    units = ["idiot", "idxiot", "ab", "abcabcabc", "été", "stupid", ""]
    landmarks = ["idiot", "stupid", "abc"]
    own = {x: brute_kernel(x, x, toxicity.ORDER, toxicity.DECAY) for x in [*units, *landmarks]}
    expected = [
        [brute_kernel(u, z, toxicity.ORDER, toxicity.DECAY) / math.sqrt(max(own[u] * own[z], 1e-12)) for z in landmarks]
        for u in units
    ]
    assert toxicity.similarities(units, landmarks) == pytest.approx(np.array(expected), abs=1e-5)
    weights = np.array([1.5, -2.0, 0.5])
    margin = toxicity.margin_of(landmarks, weights, 0.25)
    assert toxicity.margins_of(margin, units) == pytest.approx(np.array(expected) @ weights + 0.25, abs=1e-5)


def labelled_corpus(size=900):
    rng = random.Random(1)
    words = [a + b for a in ("ta", "re", "mo", "li", "sen") for b in ("ro", "vi", "dal", "mer", "tos", "nu")]
    out = []
    for i in range(size):
        own = [rng.choice(words) for _ in range(40)]
        if i % 6 == 0:
            own[rng.randrange(40)] = rng.choice(["blockhead", "nitwit"])
        out.append((i, " ".join(own)))
    return out


def test_insults_with_gaps_and_insertions(docs, rows_of):
    texts = labelled_corpus()
    table = docs(texts)
    labelled = table.withColumn("toxic", (F.col("doc_id") % 6 == 0).cast("int"))
    clean = texts[1][1]
    probe = [
        (1, f"{clean} blockhead"), (2, f"{clean} b-l-o-c-k-h-e-a-d {clean}"), (3, f"{clean} n i t w i t {clean}"),
        (4, f"{clean} blo*ckhead!"), (5, f"{clean} NITWIT"), (6, f"{clean} bloxckhead"), (11, clean), (12, texts[2][1]),
    ]
    found = dict(rows_of(toxicity.toxicity(docs(probe), labelled, F.lit(True), train_docs=labelled), "doc_id", "predicted"))
    assert found == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 11: 0, 12: 0}


INSULTS = "blockhead nitwit dunderpate clodpole numskull lackwit jackanape guttersnipe fopdoodle muttonchop".split()


def test_one_insult_in_a_long_text_and_disguised(docs):
    rng = random.Random(4)
    words = [a + b for a in ("ta", "re", "mo", "li", "sen", "gu", "pra") for b in ("ro", "vi", "dal", "mer", "tos", "nu", "lis")]
    text = lambda n: rng.choices(words, k=n)
    rows = []
    for i in range(7200):
        own = text(40)
        if i % 6 == 0:
            own[rng.randrange(40)] = INSULTS[i // 6 % 10] + rng.choice(["", "", "s", "ish"])
        rows.append((i, " ".join(own)))
    table = docs(rows)
    labelled = table.withColumn("toxic", (F.col("doc_id") % 6 == 0).cast("int"))
    model = toxicity.train(labelled, labelled, "doc_id", "text", "toxic")
    half = lambda word: len(word) // 2
    disguises = {
        "plain": lambda w: w,
        "capitals": lambda w: f"({w.upper()}!)",
        "inserted": lambda w: w[: half(w)] + "x" + w[half(w) :],
        "two inserted": lambda w: w[:2] + "q" + w[2 : half(w) + 1] + "z" + w[half(w) + 1 :],
        "dropped": lambda w: w[: half(w)] + w[half(w) + 1 :],
        "repeated": lambda w: w[: half(w)] + w[half(w)] * 2 + w[half(w) :],
        "starred": lambda w: w[: half(w)] + "*" + w[half(w) + 1 :],
        "dotted": ".".join,
        "spaced": " ".join,
    }
    for name, disguise in disguises.items():
        for length in (40, 300, 2000):
            texts = [" ".join([*text(length // 2), disguise(word), *text(length // 2)]) for word in INSULTS]
            assert (toxicity.score_texts(model, pa.array(texts)) >= 0.5).sum() >= 9, (name, length)
    clean = [" ".join(text(n)) for n in (3, 40, 300, 2000, 20_000) for _ in range(20)]
    assert (toxicity.score_texts(model, pa.array(clean)) >= 0.5).sum() <= 1


def test_toxicity_of_odd_rows(docs, odd):
    labelled = docs(labelled_corpus(240)).withColumn("toxic", (F.col("doc_id") % 6 == 0).cast("int"))
    rows = toxicity.toxicity(docs(odd), labelled, F.lit(False), train_docs=labelled).collect()
    assert len(rows) == len(odd) and all(0 <= row["score"] <= 1 for row in rows)
    scores = {row["doc_id"]: row["score"] for row in rows}
    assert scores[1] == scores[2] == scores[3] < 0.5
    one_label = labelled.withColumn("toxic", F.lit(0))
    assert {row["predicted"] for row in toxicity.toxicity(docs(odd), one_label, F.lit(False), train_docs=labelled).collect()} == {0}
    empty = docs([]).withColumn("toxic", F.lit(0))
    assert toxicity.toxicity(docs([]), empty, F.lit(False)).count() == 0


def test_a_few_clean_documents_do_not_bar_a_unit(docs, rows_of):
    """Every insult is also in some clean documents, at rates of about 40 to 1."""
    texts = labelled_corpus()
    insults = ["blockhead", "nitwit"]
    texts = [(i, f"{t} {insults[i // 60 % 2]}" if i % 60 == 1 else t) for i, t in texts]
    table = docs(texts)
    labelled = table.withColumn("toxic", (F.col("doc_id") % 6 == 0).cast("int"))
    clean = texts[2][1]
    probe = [(1, f"{clean} blockhead"), (2, f"{clean} nitwit"), (3, f"{clean} bloxckhead"), (4, clean)]
    found = dict(rows_of(toxicity.toxicity(docs(probe), labelled, F.lit(True), train_docs=labelled), "doc_id", "predicted"))
    assert found == {1: 1, 2: 1, 3: 1, 4: 0}


def test_labels_without_a_telling_unit_warn(docs):
    table = docs([(i, f"the same words {i}") for i in range(120)])
    labelled = table.withColumn("toxic", (F.col("doc_id") % 6 == 0).cast("int"))
    with pytest.warns(UserWarning, match="nothing is rejected"):
        assert toxicity.keep_clean(table, labelled).count() == 120


def test_scores_do_not_depend_on_the_caps(docs, rows_of, monkeypatch):
    """Half the toxic documents show nothing, so a clean text has their share of the rest as its score."""
    texts = labelled_corpus(1200)
    quiet = {i: texts[i + 1][1] for i in range(0, 1200, 12)}
    table = docs([(i, quiet.get(i, t)) for i, t in texts])
    labelled = table.withColumn("toxic", (F.col("doc_id") % 6 == 0).cast("int"))
    probe = docs([(1, texts[1][1]), (2, f"{texts[1][1]} nitwit")])
    scores = lambda: dict(rows_of(toxicity.toxicity(probe, labelled, F.lit(True), train_docs=labelled), "doc_id", "score"))
    whole = scores()
    monkeypatch.setattr(toxicity, "SAMPLE_CLEAN", 150)
    cut = scores()
    assert whole[1] == pytest.approx(0.09, abs=0.06) and cut[1] == pytest.approx(whole[1], abs=0.07)
    assert whole[2] > 0.5 and cut[2] > 0.5
    monkeypatch.setattr(toxicity, "CHANCE", 1e-300)
    with pytest.warns(UserWarning):
        assert scores()[1] == pytest.approx(1 / 6, abs=0.001)


def test_held_out_toxicity_per_language(spark):
    sf = "/root/testdata/sf0.1"
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").distinct()
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("toxic IN (0, 1)")
    rows = toxicity.toxicity_of_documents(spark, sf).where("held_out").join(labels, "doc_id").join(truth, "doc_id")
    shares = rows.groupBy("lang", "toxic").agg(F.avg("predicted").alias("share"), F.count("*").alias("n")).collect()
    assert {row["lang"] for row in shares} == {"de", "en", "es", "fr"}
    for row in shares:
        assert row["share"] >= 0.8 if row["toxic"] else row["share"] <= 0.03, row


# Language model


def brute_word(word, weights):
    pieces, model = lattice_lm.pieces_of(PIECES), lattice_lm._load(PIECES)
    numbers = {model.id_to_piece(i): i for i in range(259, model.get_piece_size())}
    text = lattice_lm.WORD_MARK + word

    def segmentations(at):
        if at == len(text):
            yield 0.0
            return
        spelled = sum(weights[pieces.bytes_at[b]] for b in text[at].encode())
        yield from (spelled + rest for rest in segmentations(at + 1))
        for end in range(at + 1, len(text) + 1):
            if text[at:end] in numbers:
                yield from (weights[numbers[text[at:end]]] + rest for rest in segmentations(end))

    return math.log(sum(map(math.exp, segmentations(0))))


def test_word_probability_sums_all_segmentations():
    weights = lattice_lm.file_weights(PIECES)
    assert np.exp(weights).sum() == pytest.approx(1)
    words = ["the", "a", "été", "中", "😀", "i|", "thin"]
    found = lattice_lm.word_scores(lattice_lm.Vocabulary(PIECES, weights), words)
    assert found == pytest.approx([brute_word(word, weights) for word in words])
    pieces = lattice_lm.pieces_of(PIECES)
    assert found == pytest.approx([lattice_lm.LongWord(pieces, weights, word).forward()[-1] for word in words])


def test_expected_uses_are_the_gradient():
    weights, words = lattice_lm.file_weights(PIECES), ["thing", "über"]
    pieces = lattice_lm.pieces_of(PIECES)
    uses = sum(lattice_lm.Lattice(pieces, weights, [w]).expected(np.array([2.0])) for w in words)
    score = lambda w: 2 * lattice_lm.word_scores(lattice_lm.Vocabulary(PIECES, w), words).sum()
    spelled = sum(lattice_lm.LongWord(pieces, weights, w).expected(2.0) for w in words)
    assert spelled == pytest.approx(uses, abs=1e-9)
    for number in np.argsort(-uses)[:6]:
        moved = weights.copy()
        moved[number] += 1e-5
        assert uses[number] == pytest.approx((score(moved) - score(weights)) / 1e-5, rel=1e-3)


def test_scores(docs, odd, rows_of):
    texts = [*odd, *((100 + i, f"the thing {i % 7} über alles THE") for i in range(60))]
    table = docs(texts)
    held = fold("doc_id", 7) == 2
    rows = lattice_lm.score_texts(table, held, PIECES).collect()
    assert len(rows) == len(texts)
    flags = {row["doc_id"]: row["held_out"] for row in rows}
    split = lambda text: [*(text or "").encode().lower().split(), None]
    counts = Counter(word for i, text in texts if not flags[i] for word in split(text))
    below = sum(counts.values()) + len(counts) + 1
    expected = {i: split(text) for i, text in texts}
    for row in rows:
        words = expected[row["doc_id"]]
        assert row["n_tokens"] == len(words) and row["train_tokens"] == sum(counts.values())
        assert row["n_known"] == sum(counts[word] > 0 for word in words)
        assert row["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / below) for w in words))
        assert row["score"] < 0
    assert lattice_lm.score_texts(docs([]), held, PIECES).count() == 0


def test_learning_raises_the_likelihood(docs):
    table = docs([(i, f"retion thing {i % 7} hanea ontion") for i in range(60)])
    words = lattice_lm.word_table(table, F.lit(True), "text")
    scores = []
    for rounds in range(3):
        vocabulary = lattice_lm.learn(words, 60, PIECES, rounds)
        rows = words.collect()
        scores.append(lattice_lm.word_scores(vocabulary, [r["word"] for r in rows]) @ [r["n"] for r in rows])
    assert scores[0] < scores[1] < scores[2]
