from array import array
from collections import defaultdict

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from codestrata.llm.packing import Packer, Piece, pack

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def check(rows, texts, capacity, end):
    sequences, pieces = defaultdict(list), defaultdict(list)
    for row in rows:
        sequences[row["sequence_id"]].append(row)
        pieces[row["doc_id"]].append(row)
        assert row["length"] == len(row["ids"]) // 4 > 0
    for own in sequences.values():
        at = 0
        for row in sorted(own, key=lambda row: row["offset"]):
            assert row["offset"] == at
            at += row["length"]
        assert at <= capacity
    for doc_id, own in pieces.items():
        ids, lengths = [], 0
        for row in sorted(own, key=lambda row: row["start"]):
            ids += array("I", row["ids"]).tolist()
            lengths += row["length"]
        expected = [LIBRARY.encode(t or "", add_special_tokens=False).ids + [end] for i, t in texts if i == doc_id]
        assert lengths == sum(map(len, expected))
        if len(expected) == 1:
            assert ids == expected[0] and all(row["doc_tokens"] == len(ids) for row in own)
    assert set(pieces) == {i for i, _ in texts}
    return sequences


def test_every_id_in_one_piece(docs, odd):
    rows = pack(docs(odd), PATH, end_id=1, capacity=256, open_windows=2, merge_factor=2).collect()
    sequences = check(rows, odd, 256, 1)
    sizes = sorted(sum(row["length"] for row in own) for own in sequences.values())
    assert sizes[1:] == [256] * (len(sizes) - 1)  # only the last one is padded


def test_merging_in_levels(docs):
    texts = [(i, "some text of a few words " * (i % 7 + 1)) for i in range(200)]
    rows = pack(docs(texts, partitions=9), PATH, end_id=1, capacity=128, open_windows=4, merge_factor=2).collect()
    sequences = check(rows, texts, 128, 1)
    assert sum(sum(r["length"] for r in own) != 128 for own in sequences.values()) == 1


def test_empty_table(docs):
    assert pack(docs([]), PATH, end_id=1).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60), st.integers(1, 5))
def test_packer(lengths, open_windows):
    packer, windows = Packer(16, open_windows), []
    for number, length in enumerate(lengths):
        windows += packer.add(Piece(number, 0, array("I", range(length)).tobytes(), length))
        assert len(packer.windows) <= open_windows
    assert all(sum(map(len, window)) == 16 for window in windows)
    rest = list(packer.merged())
    assert all(sum(map(len, window)) == 16 for window in rest[:-1])
    found = defaultdict(dict)
    for window in [*windows, *rest]:
        assert window
        for piece in window:
            for k, value in enumerate(array("I", piece.ids)):
                assert value == piece.start + k and value not in found[piece.doc_id]
                found[piece.doc_id][value] = True
    assert {k: len(v) for k, v in found.items()} == dict(enumerate(lengths))
