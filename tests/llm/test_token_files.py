import struct
import zlib
from array import array

import public_tokenizers
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import fs
from tokenizers import Tokenizer

from codestrata.llm import token_files
from codestrata.llm.token_files import (
    FileReader,
    FileWriter,
    read_documents,
    read_token_files,
    write_token_files,
)
from codestrata.llm.token_ids import Encoder

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = Encoder(PATH)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(
    st.text(max_size=60)
    | st.text(alphabet="aBß'stremvld09 .,|<>_-éÖ\t\n½²ªº中Σİ́ \x0b\x0c", max_size=60)
)
def test_encoder_gives_the_library_s_ids(text):
    assert ENCODER.by_word
    assert array("I", ENCODER.encode(text)).tolist() == ids_of(text)


def test_encoder_on_special_and_long_texts(monkeypatch):
    for text in ("a<|endoftext|>b", "<|startoftext|>", "Don't WE'LL they're", "word " * 1000, "x" * 5000):
        assert array("I", ENCODER.encode(text)).tolist() == ids_of(text)
    monkeypatch.setattr("codestrata.llm.token_ids.SEGMENT_CHARS", 50)
    text = "Some words, and Ünïcode 中文 here; " * 20
    assert array("I", ENCODER.encode(text)).tolist() == ids_of(text)


def test_round_trip(docs, odd, rows_of):
    found = read_token_files(write_token_files(docs(odd), PATH, end_id=2))
    rows = found.orderBy("start").collect()
    assert [row["doc_id"] for row in rows] == sorted((i for i, _ in odd), key=lambda i: (i is not None, i))
    start = 0
    for row in rows:
        ids = array("I", row["ids"]).tolist()
        texts = [ids_of(text) + [2] for i, text in odd if i == row["doc_id"]]
        assert ids in texts and row["n_tokens"] == len(ids) and row["start"] == start
        start += len(ids)


def test_empty_table(docs):
    assert read_token_files(write_token_files(docs([]), PATH, end_id=2)).count() == 0


def test_documents_asked_for(docs, spark):
    manifest = write_token_files(docs([(i, f"text number {i}") for i in range(50)]), PATH, end_id=2)
    rows = {row["doc_id"]: array("I", row["ids"]).tolist() for row in read_documents(manifest, [7, 31, 99]).collect()}
    assert rows == {i: ids_of(f"text number {i}") + [2] for i in (7, 31)}


@pytest.fixture
def small_frames(monkeypatch):
    monkeypatch.setattr(token_files, "FRAME_IDS", 100)


def written(tmp_path, documents):
    writer = FileWriter(fs.LocalFileSystem(), str(tmp_path / "x.zst"))
    for doc_id, ids in documents:
        writer.add(doc_id, array("I", ids).tobytes())
    writer.close()
    return tmp_path / "x.zst"


def test_only_needed_frames_are_read(tmp_path, small_frames, monkeypatch):
    documents = [(None, [5]), (1, list(range(250))), (2, []), (2, [9, 9]), (9, list(range(40)))]
    path = written(tmp_path, documents)
    reader = FileReader(fs.LocalFileSystem(), str(path))
    assert [array("I", reader.ids(i)).tolist() for i in range(5)] == [ids for _, ids in documents]
    assert reader.find(2).tolist() == [2, 3] and reader.find(None).tolist() == [0] and not len(reader.find(3))
    frames = []
    own = FileReader._frame
    monkeypatch.setattr(FileReader, "_frame", lambda self, n: frames.append(n) or own(self, n))
    FileReader(fs.LocalFileSystem(), str(path)).ids(4)
    assert frames == [2]


def test_file_is_plain_zstandard(tmp_path, small_frames):
    path = written(tmp_path, [(1, list(range(250)))])
    data = zstandard.ZstdDecompressor().stream_reader(path.read_bytes(), read_across_frames=True).read()
    assert array("I", data).tolist() == list(range(250))


def test_damage_is_noticed(tmp_path, small_frames):
    path = written(tmp_path, [(1, list(range(250)))])
    whole = bytearray(path.read_bytes())
    frames, _, _ = struct.unpack("<IBI", whole[-9:])
    at = len(whole) - 9 - 12 * frames + 8  # the first frame's checksum
    whole[at] ^= 1
    path.write_bytes(whole)
    with pytest.raises(ValueError, match="checksum"):
        FileReader(fs.LocalFileSystem(), str(path)).ids(0)
    path.write_bytes(whole[:-1])
    with pytest.raises(ValueError, match="seek table"):
        FileReader(fs.LocalFileSystem(), str(path))


def test_query_digest(spark):
    rows = token_files.token_files_of_documents(spark, "/root/testdata/sf0.001").collect()
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    start, found = 0, {row["doc_id"]: row for row in rows}
    for row in texts:
        ids = array("I", ids_of(row["text"]) + [2])
        expected = (row["doc_id"], start, len(ids), zlib.crc32(ids.tobytes()))
        assert tuple(found[row["doc_id"]]) == expected
        start += len(ids)
