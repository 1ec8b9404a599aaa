"""Texts to token ids with a public tokenizer file.

``Encoder.encode`` returns what the tokenizers library returns for the text.
Where the file has the word pattern below, the ids of a word do not depend on its
neighbours, so each distinct word goes through the library's model once and comes
from a bounded table afterwards. All other texts and files go through the library
as they are.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import cache

from tokenizers import Tokenizer

from codestrata.llm.process import kept_in_process

#: Words kept per process; when full the table starts anew.
TABLE_WORDS = 500_000
SEGMENT_CHARS = 1 << 20

# Normalizer and word pattern of the file this is written for.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# The same pattern over printable ASCII and the letters of Latin-1, lower case.
_LETTERS = "a-zß-öø-ÿ"
# Only its first branch begins with a letter, so the commonest words are tried first.
PLAIN_WORDS = re.compile(rf"[{_LETTERS}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\s{_LETTERS}0-9]+")
PLAIN_BYTES = bytes([*b"\t\n\r", *range(0x20, 0x7F), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)])


def is_plain(text: str) -> bool:
    """Whether ``text`` has only blanks, printable ASCII and letters of Latin-1, and no special string."""
    try:
        return not text.encode("latin-1").translate(None, PLAIN_BYTES) and "<|" not in text
    except UnicodeEncodeError:
        return False


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, others follow 255."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [byte for byte in range(256) if byte not in own]
    return {byte: chr(byte) for byte in own} | {
        byte: chr(256 + place) for place, byte in enumerate(others)
    }


class Encoder:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words: dict[str, bytes] = {}
        self.letters = _byte_letters()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        normalizers = (spec.get("normalizer") or {}).get("normalizers", [])
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.by_word = (
            [step["type"] for step in normalizers] == _NORMALIZERS
            and splits[0].get("pattern") == {"Regex": _PATTERN}
            and all(token["content"].startswith("<|") for token in spec["added_tokens"])
        )

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers, without special tokens."""
        if not self.by_word:
            return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if len(text) <= SEGMENT_CHARS:
            return self._segment(text)
        return b"".join(map(self._segment, segments(text)))

    def _segment(self, text: str) -> bytes:
        if not is_plain(text):
            return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        words = PLAIN_WORDS.findall(text.lower())
        try:
            return b"".join(map(self.words.__getitem__, words))
        except KeyError:
            if len(self.words) > TABLE_WORDS:
                self.words.clear()
            for word in words:
                if word not in self.words:
                    self.words[word] = self._word(word)
            return b"".join(map(self.words.__getitem__, words))

    def _word(self, word: str) -> bytes:
        # Printable ASCII stands for itself.
        letters = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return b"".join([_id_bytes(token.id) for token in self.model.tokenize(letters)])


def segments(text: str):
    """Parts of ``text`` cut before a blank, so no word is split."""
    begin = 0
    while len(text) - begin > SEGMENT_CHARS:
        cut = text.find(" ", begin + SEGMENT_CHARS)
        if cut < 0:
            break
        yield text[begin:cut]
        begin = cut
    yield text[begin:]


@cache
def _id_bytes(number: int) -> bytes:
    return number.to_bytes(4, "little")


def _packed(ids: list[int]) -> bytes:
    values = array("I", ids)
    if array("H", [1]).tobytes() != b"\x01\x00":
        values.byteswap()
    return values.tobytes()


def encoder(path: str) -> Encoder:
    """One encoder per process and file."""
    return kept_in_process(("encoder", path), lambda: Encoder(path))
