"""Which texts are encoded word by word, and into which words."""

import re

from codestrata.llm.token_ids import PLAIN_WORDS, is_plain

LETTERS = "a-zß-öø-ÿ"
IN_ORDER = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\s{LETTERS}0-9]+")


def test_plain():
    for code in range(0x400):
        allowed = code in (9, 10, 13) or 0x20 <= code <= 0x7E
        letter = 0xC0 <= code <= 0xFF and code not in (0xD7, 0xF7)
        assert is_plain(f"a{chr(code)}b") == (allowed or letter)
    assert is_plain("") and not is_plain("a <|b") and not is_plain("a \ud800") and not is_plain("a 😀")


def test_words_are_those_of_the_pattern_of_the_file():
    for text in ("it's 'twas they'rest '' ''s '1 don't--'ve a'mé 42 'll'd x'", "a\n'sé\t'é <'s>"):
        assert PLAIN_WORDS.findall(text) == IN_ORDER.findall(text)
