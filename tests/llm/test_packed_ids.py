"""Ids for packing: those of the tokenizers library, whose calls and the splitting of texts are for new words only."""

import numpy as np
import public_tokenizers
import pytest

from gridloom.llm import bpe
from gridloom.llm.queries import VOCABULARY

ODD = [
    "", None, "it's I'LL don’t <|endoftext|>x</w> w</w>", "Σίσυφος ΣΑΣ", "a\x1cb \x85 c\xa0d e f　g", "İstanbul ǅ ⰰaⰰ1ⰰ.", "ⰰ. it's, ⰰⰱ1",
    "١٢a 12.5%% été é", "中文,한국 カナ", "x" * 3000, "a.b.c,d;;'s's", "the cat, the cat. the cat", "<|startoftext|><|startoftext|> the<|endoftext|>",
]


@pytest.fixture(scope="module")
def path():
    return public_tokenizers.path(VOCABULARY)


@pytest.mark.parametrize(("kind", "remember", "words", "suffix"), [("<u2", 1 << 19, 4096, True), ("<u4", 20, 3, True), ("<u2", 1 << 19, 5, False)])
def test_ids_are_the_librarys(path, monkeypatch, kind, remember, words, suffix):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.no_truncation()
    whole.no_padding()
    monkeypatch.setattr(bpe, "WORDS", words)
    e = bpe.library_packed(bpe.light(bpe.vocabulary(path)), kind)
    e.remember = remember
    e.last &= suffix
    for at in [*range(0, len(ODD), 4), *range(0, len(ODD), 5)]:
        some = ODD[at : at + 5]
        assert [np.frombuffer(x, kind).tolist() for x in e.encode_batch(some)] == [whole.encode(t or "", add_special_tokens=False).ids for t in some]


def test_letters_are_alphabetic():
    """A stretch of common characters that Python calls alphabetic is one word."""
    letter = bpe.regex.compile(r"\p{L}")
    assert all(chr(c).isalpha() == bool(letter.match(chr(c))) for c in range(0x110000) if bpe.COMMON.fullmatch(chr(c)))


def test_only_new_words_are_split_and_sent(path):
    class Counted:
        def __init__(self, of):
            self.of, self.n = of, 0

        def __getattr__(self, name):
            def call(*args, **named):
                self.n += 1
                return getattr(self.of, name)(*args, **named)

            return call

    e = bpe.library_packed(bpe.light(bpe.vocabulary(path)), "<u2")
    e.whole = Counted(e.whole)
    e.words, e.words_and_spaces = Counted(e.words), Counted(e.words_and_spaces)
    first = e.encode_batch(["one two, three. it's"] * 50)
    assert e.encode_batch(["it's three. two, one"] * 50 + ["one two, three. it's"])[-1] == first[0]
    assert e.words.n + e.words_and_spaces.n == 2, "a call for each of 101 texts before"
    assert e.whole.n == 1
