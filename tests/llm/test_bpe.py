import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from larkmill.llm import bpe

PATH = public_tokenizers.path(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def both():
    return bpe.loaded(bpe.read_vocabulary()), Tokenizer.from_file(PATH)


TEXTS = ["", " \t\n", "Hello, World! it's we'll 'small", "a" * 300, "ΑΣ Σ İstanbul É é ﬁ", "x\x1cy \x85z w", "a<|endoftext|>b <|startoftext|>", "<|endoftext|", "日本語 テスト 🙂🙂👍🏽", "12 345 ½ ² ٣", "!!!??? ...", "aaaaaaab aaab", "ééèêç ßÜ ñÑ", "é ́x", "\x00\x01\x7f", "ab" * 5000]


@pytest.mark.parametrize("text", TEXTS)
def test_like_library(both, text):
    mine, theirs = both
    ids = theirs.encode(text, add_special_tokens=False).ids
    assert mine.encode(text) == ids
    assert " ".join(x[1] for x in mine.pieces(text) if x[1]) == theirs.decode(ids, skip_special_tokens=False)


def test_random_words(both):
    mine, theirs = both
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice("etaoinshrdlu'.,é ") for _ in range(rng.randint(1, 30)))
        assert mine.encode(text) == theirs.encode(text, add_special_tokens=False).ids
