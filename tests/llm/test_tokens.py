"""Chunk caches and the segment tree against the library on hard texts."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from veldra.llm.tokens import LibraryEncoder, SegmentTreeWordEncoder, vocabulary_path

HARD = [
    "", " ", "a", "Hello, World.  Two  spaces\n\nand\ttabs \n mixed. \n", "it's we'LL don't'd 's.", "x_. y__, z.. w., v,. \n",
    "ΣΑΣ İstanbul J̌ é Å Ω ẞ", "<|endoftext|>a <|startoftext|> <|ENDOFTEXT|>.b<|endoftext|>", "a" * 700, "ab1" * 300 + ".",
    "\x1c\x1dab\x1f \x85 c d e　f", "日本語テスト。 中文, русский. ½²³ ٣٤", "\x00\x01 a\x01.\n b", "a , b", "hello . World", "end .\nNext", "a \x01b", ". a", ", b .", "emoji 😀😀. ok, ‍́x", "trailing.", "a.\nb\n.c\n", "\n", "x\r\ny. z",
]


WORDS = "Été straße naïve ΑΒΓ ß ﬁ ǅ ÅNGSTRÖM é x ÑANDÚ don't".split()


def texts():
    rng = random.Random(7)
    letters = "ab Z.,\n'_1é́Σ\t<|s> \x1c😀ß\u0001\u0130\u0307\u0558\u1c89"
    mixed = [" ".join(rng.choice(WORDS) + rng.choice(["", ".", ",", ".\n"]) for _ in range(30)) for _ in range(40)]
    # few kinds of characters together, blanks before stops among them
    few = [rng.sample([*letters, " .", " , ", ".\n"], 5) for _ in range(1000)]
    mixed += ["".join(rng.choices(kinds, k=rng.randint(1, 30))) for kinds in few for _ in range(14)]
    return HARD + mixed + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(6000)]


@pytest.mark.parametrize("name,make", [
    ("word_bpe_49k.json", SegmentTreeWordEncoder),
    ("word_bpe_49k.json", lambda p: LibraryEncoder(p, False)),
    ("byte_bpe_50k.json", lambda p: LibraryEncoder(p, True)),
])
def test_ids_equal_the_library(name, make):
    library = Tokenizer.from_file(vocabulary_path(name))
    encoder, given = make(vocabulary_path(name)), texts()
    for text, packed in zip(given, encoder.encode(given), strict=True):
        assert np.frombuffer(packed, np.uint32).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_decode_equals_the_library():
    library = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    encoder = SegmentTreeWordEncoder(vocabulary_path("word_bpe_49k.json"))
    for text in texts():
        ids = library.encode(text, add_special_tokens=False).ids
        assert encoder.bpe.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_long_words_and_blocks_agree():
    encoder = SegmentTreeWordEncoder(vocabulary_path("word_bpe_49k.json")).bpe
    rng = random.Random(3)
    words = [bytes(rng.choice(b"abcdeth") for _ in range(n)) for n in (1, 2, 3, 5, 8, 9, 31, 64, 100, 128)]
    for word, ids in zip(words, encoder.encode_words(words), strict=True):
        assert ids.tolist() == encoder._encode_long(word).tolist()
