"""The packing operator's encoder: cost of words that it knows, odd texts, Arrow slices, little room."""

import random
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from cohortloom.llm import packing

FILE = public_tokenizers.path("word_bpe_49k.json")
CHARS = ("aAbBhHjJtTwWyYiIkKsSrReE vVmMlLdD'''!#$%&*+,-./:;=?@^_~|()[]{}<>|\"`\\0129   \t\n\r\x0b\x0c\x1c\x1d\x85\xa0éÉ×÷ñÑßİıŉſĳŁžƀǰ"
         "̸̖̣̱̀́̇̈̌ͅʹ;—’“”…½²٣한글가日本　​ΣςαΩЌй😀\U0001d400﻿KÅﬁ")


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(FILE)


def ids(tokenizer, texts):
    return [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_known_words_cost_less_than_to_go_through_them():
    draw = random.Random(5)
    words = ["".join(draw.choices("abcdefghij", k=6)) + draw.choice(["", "", "", ",", "."]) for _ in range(5000)]
    texts = [" ".join(draw.choices(words, k=600)) for _ in range(1000)]
    encoder, index = packing.Encoder(FILE), {w: i for i, w in enumerate(words)}

    def gone_through():
        split = [t.split(" ") for t in texts]
        new = [w for w in dict.fromkeys(w for part in split for w in part) if w not in index]
        return new, [np.array([index[w] for w in part], np.int64) for part in split]

    def seconds(run):
        took = []
        for _ in range(5):
            begin = time.process_time()
            run()
            took.append(time.process_time() - begin)
        return min(took)

    assert seconds(lambda: list(encoder.encode(texts))) < seconds(gone_through)


def test_new_stretches_are_encoded_once(plain):
    class Spy:
        seen: list[str] = []

        def encode_batch_fast(self, texts, **options):
            self.seen += [w for t in texts for w in t.split()]
            return plain.encode_batch_fast(texts, **options)

    encoder = packing.Encoder(FILE)
    encoder.tokenizer = Spy()
    for _ in range(2):
        list(encoder.encode(pa.array([" one two, One (two) 7b", " two one. two, two"] * 50)))
    assert sorted(Spy.seen) == sorted(["one", "two", ",", ".", ")", "(two", "7b"])


@pytest.mark.parametrize("text", ["EVİ, ABCİ. İ", "é×, é÷. ×÷!", "ẖ H̱, Å. é,", "a≠b ≮", "x<|endoftext|>Y,", "A<|ENDOFTEXT|>b.",
                                  "we'll, don't. 'S ''s x's,y", "", "   ", "\t\r\n", None])
def test_odd_text(plain, text):
    encoder = packing.Encoder(FILE)
    for texts in ([text], ["x", text, "", text, "Y."]):
        assert [list(g) for g in encoder.encode(pa.array(texts, pa.string()))] == ids(plain, texts)


def test_random_texts(plain):
    draw, encoder = random.Random(1), packing.Encoder(FILE)
    parts = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|", "|>", "'s", "'re", "'LL", "´", "·"]
    for last in (0x250, 0x110000):
        chars = [c for c in CHARS if ord(c) < last]
        for _ in range(10):
            texts = ["".join(draw.choice(chars if draw.random() < 0.98 else parts) for _ in range(draw.randrange(60))) for _ in range(300)]
            for text, got, want in zip(texts, encoder.encode(texts), ids(plain, texts), strict=True):
                assert list(got) == want, text


def test_slices_nulls_and_little_room(plain):
    texts = [None, "", *(f"Word{i} word, Été. {i}" for i in range(300)), None, " ", "end"]
    for column in (pa.array(texts, pa.string()), pa.array(texts, pa.large_string())):
        encoder, got = packing.Encoder(FILE, 20), []
        for at in range(0, len(texts), 70):
            got += [list(g) for g in encoder.encode(column.slice(at, 70))]
            assert len(encoder.known) <= 20 + 4 * 70
        assert got == ids(plain, texts)
    assert list(packing.Encoder(FILE).encode([])) == []
