import random

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fumble.llm.tokens import DROPPED, SPACED, Encoder, slices

FILES = [("word_bpe_49k.json", DROPPED), ("byte_bpe_50k.json", SPACED)]
ODD = " \t\n\r\x0b\x0c\x1c\x1f\x85\xa0   　​﻿'sté́İΣςß1٣!.<|endoftext|>日本𝒳ab"


@pytest.mark.parametrize("name,unit", FILES)
def test_ids_equal_those_of_whole_texts(name, unit):
    file = public_tokenizers.path(name)
    whole, enc = Tokenizer.from_file(file), Encoder(file, unit, memo=50)

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.text(alphabet=ODD, max_size=40), max_size=5))
    def run(texts):
        ids, sizes = enc.encode(texts)
        want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]

    run()


def test_nulls_long_texts_and_batches():
    enc = Encoder(public_tokenizers.path("byte_bpe_50k.json"), SPACED)
    rng = random.Random(1)
    long = "".join(rng.choice("ab c\n") for _ in range(200_000))
    ids, sizes = enc.encode([None, "", long, None])
    assert sizes.tolist() == [0, 0, len(enc.tokenizer.encode(long, add_special_tokens=False).ids), 0] and len(ids) == sizes.sum()
    column = pa.array(["12345", "12345", None, "1", "123456789", "", "1" * 30])
    assert list(slices(column, 10)) == [(0, 3), (3, 3), (6, 1)] and list(slices(column[:0])) == []


@pytest.mark.parametrize("name,unit", FILES)
def test_plain_texts(name, unit):
    """Single spaces and line ends only: the way of nearly all texts."""
    file, rng = public_tokenizers.path(name), random.Random(2)
    whole, enc = Tokenizer.from_file(file), Encoder(file, unit, memo=2000)
    words = ["<|endoftext|>", "a<|endoftext|>", "<|startoftext|>.", "<|endoftext|>!?", "endoftext|>", "It's.", "a'", "x-y-", "1.", "İ.", "ǰ!"]
    words += [w for t in ("It's done, they'll go.", "Éa 日本 𝒳x İ 12a !! ~| <|endoftext|>x") for w in t.split()] + ["a" * 300]
    texts = [rng.choice(["", " ", "\n"]) * (rng.random() < 0.1) + "".join(rng.choice(words) + rng.choice(" \n") for _ in range(rng.randrange(40))) + rng.choice(words) for _ in range(800)]
    ids, sizes = enc.encode(texts)
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


class WithoutOffsets:
    """A tokenizer that gives ids alone."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def __getattr__(self, name):
        assert name != "encode_batch", "offsets are made for each id"
        return getattr(self.tokenizer, name)


def test_byte_level_units_are_parted_by_the_bytes_of_their_ids():
    file, rng = public_tokenizers.path("byte_bpe_50k.json"), random.Random(3)
    whole, enc = Tokenizer.from_file(file), Encoder(file, SPACED, memo=300)
    enc.tokenizer = WithoutOffsets(enc.tokenizer)
    words = ["plain", "naïve,", "日本", "𝒳x", "İ.", "<|endoftext|>", "a<|endoftext|>é", "\u00e9\u0301", "x" * 400, "!?", "ß\u200b", "1٣"]
    texts = [" ".join(rng.choice(words) + str(rng.randrange(500)) * (rng.random() < 0.5) for _ in range(rng.randrange(1, 40))) + rng.choice(["", "\n", "  \t", "\r\n\r\nx"]) for _ in range(400)]
    for some in (texts[:200], texts[200:], texts[:200]):
        ids, sizes = enc.encode(some)
        want = [whole.encode(t, add_special_tokens=False).ids for t in some]
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_trim_keeps_the_units_met_again():
    enc = Encoder(public_tokenizers.path("byte_bpe_50k.json"), SPACED, memo=1 << 10)
    enc.encode(["one two three"])
    enc.encode(["one three x"])
    want = enc.encode(["one three"])[0].tolist()
    enc.trim()
    assert sorted(enc.at) == [" one", " three", "one"] and enc.encode(["one three"])[0].tolist() == want
