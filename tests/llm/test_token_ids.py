"""Ids made word by word equal the library's, whatever the letters and blanks."""

import random
import unicodedata

import pytest

from brightfield.llm import token_ids

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
PLANE = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]


@pytest.fixture(scope="module", params=FILES)
def encoder(request):
    made = token_ids.Encoder(token_ids.tokenizer_path(request.param))
    assert made.by_word or made.by_piece
    return made


def assert_same(encoder, texts):
    differ = [t for t, want, got in zip(texts, encoder._library(texts), encoder.encode(texts), strict=True) if want != got]
    assert not differ, (len(differ), differ[:3])


@pytest.mark.parametrize("form", ["{}.", "a{}. b", "x{}, b", "{}.\n{}", " {} ,{}"])
def test_every_letter_before_marks_and_blanks(encoder, form):
    assert_same(encoder, [form.replace("{}", c) for c in PLANE])


def test_random_texts(encoder):
    rng = random.Random(5)
    common = [*"abcdeéİß.,.,  \n\n'’-123 ", "  ", " \n", "'s", "<|endoftext|>", "\t", "\xa0", "य़", "ढ़", "ड़", "תּ", "́", "\x1e", "\x00", "\x1f", " "]
    rare = [c for c in PLANE if unicodedata.category(c)[0] in "LMNPZC"]
    texts = ["".join(rng.choice(common) if rng.random() < 0.85 else rng.choice(rare) for _ in range(rng.randint(0, 40))) for _ in range(30_000)]
    assert_same(encoder, texts)
    assert_same(encoder, ["তিনি যায়, আর", "वह पढ़, और", "", " ", "\n", "word " * 3000, "a" * 5000])
