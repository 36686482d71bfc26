"""The encoder of runs against the tokenizers library itself."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from eventlake.llm import tokens

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
#: Among them white space of all kinds and what only some call white space, letters and signs of two to four bytes, parts of the added token.
BITS = [
    *("word", "Don't", "'s", "'ll", "'r", "e", " a", " .", "1a", "123", "!", "***", "'", "_", "-", "<|endoftext|>", "<|endoftext", "|>", "é", "ß", "×", "÷", "Σ", "日本", "かな", "😀", "…"),
    *(" ", "  ", "\n", "\n\n", "\t", "\r\n", "\v", "\0", "\x1c", "\x1f", "\x7f"),
    *map(chr, (0x85, 0xA0, 0x1C5, 0x24F, 0x250, 0x301, 0x430, 0x5D0, 0x627, 0x663, 0x1680, 0x180E, 0x1E9E, 0x2003, 0x200B, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)),
]


def as_lists(enc, texts):
    return [np.frombuffer(raw, enc.dtype).tolist() for raw in enc.batch(pa.array(["before", *texts], pa.string()).slice(1))]


@pytest.mark.parametrize("remember", [0, 2000, 1 << 20])
def test_runs_are_encoded_as_the_whole(remember):
    rnd, enc, tok = random.Random(31), tokens.RunEncoder(BYTE, remember), tokens.tokenizer(BYTE)
    for _ in range(150):
        some = rnd.sample(BITS, rnd.randint(2, len(BITS)))
        texts = [rnd.choice([None, ""]) if rnd.random() < 0.1 else "".join(rnd.choices(some, k=rnd.randint(1, 25))) for _ in range(rnd.randint(0, 30))]
        assert as_lists(enc, texts) == [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert enc.held == tokens._size(enc.seen)
    # an added token that two texts would form together is none
    assert as_lists(enc, ["a<|endo", "ftext|>", "  <|endoftext|>  "]) == [tok.encode(t, add_special_tokens=False).ids for t in ("a<|endo", "ftext|>", "  <|endoftext|>  ")]


def test_words_are_learnt_once_whatever_marks_and_breaks_stand_around_them():
    """Before, every pair of words around a line break, and every word with marks other than one of a few, was a piece of its own."""
    words = [a + b for a in ("stone", "rivé", "cloud", "lämp") for b in ("en", "ers", "ing", "ü")]
    text = " ".join(f"{a}.\n{b}{m}" for a in words for b in words for m in ("***", "$$$", ",", ".&&&"))
    enc = tokens.RunEncoder(BYTE)
    assert as_lists(enc, [text]) == [tokens.tokenizer(BYTE).encode(text, add_special_tokens=False).ids]
    assert len(enc.seen) <= 2 * len(words) + 10


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        tokens.RunEncoder(WORD)
