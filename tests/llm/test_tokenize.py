"""The cached encoder against the library itself, on odd strings."""

from __future__ import annotations

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from counterlift.llm.tokenize import ChunkEncoder

PARTS = [
    "a", "B", "é", "É", "ß", "ÿ", " ", "  ", "\n", "\t", "\r\n", "'s", "'S", "'ll", "'", "!", "?!", "12", "7", "word", "<|endoftext|>",
    "日本", "ñ", "÷", "×", "\x1f", "\x0b", "’", "é", "_", "@", "µ", "▁", "👩",
]


@pytest.mark.parametrize(("name", "glue"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
@pytest.mark.parametrize("plain", [False, True])
def test_ids_equal_the_library(name, glue, plain):
    rng = random.Random(3)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 14))) for _ in range(8000)] + [" ".join(rng.choices(PARTS, k=3000))]
    tok = Tokenizer.from_file(public_tokenizers.path(name))
    tok.encode_special_tokens = plain
    encoder = ChunkEncoder(public_tokenizers.path(name), glue, plain)
    for lead in ("", " ") if glue else ("",):
        for text, ids in zip(texts, encoder.encode(texts, lead), strict=True):
            assert tok.encode(lead + text, add_special_tokens=False).ids == ids.tolist(), text


def test_a_small_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr("counterlift.llm.tokenize.CACHE_CHUNKS", 20)
    rng = random.Random(4)
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, encoder = Tokenizer.from_file(path), ChunkEncoder(path, True)
    for _ in range(200):
        texts = [" ".join(rng.choices([*PARTS, "alpha", "beta", "gamma"], k=12)) for _ in range(5)]
        assert [x.tolist() for x in encoder.encode(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(encoder.pieces.before) <= 200
