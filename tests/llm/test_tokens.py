"""Word-by-word ids against the tokenizer over the whole text."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from dispatchlake.llm import tokens


@pytest.mark.parametrize(("name", "spaced"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_equal_to_whole_texts(name, spaced, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    path = public_tokenizers.path(name)
    words = tokens.WordIds(path, spaced)
    library = Tokenizer.from_file(path)
    rng = random.Random(2)
    parts = ["a", "The", "STOP", "don't", "we'LL", "'s", "é", "é", "́", "ß", "İ", "Σ", "ΑΣ", "中文", "😀", "x1", "12", "½", "_", "_.", "!.", "..", ".", ",", ". ", ", ", " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x1c", "\x85", " ", " ", "\x00", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|", "|>", "endoftext", "</w>", "Ġ", "-", '"']
    for i in range(3000):
        text = "".join(rng.choice(parts) + rng.choice(["", "", " "]) for _ in range(rng.randint(0, 30)))
        if i % 3 == 0:
            text = " ".join("".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(1, 9))) for _ in range(80))
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(words.ids(text), "<u4").tolist() == want, repr(text)
