"""Packing: texts whose ids changed when they were lowered before the tokenizer."""

import numpy as np
import pytest

from codicil.llm import packing
from codicil.llm.shared import tokenizer


@pytest.mark.parametrize("text", ["H\u0331", "J\u030c", "T\u0308", "W\u030a", "Plain H\u0331ATT and Words J\u030c"])
def test_capitals_with_marks_that_compose_in_small_letters_only(text):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    got = np.frombuffer(packing.ChunkEncoder(path).encode([text])[0], np.uint32).tolist()
    assert got == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
