"""Shingles of texts hashed together against sets of word runs."""

import numpy as np
import pytest

from codicil.llm import near_text


def plain(text, width):
    words = text.encode().lower().split()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} - {()}


@pytest.mark.parametrize("section", [64, 1 << 18])
@pytest.mark.parametrize("width", [3, 5])
def test_shingles_are_sets_of_word_runs(monkeypatch, section, width):
    """Words cost nothing of their own, wherever a section of texts ends (F1)."""
    monkeypatch.setattr(near_text, "SECTION_BYTES", section)
    rng = np.random.default_rng(7)
    texts = [" \t".join(rng.choice(["a", "B", "b", "cc", "É", "long" * 9, "x\x0by"], rng.integers(0, 60))) for _ in range(60)]
    texts += ["", " \n ", "A b  C", "a\x0cB c", "q" * 200 + " " + "r" * 90, "one " + "Q" * 300, "one " + "q" * 300]
    found = near_text.Shingler(width).all([*texts, None])
    assert [len(f) for f in found] == [len(plain(t, width)) for t in texts] + [0]
    for i, a in enumerate(texts):
        for j in range(i):
            assert len(np.intersect1d(found[i], found[j])) == len(plain(a, width) & plain(texts[j], width))


def test_words_are_hashed_by_their_bytes_together(monkeypatch):
    calls = []
    digest = near_text.xxhash.xxh64_intdigest
    monkeypatch.setattr(near_text.xxhash, "xxh64_intdigest", lambda *a: calls.append(1) or digest(*a))
    assert len(near_text.Shingler(3)(" ".join(f"w{i}" for i in range(5000)))) == 4998
    assert not calls
