"""Collocations against a plain version, whatever the blocks' size."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from codicil.llm import phrases
from tests.llm.helpers import LOWER


def plain(rows, min_count, longest, top, held_percent=80):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, own in f.items():
        often = {p: a for p, a in own.items() if a >= min_count}
        found = []
        for p, a in often.items():
            if len(p) > 1:
                score, k = min((2000000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p)))
                holders = [b for q, b in often.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
                if not any(100 * b >= held_percent * a for b in holders):
                    found.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "text string, lang string")
    return sorted(tuple(r) for r in phrases.collocations(df, **options).collect())


ROWS = [
    ("the cat sat. The cat\tsat on THE mat, the cat sat", "en"),
    ("the cat\nsat; on the mat on the mat on the mat", "en"),
    ("x x x x x x x", None),
    ("x x x x x x x", None),
    ("x y", "und"),
    (None, "en"),
    ("", "fr"),
    (" \t .,;", "fr"),
    ("Ünder ÜNDER ünder Ünder ünder", "de"),
    ("a b c d e f g " * 40, "en"),
    ("nul\x00l nul\x00l nul\x00l\x0bnul\x00l nul\x00l", "xx"),
    ("same in two", "en"),
    ("same in two", "de"),
    ("odd tag odd tag odd", "a\n\tb\tn \\n"),
]


@pytest.mark.parametrize("block_words", [1, 3, 7, 50, phrases.BLOCK_WORDS])
def test_equal_to_plain_loops_at_any_block_size(spark, block_words):
    want = plain(ROWS, 2, 4, 50)
    assert want and run(spark, ROWS, min_count=2, top=50, block_words=block_words) == want


@pytest.mark.parametrize("longest", [2, 3, 5])
def test_other_lengths_and_a_short_list(spark, longest):
    assert run(spark, ROWS, min_count=3, longest=longest, top=3) == plain(ROWS, 3, longest, 3)


def test_documents(spark, documents):
    rows = [(r["text"], r["lang"]) for r in documents.select("text", "lang").collect()]
    assert run(spark, rows, min_count=12, block_words=5000) == plain(rows, 12, 4, 2000)


def test_odd_and_empty_tables(spark, odd, nothing):
    assert phrases.collocations(nothing).count() == 0
    rows = [(r["text"], r["lang"]) for r in odd.select("text", "lang").collect()]
    found = sorted(tuple(r) for r in phrases.collocations(odd).collect())
    assert found == plain(rows, 30, 4, 2000) and found[0][2] == "long long long long"


def test_products_beyond_64_bits(spark):
    big = 9 * 10**15
    sizes = [("a", 1, big), ("b", 1, big + 1), ("a b", 2, big - 1)]
    rows = spark.createDataFrame([("en", *s) for s in sizes], "lang string, phrase string, words int, n long")
    found = phrases._scored(rows).first()
    assert found["score"] == 2000000 * (big - 1) // (2 * big + 1)


def test_what_a_block_sends_is_small():
    """A block's candidates go to their parts as runs of numbers, their phrases' ids rising (op11_collocations, disk)."""
    places, grams, parts = np.arange(20_000), np.random.default_rng(7).integers(0, 3_000, 20_000), 8
    ids = np.arange(3_000) * parts + 3
    rows, number, first, last, part = phrases._merged(places, grams, ids, parts)
    assert (first[number] == ids[grams[rows]]).all() and (last[number] == ids[grams[rows + 1]]).all()
    sent = phrases._dealt(0, part, np.bincount(number, minlength=len(first)), {"first": first, "last": last})
    group, keys = phrases._phrases_grouped(pa.Table.from_batches([sent]))
    assert (keys["first"].to_numpy()[group] == first).all() and (keys["last"].to_numpy()[group] == last).all()
    assert sum(sent.column(c).nbytes for c in ("codes", "n", "first", "last")) < 4 * len(first)


def test_packed_numbers_come_back():
    for values in ([], [5], [-1, 300, 70_000] * 30, [1 << 40, -(1 << 40)], list(range(1000))):
        assert phrases._unpacked(pa.scalar(phrases._packed(np.array(values, np.int64)) if values else b"", pa.binary()), len(values)).tolist() == values
