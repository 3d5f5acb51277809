"""Secrets: recall on short random keys and on keys without digits."""

import random
import re
import string

import pytest

from codicil.llm import secret_scan

LOWER, UPPER, DIGITS = string.ascii_lowercase, string.ascii_uppercase, string.digits
ALLOWED = re.compile("|".join(f"(?:{p})" for p in secret_scan.ALLOWED if p != secret_scan.PATH), re.DOTALL)


def spans(run):
    return secret_scan.scan(run, ALLOWED, paths=True)["entropy"]


@pytest.mark.parametrize("alphabet", [DIGITS + "abcdef", LOWER + UPPER + DIGITS, LOWER + DIGITS, UPPER + DIGITS, LOWER, UPPER, LOWER + UPPER])
@pytest.mark.parametrize("length", [20, 24, 32, 40, 64])
def test_random_keys_are_found(alphabet, length):
    draw = random.Random(length)
    assert sum(bool(spans("".join(draw.choices(alphabet, k=length)))) for _ in range(300)) >= 0.93 * 300


def test_keys_with_slashes_are_no_paths_and_names_are_no_keys():
    draw = random.Random(7)
    keys = ["".join(draw.choices(LOWER + UPPER + DIGITS + "+/", k=40)) for _ in range(3000)]
    pathlike = [k for k in keys if re.fullmatch(secret_scan.PATH, k)]
    assert pathlike and sum(bool(spans(k)) for k in pathlike) >= 0.8 * len(pathlike)
    for run in ("getElementByIdFromDocument", "AbstractSingletonProxyFactoryBean", "/usr/lib/x86_64-linux-gnu/libstdc", "internationalization"):
        assert not spans(run), run


@pytest.mark.parametrize("signs", ["-", "_", "/", "+", "/+", "-_", "+/_=-"])
@pytest.mark.parametrize("alphabet", [LOWER + UPPER + DIGITS, LOWER + DIGITS, UPPER + DIGITS, LOWER, UPPER, LOWER + UPPER])
def test_random_keys_with_separators_are_found(alphabet, signs):
    draw = random.Random(len(alphabet) * 100 + len(signs))
    keys = ["".join(draw.choices(alphabet + signs, k=40)) for _ in range(300)]
    found = sum(bool(spans(k)) for k in keys)
    # Runs with slashes may be paths; letters alone need a part of 12 letters, which many kinds of separators cut up.
    least = 0.93
    if "/" in signs:
        least = 0.8 if alphabet in (LOWER, UPPER) else 0.9
    elif alphabet in (LOWER, UPPER) and len(signs) > 1:
        least = 0.9
    if signs == "+/_=-" and alphabet.isalpha():
        least = 0.5 if len(alphabet) == 26 else 0.85
    assert found >= least * 300, (alphabet, signs, found)


def test_words_joined_by_separators_are_no_keys():
    for run in (
        "how-to-write-a-good-commit-message", "the_quick_brown_fox_jumps_over", "HTTP_PROXY_CONNECT_TIMEOUT_MS", "2023-10-11-12-30-45-999",
        "Main/Controller/Request/Handler", "left-to-right-and-back-again", "user_account_settings_page_view", "spark/sql/catalyst/expressions",
    ):
        assert not spans(run), run
