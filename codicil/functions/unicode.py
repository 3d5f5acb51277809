"""Arrow UDFs for the Unicode rules Spark SQL has no function for.

Each works on whole Arrow batches; everything else in the package stays in
JVM expressions.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codicil import fixed_values as fv


def _normaliser(form: str):
    @F.pandas_udf(T.StringType())
    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize(form, t), na_action="ignore")

    return apply


_NFC = _normaliser("NFC")
_NFKC = _normaliser("NFKC")


def _fold_one(text: str) -> str:
    text = text.lower()
    if text.isascii():
        return text
    parts = unicodedata.normalize("NFKD", text)
    return "".join(c for c in parts if not unicodedata.combining(c))


@F.pandas_udf(T.StringType())
def _fold(texts: pd.Series) -> pd.Series:
    return texts.map(_fold_one, na_action="ignore")


@F.pandas_udf(T.BooleanType())
def _contains_any_folded(texts: pd.Series, terms: pd.Series) -> pd.Series:
    def test(text, wanted) -> bool:
        if not text or wanted is None or not len(wanted):
            return False
        folded = _fold_one(text)
        return any(_fold_one(term) in folded for term in wanted)

    return pd.Series([test(t, w) for t, w in zip(texts, terms)], dtype=bool)


@F.pandas_udf(T.StringType())
def _nfc_casefold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t).casefold(), na_action="ignore")


@F.pandas_udf(T.StringType())
def _nfkc_casefold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t).casefold(), na_action="ignore")


def nfc(text: Column) -> Column:
    return _NFC(text)


def nfkc(text: Column) -> Column:
    return _NFKC(text)


def fold(text: Column) -> Column:
    """Lower case without accents (compatibility decomposition)."""
    return _fold(text)


def contains_any_folded(text: Column, terms: Column) -> Column:
    return _contains_any_folded(text, terms)


def nfc_casefold(text: Column) -> Column:
    return _nfc_casefold(text)


def nfkc_casefold(text: Column) -> Column:
    return _nfkc_casefold(text)


# Accented Latin letters that decompose to one plain letter, by rule.
_ACCENTED = [
    (c, d)
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)])
    for d in ["".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))]
    if d != c and len(d) == 1
]


def strip_latin_accents(text: Column) -> Column:
    """Accent-free Latin letters without leaving the JVM."""
    plain = F.translate(text, "".join(c for c, _ in _ACCENTED), "".join(d for _, d in _ACCENTED))
    return F.regexp_replace(plain, r"\p{Mn}+", "")


@functools.lru_cache(maxsize=64)
def _letters_of(scripts: tuple[str, ...]) -> str:
    """Character class of the letters whose Unicode name starts with one of the words."""
    ranges: list[list[int]] = []
    for code in range(sys.maxunicode + 1):
        ch = chr(code)
        if ch.isalpha() and unicodedata.name(ch, "").partition(" ")[0] in scripts:
            if ranges and ranges[-1][1] == code - 1:
                ranges[-1][1] = code
            else:
                ranges.append([code, code])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges)


def script_counts(text: Column, scripts: list[str]) -> Column:
    """struct(letters, unexpected, expected_seen) over all letters of the text, on the JVM.

    A letter's script is the first word of its Unicode name; a letter without
    a name counts as unexpected.
    """
    body = F.coalesce(text, F.lit(""))
    own = _letters_of(tuple(sorted(set(scripts))))
    letters = F.length(F.regexp_replace(body, r"\P{L}+", "")).cast("long")
    hits = F.length(F.regexp_replace(body, f"[^{own}]+", "")).cast("long") if own else F.lit(0).cast("long")
    return F.struct(letters.alias("letters"), (letters - hits).alias("unexpected"), (hits > 0).alias("expected_seen"))
