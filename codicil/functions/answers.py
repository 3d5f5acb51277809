"""Column expressions over answer sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codicil import fixed_values as fv
from codicil.functions.text import strip

_FLAGS = "(?U)"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_FLAGS + r"\w+"), 0)


def _word_in(text: Column, items: tuple[str, ...]) -> Column:
    return F.arrays_overlap(_words(text), F.array(*[F.lit(i) for i in items]))


def has_quantity(text: Column) -> Column:
    """A digit, an ideographic numeral or a spelled-out number."""
    return text.rlike(_FLAGS + r"\d") | text.rlike(fv.CJK_NUMERAL) | _word_in(text, fv.NUMBER_WORDS)


def is_notice(sentence: Column) -> Column:
    return strip(sentence).rlike("^(?:" + "|".join(fv.NOTICE_PREFIXES) + ")")


def is_checkable(sentence: Column) -> Column:
    body = strip(sentence)
    long_enough = (F.regexp_count(body, F.lit(fv.CJK)) >= fv.MIN_SENTENCE_CJK) | (
        F.length(body) >= fv.MIN_SENTENCE_CHARS
    )
    return ~is_notice(body) & has_quantity(body) & long_enough


def digit_tokens(text: Column) -> Column:
    """Numbers as bare digit strings: ``2 400`` -> ``2400``, ``8,5`` -> ``85``."""
    return F.transform(
        F.regexp_extract_all(text, F.lit(fv.DIGIT_TOKEN), 0), lambda t: F.regexp_replace(t, _FLAGS + r"\D", "")
    )


def citations(text: Column) -> Column:
    """Distinct file-like references in reading order."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(fv.CITATION), 0))
    # A suffix is a dot and a letter: without one there is nothing to look for.
    return F.when(text.rlike(r"\.\p{L}"), found).otherwise(F.array().cast("array<string>"))


def is_dressing(sentence: Column) -> Column:
    """Ordinal plus words about the answer's own shape, and no other quantity."""
    # Most sentences hold none of these words, not even inside another one: their words are not taken apart.
    spelt = F.lower(sentence).rlike("|".join(fv.ORDINAL_WORDS)) & _word_in(sentence, fv.ORDINAL_WORDS)
    ordinal = spelt | sentence.rlike(fv.CJK_ORDINAL)
    bare = F.regexp_replace(sentence, "(?iuU)\\b(?:" + "|".join(fv.ORDINAL_WORDS) + ")\\b", " ")
    bare = F.regexp_replace(bare, fv.CJK_ORDINAL, " ")
    return ordinal & _word_in(sentence, fv.STRUCTURAL_WORDS) & ~has_quantity(bare)


def collapse_markers(text: Column, marker: str = fv.REMOVED_MARKER) -> Column:
    quoted = r"\Q" + marker + r"\E"
    return F.regexp_replace(text, rf"(?U)(?:{quoted}[\s,;]*){{2,}}", marker + " ")


def clip(text: Column, limit: int = 120) -> Column:
    body = strip(text)
    return F.when(F.length(body) <= limit, body).otherwise(
        F.concat(F.rtrim(F.substring(body, 1, limit - 1), F.lit(fv.WHITESPACE)), F.lit("…"))
    )


def strip_reasoning(response: Column) -> Column:
    """A model response without its reasoning blocks."""
    text = F.regexp_replace(F.coalesce(response, F.lit("")), fv.REASONING_BLOCK, "")
    return F.regexp_replace(text, fv.REASONING_END, "")
