"""Column expressions over document text and metadata."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from codicil import fixed_values as fv
from codicil.functions import unicode as uc

WS = fv.WHITESPACE_CLASS


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(fv.WHITESPACE))


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""


def words(text: Column) -> Column:
    """Pieces between runs of white space; [] for blank text."""
    return F.filter(F.split(text, WS + "+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def line_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("\n")).cast("long") + 1


def tokens(text: Column) -> Column:
    """Lower-cased letter/digit runs, the unit of lexical search."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), 0)


def normalize_text(text: Column) -> Column:
    """One newline style, at most one blank line, single spaces, trimmed."""
    text = F.regexp_replace(text, r"\r\n?", "\n")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(text, " {2,}", " "))


def token_estimate(text: Column, chars_per_token: int) -> Column:
    return F.floor(F.length(text) / F.lit(chars_per_token)).cast("long")


def summary(content: Column, limit: int = fv.SUMMARY_CHARS) -> Column:
    return F.when(F.length(content) > limit, F.concat(F.substring(content, 1, limit), F.lit("..."))).otherwise(content)


def title_or_last_part(title: Column, path: Column) -> Column:
    return F.when(F.coalesce(title, F.lit("")) != "", title).otherwise(F.substring_index(path, "/", -1))


def parse_stamp(stamp: Column) -> Column:
    """ISO text to timestamp; unreadable text gives null."""
    return F.try_to_timestamp(stamp)


def content_fingerprint(content: Column) -> Column:
    return F.sha2(strip(uc.nfkc(F.coalesce(content, F.lit("")))), 256)


def excerpt_around(content: Column, token: Column, radius: int = fv.EXCERPT_RADIUS) -> Column:
    """Window of ``radius`` characters each side of the first hit of ``token``."""
    return _excerpt(uc.nfkc(content), F.lower(uc.nfkc(token)), F.length(token), radius)


def _excerpt(body: Column, needle: Column, token_length: Column, radius: int) -> Column:
    hit = F.position(needle, F.lower(body)) - 1
    start = F.greatest(F.lit(0), hit - radius)
    end = F.least(F.length(body), hit + token_length + radius)
    window = F.concat(
        F.when(start > 0, F.lit("…")).otherwise(F.lit("")),
        F.substring(body, start + 1, end - start),
        F.when(end < F.length(body), F.lit("…")).otherwise(F.lit("")),
    )
    return F.when(hit < 0, F.substring(body, 1, 2 * radius)).otherwise(window)


def normalise_date(raw: Column) -> Column:
    """``D:YYYYMMDD[HHmmss]`` to ISO; text too short to hold a date is kept."""
    body = F.when(F.startswith(raw, F.lit("D:")), raw.substr(F.lit(3), F.length(raw))).otherwise(raw)
    day = F.concat_ws("-", F.substring(body, 1, 4), F.substring(body, 5, 2), F.substring(body, 7, 2))
    time = F.concat_ws(":", F.substring(body, 9, 2), F.substring(body, 11, 2), F.substring(body, 13, 2))
    return (
        F.when(F.length(body) >= 14, F.concat(day, F.lit("T"), time))
        .when(F.length(body) >= 8, day)
        .otherwise(body)
    )


def flatten_parts(parts: Column) -> Column:
    """Text of an array of ``{type, text}`` parts joined by a space; null is empty."""
    texts = F.transform(
        F.filter(parts, lambda p: p["type"] == "text"), lambda p: F.coalesce(p["text"], F.lit(""))
    )
    return F.coalesce(F.array_join(texts, " "), F.lit(""))


def tokens_per_second(count: Column, nanoseconds: Column) -> Column:
    rate = F.try_divide(count, nanoseconds / F.lit(1e9))
    return F.when((count != 0) & (nanoseconds != 0), F.round(rate, 2))


# --- languages and scripts ------------------------------------------------------


def _language_atom(raw: Column) -> Column:
    key = F.regexp_replace(F.lower(strip(raw)), "_", "-")
    primary = F.substring_index(key, "-", 1)
    known = F.create_map(*[F.lit(x) for kv in fv.LANGUAGE_THREE_TO_TWO.items() for x in kv])
    return (
        F.when(F.map_contains_key(known, primary), known[primary])
        .when((F.char_length(primary) == 2) & primary.rlike(r"^\p{L}+$"), primary)
        .otherwise("unknown")
    )


def language_tag(raw: Column) -> Column:
    """Any stored language notation as a two-letter code, else ``unknown``."""
    text = F.coalesce(raw, F.lit(""))
    atoms = F.array_distinct(F.filter(F.transform(F.split(text, r"\+"), _language_atom), lambda a: a != "unknown"))
    return (
        F.when(text == "", F.lit("unknown"))
        .when(F.contains(text, F.lit("+")), F.when(F.size(atoms) == 1, F.get(atoms, F.lit(0))).otherwise("unknown"))
        .otherwise(_language_atom(text))
    )


def language_filter_value(raw: Column) -> Column:
    """Filter form of a language: null = no filter, unrecognised text kept."""
    text = F.lower(strip(raw))
    tag = language_tag(text)
    return (
        F.when(raw.isNull() | (text == ""), F.lit(None).cast("string"))
        .when((tag == "unknown") & (text != "unknown"), text)
        .otherwise(tag)
    )


def expected_scripts(languages: list[str]) -> list[str]:
    found = {s for lang in languages for s in fv.SCRIPTS_BY_LANGUAGE.get(lang.lower(), ())}
    return sorted(found | {"LATIN"})


def script_ratio(text: Column, scripts: list[str]) -> Column:
    """struct(ratio, letters): share of letters outside the expected scripts."""
    counts = uc.script_counts(text, scripts)
    ratio = F.coalesce(F.try_divide(counts["unexpected"], counts["letters"]), F.lit(0.0))
    return F.struct(ratio.alias("ratio"), counts["letters"].alias("letters"))


def missing_script(text: Column, scripts: list[str]) -> Column:
    """True when none of the scripts shows among the letters."""
    if not scripts:
        return F.lit(True)
    return ~uc.script_counts(text, scripts)["expected_seen"]


def is_garbled(text: Column, languages: list[str] | None) -> Column:
    """Too many letters from scripts the declared languages do not use."""
    if not languages:
        return F.lit(False)
    found = script_ratio(text, expected_scripts(languages))
    return (found["letters"] >= fv.GARBLE_MIN_LETTERS) & (found["ratio"] >= fv.GARBLE_RATIO)


def latin_share(text: Column) -> Column:
    """JVM-only share of letters outside the Latin script (no sampling)."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    latin = F.length(F.regexp_replace(text, r"[^\p{IsLatin}]", ""))
    return F.coalesce(F.try_divide(letters - latin, letters), F.lit(0.0))


def glue_cjk_line(text: Column) -> Column:
    """Drop spaces and tabs standing between two ideographs of one line."""
    return F.regexp_replace(text, f"(?<={fv.CJK})[ \t]+(?={fv.CJK})", "")


def glue_cjk_columns(text: Column) -> Column:
    """Join runs of three or more consecutive one-ideograph lines."""
    pad = f"(?:(?!\n){WS})*"
    line = f"{pad}{fv.CJK}{pad}"
    least = fv.VERTICAL_RUN_LINES - 1
    # A marked run is rewritten piece by piece: odd pieces of the split are runs.
    marked = F.regexp_replace(text, rf"(?<![^\n])({line}(?:\n{line}){{{least},}})(?![^\n])", "\x00$1\x00")
    pieces = F.split(marked, "\x00", -1)
    return F.array_join(
        F.transform(pieces, lambda p, i: F.when(i % 2 == 1, F.regexp_replace(p, WS + "+", "")).otherwise(p)), ""
    )


def glue_cjk(text: Column) -> Column:
    return glue_cjk_columns(glue_cjk_line(text))


# --- sentences, headings, metadata ------------------------------------------------


def sentences(text: Column) -> Column:
    """Trimmed, non-empty sentences in reading order.

    The same as cutting at ``fv.SENTENCE_SPLIT``: every cut is first made a line end, in passes without look-behind.
    """
    cut = F.regexp_replace(text, r"(?U)([.!?…])\s+", "$1\n")
    for mark in "。！？":
        cut = F.replace(cut, F.lit(mark), F.lit(mark + "\n"))
    return F.filter(F.transform(F.split(cut, "\n"), strip), lambda s: s != "")


def markdown_headings(content: Column) -> Column:
    low, high = fv.HEADING_CHARS
    found = F.transform(F.regexp_extract_all(content, F.lit(fv.HEADING), 1), strip)
    return F.array_distinct(F.filter(found, lambda h: F.length(h).between(low, high)))


def word_shingles(text: Column, size: int) -> Column:
    """Runs of ``size`` consecutive lower-cased words, in one linear pass."""
    spaced = strip(F.regexp_replace(F.lower(text), WS + "+", " "))
    run = f"(?<![^ ])(?=([^ ]+(?: [^ ]+){{{size - 1}}}))"
    return F.regexp_extract_all(spaced, F.lit(run), 1)


def flatten_metadata(metadata: Column, core_keys: list[str]) -> Column:
    """Metadata entries that do not collide with a core field."""
    return F.map_filter(metadata, lambda k, v: ~k.isin(core_keys) & v.isNotNull())


# --- crops ---------------------------------------------------------------------

CROP_WORDS = 200
_CROP_WORD = re.compile(r"[^\W]+")


def _best_crop(text: str | None, terms: list[str] | None, words: int) -> dict | None:
    """One sweep over the words: the window with the most distinct terms, the earliest of these, its terms in the middle."""
    if text is None:
        return None
    spans = [m.span() for m in _CROP_WORD.finditer(text)]
    wanted = set(terms if terms is not None else ())
    found = [(i, w) for i, (a, b) in enumerate(spans) if (w := text[a:b].lower()) in wanted]
    best, held, tail = (0, 0, 0), {}, 0
    for at, (i, word) in enumerate(found):
        held[word] = held.get(word, 0) + 1
        while i - found[tail][0] >= words:
            old = found[tail][1]
            held[old] -= 1
            if not held[old]:
                del held[old]
            tail += 1
        if len(held) > best[0]:
            best = (len(held), found[tail][0], i)
    matched, first, last = best
    start = max(0, first - (words - (last - first + 1)) // 2) if matched else 0
    end = min(len(spans), start + words)
    if not spans:
        return {"first_word": 0, "n_words": 0, "matched": 0, "crop": text}
    a = 0 if not start else spans[start][0]
    b = len(text) if end == len(spans) else spans[end - 1][1]
    return {"first_word": start, "n_words": end - start, "matched": matched, "crop": ("…" if start else "") + text[a:b] + ("…" if end < len(spans) else "")}


def best_crop(text: Column, terms: Column, words: int = CROP_WORDS) -> Column:
    """struct(first_word, n_words, matched, crop): the ``words`` words of ``text`` that hold the most distinct ``terms`` (lower case).

    Words are runs of letters, digits and underscores.  Of windows alike the first one
    counts; what room its terms leave is shared by both sides.  Cut ends are marked by "…".
    """

    @F.pandas_udf("first_word int, n_words int, matched int, crop string")
    def crop(texts: pd.Series, wanted: pd.Series) -> pd.DataFrame:
        rows = [_best_crop(t, w, words) or dict.fromkeys(("first_word", "n_words", "matched", "crop")) for t, w in zip(texts, wanted, strict=True)]
        out = pd.DataFrame(rows, columns=["first_word", "n_words", "matched", "crop"])
        return out.astype({c: "Int32" for c in ("first_word", "n_words", "matched")})

    return crop(text, terms)
