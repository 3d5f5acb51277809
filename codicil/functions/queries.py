"""Column expressions that rewrite and dissect questions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codicil import fixed_values as fv
from codicil.functions import unicode as uc
from codicil.functions.text import strip, words

_TERM = r"(?U)\w[\w-]*"


def _in(value: Column, items: tuple[str, ...]) -> Column:
    return value.isin(*dict.fromkeys(items))


def salient_terms(query: Column) -> Column:
    """Words of two letters or more that are no stop words, spelling kept."""
    return F.filter(
        F.regexp_extract_all(query, F.lit(_TERM), 0),
        lambda w: (F.length(w) >= 2) & ~_in(uc.strip_latin_accents(F.lower(w)), fv.STOP_WORDS),
    )


def _bigrams(run: Column) -> Column:
    return F.when(F.length(run) <= 2, F.array(run)).otherwise(
        F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))
    )


def anchor_terms(query: Column) -> Column:
    """Salient terms plus character pairs of each ideograph run, distinct."""
    glued = F.regexp_replace(uc.nfkc(query), f"(?U)(?<={fv.CJK})\\s+(?={fv.CJK})", "")
    runs = F.regexp_extract_all(glued, F.lit(f"{fv.CJK}+"), 0)
    return F.array_distinct(F.concat(salient_terms(query), F.flatten(F.transform(runs, _bigrams))))


def _take(text: Column, pattern: str, group: int = 0) -> tuple[Column, Column]:
    found = F.filter(F.transform(F.regexp_extract_all(text, F.lit(pattern), group), strip), lambda t: t != "")
    return found, F.regexp_replace(text, pattern, " ")


def glue_query(query: Column) -> Column:
    return F.regexp_replace(uc.nfkc(query), f"(?<={fv.CJK})[ \t]+(?={fv.CJK})", "")


def split_structured(query: Column, apostrophe_guard: bool = False) -> tuple[Column, Column]:
    """(distinctive tokens, remaining text): e-mails, quotes, non-Latin runs, codes.

    Each pattern only sees what the earlier ones left.  An apostrophe opens a
    quotation as in the published behaviour; ``apostrophe_guard`` asks that it
    does not follow a letter, so that two elisions are not read as a quotation.
    """
    quoted = (r"(?:(?<!\p{L})'|[«\"])" + fv.QUOTED[len("[«\"']"):]) if apostrophe_guard else fv.QUOTED
    emails, rest = _take(query, fv.EMAIL)
    quotes, rest = _take(rest, quoted, 1)
    runs, rest = _take(rest, fv.NON_LATIN + "+")
    codes, rest = _take(rest, fv.CODE)
    return F.concat(emails, quotes, runs, codes), rest


def structured_tokens(query: Column, min_nonlatin: int = 1, apostrophe_guard: bool = False) -> Column:
    found, _ = split_structured(glue_query(query), apostrophe_guard)
    if min_nonlatin > 1:
        found = F.filter(found, lambda t: ~t.rlike(f"^{fv.NON_LATIN}+$") | (F.length(t) >= min_nonlatin))
    return F.array_distinct(found)


def normalize_query(query: Column) -> Column:
    """Lower case, punctuation but hyphens to spaces, single spaces."""
    spaced = F.regexp_replace(F.lower(query), r"(?U)[^\w\s\-]", " ")
    return strip(F.regexp_replace(spaced, r"(?U)\s+", " "))


def content_terms(query: Column) -> Column:
    """Words of a normalised query that are neither stop nor question words."""
    return F.filter(words(query), lambda w: ~_in(w, fv.EXPANSION_STOP_WORDS + fv.EXPANSION_QUERY_WORDS))


def should_expand(query: Column) -> Column:
    parts = words(normalize_query(query))
    return (F.size(parts) <= fv.EXPANSION_MAX_WORDS) | F.arrays_overlap(
        parts, F.array(*[F.lit(w) for w in fv.ALWAYS_EXPANDED])
    )


def expand_terms(
    terms: Column, synonyms: dict[str, list[str]] | None = None, per_term: int = fv.MAX_SYNONYMS_PER_TERM
) -> Column:
    """Each term followed by its first synonyms, distinct in reading order."""
    table = synonyms or fv.SYNONYMS
    lookup = F.create_map(
        *[x for k, v in table.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v if s != k][:per_term]))]
    )
    return F.array_distinct(
        F.flatten(F.transform(terms, lambda t: F.concat(F.array(t), F.coalesce(lookup[F.lower(t)], F.array().cast("array<string>")))))
    )


def expanded_query(query: Column) -> Column:
    """The query to search for: expanded when short or always-expanded, else as is."""
    terms = content_terms(normalize_query(query))
    known = F.array(*[F.lit(k) for k in fv.SYNONYMS])
    applies = should_expand(query) & F.arrays_overlap(terms, known)
    return F.when(applies, F.array_join(expand_terms(terms), " ")).otherwise(query)


def reduce_meta_question(query: Column) -> Column:
    """struct(matched, subject, shape, near_miss) of "which documents are about X"."""
    text = strip(uc.nfkc(query))
    shape = F.lit(None).cast("string")
    subject = F.lit(None).cast("string")
    empty_shape = F.lit(None).cast("string")
    for label, pattern in reversed(fv.META_QUESTION_SHAPES):
        full = f"(?iuU)^(?:{pattern})$"
        found = strip(F.regexp_replace(strip(F.regexp_extract(text, full, 1)), fv.META_TRAILING, ""))
        hit = text.rlike(full)
        good = hit & (found != "")
        shape = F.when(good, F.lit(label)).otherwise(shape)
        subject = F.when(good, found).otherwise(subject)
        empty_shape = F.when(hit & (found == ""), F.lit(label)).otherwise(empty_shape)
    opener = F.lit(False)
    for prefix in fv.META_OPENERS:
        opener = opener | F.startswith(F.lower(text), F.lit(prefix))
    return F.struct(
        shape.isNotNull().alias("matched"),
        F.coalesce(subject, query).alias("subject"),
        shape.alias("shape"),
        (shape.isNull() & (empty_shape.isNotNull() | opener)).alias("near_miss"),
    )


def title_tokens(title: Column) -> Column:
    """Letter/digit runs of a title without a trailing file extension."""
    found = query_tokens(title)
    last = F.get(found, F.size(found) - 1)
    return F.when(_in(last, fv.NAMED_FILE_EXTENSIONS), F.slice(found, 1, F.size(found) - 1)).otherwise(found)


def query_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(uc.nfc(text)), F.lit(r"[0-9a-z\x{c0}-\x{ffff}]+"), 0)


def is_distinctive(title_token: Column) -> Column:
    """Specific enough to name a file: long, numeric or not ASCII."""
    return ~_in(title_token, fv.GENERIC_TITLE_WORDS) & (
        (F.length(title_token) >= 4) | title_token.rlike(r"^\p{Nd}+$") | title_token.rlike(r"[^\x00-\x7f]")
    )


def title_search_text(query: Column) -> Column:
    """The question without framing words, for a title search."""
    found = query_tokens(query)
    kept = F.filter(found, lambda t: (F.length(t) >= 3) & ~_in(t, fv.TITLE_SEARCH_STOP_WORDS))
    return F.array_join(F.when(F.size(kept) > 0, kept).otherwise(found), " ")


def names_a_file(query: Column) -> Column:
    found = F.regexp_extract_all(F.lower(query), F.lit(r"(?U)\.([0-9a-z]{2,5})\b"), 1)
    return F.exists(found, lambda e: _in(e, fv.NAMED_FILE_EXTENSIONS))


def mentioned_path(query: Column) -> Column:
    """First absolute path with a known extension named in the question."""
    endings = "|".join(fv.NAMED_FILE_EXTENSIONS)
    return F.regexp_extract(query, rf"(?i)(?:~|/|[A-Za-z]:[\\/])[^\n\t\"?*<>|]+?\.(?:{endings})\b", 0)
