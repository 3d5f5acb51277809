"""Filters of documents, chunks and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codicil import fixed_values as fv
from codicil.functions import unicode as uc
from codicil.functions.text import language_tag


def filter_documents(
    df: DataFrame, category: str | None = None, language: str | None = None, file_type: str | None = None
) -> DataFrame:
    """Optional equality filters, pushed to the scan."""
    for name, value in (("category", category), ("language", language), ("file_type", file_type)):
        if value:
            df = df.where(F.col(name) == value)
    return df


def filter_path(df: DataFrame, needle: str | None, path: str = "path") -> DataFrame:
    """Path substring, blind to case and composition; a blank needle keeps everything."""
    if not needle:
        return df
    return df.where(F.contains(uc.nfc_casefold(F.col(path)), F.lit(_casefold(needle))))


def _casefold(text: str) -> str:
    import unicodedata

    return unicodedata.normalize("NFC", text).casefold()


def filter_dates(df: DataFrame, after=None, before=None, stamp: str = "modified_at") -> DataFrame:
    if after is not None:
        df = df.where(F.col(stamp) >= F.lit(after))
    if before is not None:
        df = df.where(F.col(stamp) <= F.lit(before))
    return df


def filter_types(df: DataFrame, file_types: list[str] | None, column: str = "file_type") -> DataFrame:
    return df.where(F.col(column).isin(*file_types)) if file_types else df


def filter_score(df: DataFrame, minimum: float = fv.MIN_RELEVANCE_SCORE) -> DataFrame:
    return df.where(F.col("score") >= minimum)


def contains_any_term(text: Column, terms: Column) -> Column:
    """Accent- and case-blind substring test of any term of an array."""
    return uc.contains_any_folded(text, terms)


def with_language(df: DataFrame, raw: str = "language") -> DataFrame:
    return df.withColumn("language", language_tag(F.col(raw)))


SORTABLE = ("created_at", "file_size", "title")


def sort_documents(df: DataFrame, by: str, descending: bool = True, tie: str = "id") -> DataFrame:
    if by not in SORTABLE:
        raise ValueError(f"cannot sort by {by}; one of {SORTABLE}")
    return df.orderBy(F.desc(by) if descending else F.asc(by), tie)


def page(df: DataFrame, limit: int, offset: int = 0, tie: str = "id") -> DataFrame:
    """One page of results by score."""
    return df.orderBy(F.desc("score"), tie).offset(offset).limit(limit)
