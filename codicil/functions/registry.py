"""Named SQL functions for users who write ``spark.sql``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from codicil.functions import unicode as uc
from codicil.operators.chunks import PIECES, _pieces
from codicil import fixed_values as fv


def register_all(spark: SparkSession) -> list[str]:
    """Register the Arrow functions under their SQL names."""
    named = {"nfc": uc._NFC, "nfkc": uc._NFKC, "fold": uc._fold, "nfc_casefold": uc._nfc_casefold}
    for name, function in named.items():
        spark.udf.register(name, function)
    spark.udf.register("chunk_pieces", _chunk_pieces)
    spark.udtf.register("chunk_text", ChunkText)
    return [*named, "chunk_pieces", "chunk_text"]


@F.pandas_udf(PIECES)
def _chunk_pieces(texts: pd.Series) -> pd.Series:
    k = fv.CHUNK_CHARS_PER_TOKEN
    limits = (fv.CHUNK_TOKENS * k, fv.CHUNK_OVERLAP_TOKENS * k, fv.CHUNK_MIN_TOKENS * k, fv.CHUNK_MAX_TOKENS * k)
    names = ("content", "offset_start", "offset_end")
    return texts.map(lambda t: [dict(zip(names, p)) for p in _pieces(t, *limits)], na_action="ignore")


@F.udtf(returnType="idx int, content string, offset_start int, offset_end int")
class ChunkText:
    """``SELECT * FROM docs, LATERAL chunk_text(docs.text)``"""

    def eval(self, text: str):
        if text and text.strip():
            k = fv.CHUNK_CHARS_PER_TOKEN
            for i, (body, start, end) in enumerate(
                _pieces(text, fv.CHUNK_TOKENS * k, fv.CHUNK_OVERLAP_TOKENS * k, fv.CHUNK_MIN_TOKENS * k, fv.CHUNK_MAX_TOKENS * k)
            ):
                yield i, body, start, end
