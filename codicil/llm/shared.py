"""What several operators of this package need."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from codicil.session import materialise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stage(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the folder in spark.checkpoint.dir and read back.

    Cuts the lineage: what follows survives the loss of executors without
    computing ``df`` again.
    """
    return materialise(df, purpose)


def by_rows(function: Callable[..., Iterable[tuple]], schema: pa.Schema, flush: int = 4096) -> Callable:
    """A function for mapInArrow that turns each row into any number of rows.

    ``function`` gets the values of one row.  Output leaves in batches of about
    ``flush`` rows, so a task holds no more than one input batch and one output batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            for i in range(batch.num_rows):
                rows.extend(function(*(c[i].as_py() for c in columns)))
                if len(rows) >= flush:
                    yield to_batch(rows, schema)
                    rows = []
        if rows:
            yield to_batch(rows, schema)

    return run


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file is; it is read there and never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)
