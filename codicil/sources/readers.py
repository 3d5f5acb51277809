"""Readers: file inventories, text, JSON, code, logs and vectors."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codicil import fixed_values as fv
from codicil import schemas
from codicil.functions import paths
from codicil.functions.text import line_count, word_count

CODE_EXTENSIONS = dict(fv.READER_EXTENSIONS)["code"]
TEXT_EXTENSIONS = dict(fv.READER_EXTENSIONS)["plaintext"]


def _binary(spark: SparkSession, roots: list[str] | str, recursive: bool) -> DataFrame:
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(roots)
    )


def _plain_path(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/*", "/")


def file_inventory(spark: SparkSession, roots: list[str] | str, recursive: bool = True) -> DataFrame:
    """path, size, mtime, extension of every file; contents are never read."""
    path = _plain_path(F.col("path"))
    return _binary(spark, roots, recursive).select(
        path.alias("path"),
        F.col("length").alias("size"),
        (F.unix_micros("modificationTime") / 1e6).alias("mtime"),
        paths.extension(path).alias("extension"),
    )


def hash_content(df: DataFrame, content: str = "content") -> DataFrame:
    """Adds the SHA-256 of the bytes; missing bytes hash to an empty string."""
    return df.withColumn("sha256", F.coalesce(F.sha2(F.col(content).cast("binary"), 256), F.lit("")))


def _read_decoded(spark: SparkSession, roots, extensions, recursive: bool, utf16: bool) -> DataFrame:
    raw = _binary(spark, roots, recursive).select(_plain_path(F.col("path")).alias("path"), "length", "content")
    raw = raw.where(paths.extension(F.col("path")).isin(*extensions))
    utf8 = F.is_valid_utf8(F.col("content").cast("string"))
    # UTF-16 without a byte-order mark needs an even length; odd input cannot decode.
    has_mark = F.hex(F.substring("content", 1, 2)).isin("FFFE", "FEFF")
    encoding = F.when(utf8, "utf-8")
    if utf16:
        encoding = encoding.when(has_mark & (F.col("length") % 2 == 0), "utf-16")
    encoding = encoding.otherwise("latin-1")
    text = (
        F.when(encoding == "utf-8", F.col("content").cast("string"))
        .when(encoding == "utf-16", F.decode("content", "UTF-16"))
        .otherwise(F.decode("content", "ISO-8859-1"))
    )
    # Files are read with universal newlines.
    text = F.regexp_replace(text, "\r\n?", "\n")
    return raw.select("path", text.alias("text"), encoding.alias("encoding")).withColumns(
        {"word_count": word_count(F.col("text")), "line_count": line_count(F.col("text"))}
    )


def read_text_files(spark: SparkSession, roots, recursive: bool = True) -> DataFrame:
    """path, text, encoding, word_count, line_count, file_type of text files."""
    df = _read_decoded(spark, roots, TEXT_EXTENSIONS, recursive, utf16=True)
    return df.withColumn("file_type", F.ltrim(paths.extension(F.col("path")), F.lit(".")))


def read_code_files(spark: SparkSession, roots, recursive: bool = True) -> DataFrame:
    df = _read_decoded(spark, roots, CODE_EXTENSIONS, recursive, utf16=False)
    return df.withColumns(
        {
            "programming_language": F.ltrim(paths.extension(F.col("path")), F.lit(".")),
            "file_type": F.lit("code"),
        }
    )


_JSON_PROFILE = (
    T.StructType().add("text", T.StringType()).add("keys_count", T.LongType()).add("error", T.StringType())
)


@F.pandas_udf(_JSON_PROFILE)
def _json_profile(bodies: pd.Series) -> pd.DataFrame:
    def keys(node) -> int:
        if isinstance(node, dict):
            return len(node) + sum(map(keys, node.values()))
        return sum(map(keys, node)) if isinstance(node, list) else 0

    rows = []
    for body in bodies:
        try:
            value = json.loads(body)
            rows.append((json.dumps(value, indent=2, ensure_ascii=False), keys(value), None))
        except (TypeError, ValueError) as exc:
            rows.append(("", None, f"Invalid JSON: {exc}"))
    return pd.DataFrame(rows, columns=["text", "keys_count", "error"])


def parse_json(df: DataFrame, body: str) -> DataFrame:
    """Adds text, keys_count, word_count and error; a bad row never fails the job."""
    found = df.withColumn("_json", _json_profile(F.col(body)))
    return found.select(
        *df.columns, "_json.text", "_json.keys_count", word_count(F.col("_json.text")).alias("word_count"), "_json.error"
    )


def read_json_docs(spark: SparkSession, roots, recursive: bool = True) -> DataFrame:
    raw = _binary(spark, roots, recursive).select(
        _plain_path(F.col("path")).alias("path"), F.col("content").cast("string").alias("_body")
    )
    return parse_json(raw.where(paths.extension(F.col("path")) == ".json"), "_body").drop("_body")


def read_logs(spark: SparkSession, path) -> DataFrame:
    """Structured log lines; unparsable lines land in ``_corrupt_record``."""
    return spark.read.schema(schemas.LOG_LINE).option("mode", "PERMISSIVE").json(path)


def read_vectors(spark: SparkSession, path: str, schema: str, vector: str = "vector", keep_null: bool = False) -> DataFrame:
    """Vectors read verbatim; a missing table is empty, not an error."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    exists = target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
    df = spark.read.schema(schema).parquet(path) if exists else spark.createDataFrame([], schema)
    return df if keep_null else df.where(F.col(vector).isNotNull())
