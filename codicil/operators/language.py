"""Language identification as a table job: character n-grams and naive Bayes."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import HashingTF, IndexToString, StringIndexer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codicil.functions.text import strip

MIN_CHARS = 20


def _ngrams(text: Column) -> Column:
    grams = [F.regexp_extract_all(F.lower(text), F.lit(f"(?s)(?=(.{{{n}}}))"), 1) for n in (1, 2, 3)]
    return F.concat(*grams)


def _featured(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("_grams", _ngrams(F.coalesce(F.col(text), F.lit(""))))


def train_languages(df: DataFrame, text: str, label: str) -> PipelineModel:
    """Model trained on labelled texts."""
    indexer = StringIndexer(inputCol=label, outputCol="_label").fit(df.select(label))
    return Pipeline(
        stages=[
            indexer,
            HashingTF(inputCol="_grams", outputCol="_tf", numFeatures=1 << 14),
            NaiveBayes(featuresCol="_tf", labelCol="_label", predictionCol="_pred", rawPredictionCol="_raw", probabilityCol="_prob"),
            IndexToString(inputCol="_pred", outputCol="_code", labels=indexer.labels),
        ]
    ).fit(_featured(df.select(text, label), text))


def score_languages(model: PipelineModel, df: DataFrame, text: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """Adds ``detected``; texts shorter than ``min_chars`` stay null."""
    stages = PipelineModel(model.stages[1:])
    scored = stages.transform(_featured(df, text))
    long_enough = F.length(strip(F.coalesce(F.col(text), F.lit("")))) >= min_chars
    return scored.withColumn("detected", F.when(long_enough, F.col("_code"))).select(*df.columns, "detected")
