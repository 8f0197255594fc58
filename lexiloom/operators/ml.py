"""A classifier for layer 9: naive Bayes over hashed character n-grams, trained with Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import HashingTF, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = 1 << 14
TOP_K = 5
#: Rows that a model is trained on, about; of more those with the smallest hashes of their texts.
TRAINED = 50_000


def _with_grams(df: DataFrame, text: str) -> DataFrame:
    """Adds _grams, the overlapping substrings of three letters, line breaks as blanks."""
    plain = F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[\n\r]", " ")
    return df.withColumn("_grams", F.regexp_extract_all(plain, F.lit("(?s)(?=(...))"), F.lit(1)))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = TRAINED) -> PipelineModel:
    """A model of the declared languages of docs, of about `most` rows; it can be saved and loaded like any pipeline."""
    known = docs.where(F.col(lang).isNotNull()).select(F.col(text).alias("_text"), F.col(lang).alias("_lang"))
    n = known.count()
    if n > most:
        known = known.where(F.xxhash64("_text").cast("double") / 2.0**64 + 0.5 < most / n)
    known = _with_grams(known, "_text").select("_lang", "_grams")
    index = StringIndexer(inputCol="_lang", outputCol="label", handleInvalid="skip", stringOrderType="alphabetAsc")
    stages = [index, HashingTF(inputCol="_grams", outputCol="features", numFeatures=FEATURES), NaiveBayes()]
    return Pipeline(stages=stages).fit(known)


def scores(model: PipelineModel, docs: DataFrame, text: str = "text", top_k: int = TOP_K) -> DataFrame:
    """docs with scores: the top_k languages and their confidences, for identify()'s options."""
    names = model.stages[0].labels
    features = model.stages[1].transform(_with_grams(docs, text))
    found = model.stages[2].transform(features).withColumn("_p", vector_to_array("probability", "float32"))
    pairs = F.zip_with(F.array(*map(F.lit, names)), F.col("_p"), lambda t, p: F.struct(p.alias("conf"), t.alias("tag")))
    top = F.slice(F.sort_array(pairs, asc=False), 1, max(1, top_k))
    return found.select(*docs.columns, F.transform(top, lambda s: F.struct(s.tag.alias("tag"), s.conf.alias("conf"))).alias("scores"))


def language_model_scores(docs: DataFrame) -> DataFrame:
    return scores(train(docs), docs)
